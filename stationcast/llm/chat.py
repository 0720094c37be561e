"""Chat formatting with a grammar round trip, in DataFrame operations only.

A conversation is rendered turn by turn as::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

A deterministic parser reads the rendering back: it cuts at every start mark, takes the
role up to the first line feed and the text up to the first end mark. A turn is written
as it is if the parser recovers it; otherwise its text is escaped. Then the whole
conversation is parsed and compared with its source; if it differs, every turn is
escaped, and if it differed even then the query fails, since nothing may be lost.

Escaping puts one backslash more between ``<`` and ``|`` wherever these stand together
or have only backslashes between them, so an escaped text holds no mark, and taking one
backslash away gives the text back. Roles also have their line feeds and backslashes
escaped, because a line feed ends a role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<|im_start|>"
END = "<|im_end|>"
_GAP = r"<(\\*)\|"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, _GAP, r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Backslash, line feed and ``<`` as two characters each."""
    out = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit("<"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    # every backslash begins a pair, so cutting at double ones from the left is exact
    def part(p: Column) -> Column:
        return F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<"))

    return F.array_join(F.transform(F.split(role, r"\\\\"), part), "\\")


def render_turn(turn: Column, escaped: Column) -> Column:
    text = F.when(escaped, escape_text(turn["text"])).otherwise(turn["text"])
    return F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """Turns of a rendered conversation, as an array of ``role, text``."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        rest = F.substring(part, F.char_length(role) + F.lit(2), F.char_length(part))
        return F.struct(
            unescape_role(role).alias("role"), unescape_text(F.substring_index(rest, END, 1)).alias("text")
        )

    parts = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def format_conversations(
    rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its id, ``formatted``, the parsed ``turns`` and ``n_escaped``.

    Null roles and texts count as empty, a null id is a conversation of its own, null
    turn numbers come first. Turns with one number are ordered by role and text; repeated
    rows are turns of their own. Further columns are not read; an empty table gives an
    empty result. One conversation is one output text, so its turns meet in one task.
    """
    named = rows.select(
        F.col(f"`{conversation}`").alias("conv"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = named.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    source = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    def check(t: Column) -> Column:
        plain = render_turn(t, F.lit(False))
        kept = F.array(F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return F.struct(t["role"].alias("role"), t["text"].alias("text"), (parse(plain) != kept).alias("hard"))

    def render(turns: Column, every: bool) -> Column:
        return F.array_join(F.transform(turns, lambda t: render_turn(t, F.lit(True) if every else t["hard"])), "")

    sourced = grouped.select("conv", source.alias("source"), F.transform("ts", check).alias("checked"))
    # stages of the retry are columns of one row: no shuffle beyond the grouping
    first = sourced.withColumn("first", render(F.col("checked"), False)).withColumn("first_turns", parse(F.col("first")))
    second = first.withColumn("same", F.col("first_turns") == F.col("source")).withColumn(
        "formatted", F.when(F.col("same"), F.col("first")).otherwise(render(F.col("checked"), True))
    )
    read = second.withColumn("turns", F.when(F.col("same"), F.col("first_turns")).otherwise(parse(F.col("formatted"))))
    lost = F.raise_error(F.lit("a conversation does not survive its own template")).cast("string")
    n_hard = F.size(F.filter("checked", lambda t: t["hard"]))
    return read.select(
        F.col("conv").alias(conversation),
        F.when(F.col("turns") == F.col("source"), F.col("formatted")).otherwise(lost).alias("formatted"),
        "turns",
        F.when(F.col("same"), n_hard).otherwise(F.size("checked")).alias("n_escaped"),
    )


def loss_text(turns: Column) -> Column:
    """What the loss covers: every assistant text, in order, without the marks around it."""
    said = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.array_join(F.transform(said, lambda t: t["text"]), "")


def loss_spans(turns: Column, formatted: Column) -> Column:
    """Start and end in ``formatted`` (code points, end exclusive) of every assistant text as rendered.

    Read from the rendering itself: lengths of the parts between start marks, added up.
    """
    parts = F.transform(F.split(formatted, r"<\|im_start\|>"), lambda p: F.concat(F.lit(START), p))
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        head = F.char_length(F.substring_index(part, "\n", 1)) + F.lit(1)
        size = F.char_length(part)
        span = F.struct((state["at"] + head).alias("start"), (state["at"] + size - F.lit(len(END) + 1)).alias("end"))
        mine = F.startswith(part, F.lit(f"{START}assistant\n"))
        return F.struct(
            (state["at"] + size).alias("at"),
            F.when(mine, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(parts, zero, step, lambda s: s["spans"])
