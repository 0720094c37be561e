"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target in words. A document's expected number of copies is the
target over the source's size; its whole part is allocated with certainty, the
fraction ``p`` by sampling: every document draws ``u`` from a hash of its id and is
ranked by ``(u / (1 - u)) / (p / (1 - p))``, random odds over inclusion odds. The
smallest ranks are taken until the source's remaining words are met, so the sample
has a fixed size in words, the cut being the one nearest to the target.

An optional weight makes the inclusion probabilities inside a source unequal: the
expected copies are then in proportion to it, limited to ``most_copies``.

Nothing is sorted by source. Ranks are binned, the words of a bin added up inside
each task, and the running totals taken over bins; only the bin in which a source's
cut falls is put in order, a share of about ``1 / bins`` of that source. What comes out
is one cut per source, and every document is compared with its source's cut where it
is: texts are neither moved nor joined by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationcast.llm.text import word_count
from stationcast.session import stage

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BINS = 4096
#: Tables of one row per source are broadcast up to this many rows.
FEW_SOURCES = 10_000
#: Hexadecimal digits of the draw; 13 digits are 52 bits, exact in a double.
_DIGITS = 13


def uniform_draw(key: Column, seed: str) -> Column:
    """A number in (0, 1) that follows from the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    whole = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
    return (whole + F.lit(0.5)) / F.lit(float(16**_DIGITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` for a table of ``source, size``.

    Sources share the total in proportion to their weights; a target stops at ``most``
    times its source's size and the excess is shared anew. Sources reach their limit in
    the order of limit over weight, so the shares follow from running sums over that
    order. The table has one row per source; nothing here sees documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    ranked = (
        per.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("at", F.col("limit") / F.col("weight"))
    )
    by = Window.orderBy("at", "place")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("at", "place")
    level = (F.col("total") - F.col("limits")) / (F.col("weights") - F.col("used"))
    return (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("limits", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level)
        # the first source that stays below its limit sets the level of all after it
        .withColumn("stays", F.when(F.col("level") < F.col("at"), F.col("level")))
        .withColumn("final", F.first("stays", ignorenulls=True).over(everything))
        .withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("final"), F.col("limit"))))
        .select("source", "source_size", "target")
    )


def cut_ranks(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    seed: str = "mix",
    bins: int = BINS,
) -> tuple[DataFrame, DataFrame]:
    """The narrow table of all rows, and one row per source that decides its copies.

    The decision holds ``owner, source_size, target, rate`` and the cut: rows whose
    ``(rank, key, size)`` is at most ``(cut.rank, cut.key, cut.size)`` get one copy more.
    """
    sized = stage(docs.select(*_named(key, text, source, weight)), "mix-sizes")  # one pass over the texts
    tilted = sized.groupBy("source").agg(F.sum(F.col("tilt") * F.col("size")).alias("tilted"))
    decided = (
        source_targets(sized, weights, most_copies)
        .withColumnRenamed("source", "owner")
        .join(tilted, F.col("owner").eqNullSafe(F.col("source")))
        .select(
            "owner",
            "source_size",
            "target",
            F.when(F.col("tilted") > 0, F.col("target") / F.col("tilted")).otherwise(F.lit(0.0)).alias("rate"),
        )
    )
    decided = stage(decided, "mix-targets")
    ranked = _ranked(attach(sized, decided), most_copies, seed).withColumn(
        "bin", F.floor(F.col("rank") / (1 + F.col("rank")) * bins).cast("int")
    )
    binned = ranked.groupBy("owner", "bin").agg(
        F.sum("size").alias("words"),
        F.sum(F.col("sure") * F.col("size")).alias("given"),
        F.first("target").alias("target"),
    )
    per_source = Window.partitionBy("owner")
    earlier = per_source.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut_bins = (
        binned.withColumn("wanted", F.col("target") - F.sum("given").over(per_source))
        .withColumn("before", F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("words"))).over(earlier), F.lit(0)))
        # the last bin that begins before the wanted words are reached
        .filter(F.col("bin").isNotNull() & (F.col("before") < F.col("wanted")))
        .groupBy("owner")
        .agg(F.max_by(F.struct("bin", "before", "wanted"), "bin").alias("at"))
        .select(F.col("owner").alias("cut_owner"), F.col("at.bin").alias("cut_bin"), "at.before", "at.wanted")
    )
    # rows that agree in everything are one row here, so that many of them stay few
    last = (
        ranked.join(cut_bins, F.col("owner").eqNullSafe(F.col("cut_owner")) & (F.col("bin") == F.col("cut_bin")))
        .groupBy("owner", "rank", "key", "size")
        .agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("wanted").alias("wanted"))
        .withColumn(
            "so_far",
            F.col("before")
            + F.coalesce(
                F.sum("words").over(
                    per_source.orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        # nearest cut: with the row the total is not further away than without it
        .filter(F.col("wanted") - F.col("so_far") >= F.col("words") / F.lit(2.0))
        .groupBy("owner")
        .agg(F.max(F.struct("rank", "key", "size")).alias("cut"))
        .select(F.col("owner").alias("last_owner"), "cut")
    )
    # if no row of the bin is taken, the cut lies at the end of the bin before
    plan = (
        decided.join(cut_bins.select("cut_owner", "cut_bin"), F.col("owner").eqNullSafe(F.col("cut_owner")), "left")
        .join(last, F.col("owner").eqNullSafe(F.col("last_owner")), "left")
        .select("owner", "source_size", "target", "rate", "cut_bin", "cut")
    )
    return sized, stage(plan, "mix-plan")


def _named(key: str, text: str, source: str, weight: str | None) -> list[Column]:
    tilt = F.greatest(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(1.0)), F.lit(1e-9)) if weight else F.lit(1.0)
    return [
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        tilt.alias("tilt"),
    ]


def attach(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with their source's decision; broadcast only if the table was counted and is small.

    Otherwise it is a join by source, whose large partitions Spark splits at run time.
    """
    few = per_source.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return rows.join(F.broadcast(per_source) if few else per_source, F.col("source").eqNullSafe(F.col("owner")))


def _ranked(rows: DataFrame, most_copies: int, seed: str) -> DataFrame:
    """Certain copies ``sure``, and ``rank``, null where nothing is left to chance."""
    expected = F.least(F.col("rate") * F.col("tilt"), F.lit(float(most_copies)))
    near = F.round(F.col("expected"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    return (
        rows.withColumn("expected", expected)
        # a rate that is whole but for rounding is whole
        .withColumn("expected", F.when(F.abs(F.col("expected") - near) < 1e-12, near).otherwise(F.col("expected")))
        .withColumn("sure", F.floor("expected").cast("bigint"))
        .withColumn("part", F.col("expected") - F.col("sure"))
        .withColumn("u", uniform_draw(F.col("key"), seed))
        .withColumn("rank", F.when((F.col("part") > 0) & (F.col("size") > 0), odds))
    )


def _copies(ranked: DataFrame, bins: int) -> DataFrame:
    own = F.struct("rank", "key", "size")
    taken = F.when(F.col("cut").isNotNull(), own <= F.col("cut")).otherwise(
        F.floor(F.col("rank") / (1 + F.col("rank")) * bins) < F.col("cut_bin")
    )
    return ranked.withColumn("copies", F.col("sure") + F.coalesce((F.col("rank").isNotNull() & taken).cast("bigint"), F.lit(0)))


def mix_copies(docs: DataFrame, *, bins: int = BINS, **options) -> DataFrame:
    """``key, source, size, source_size, target, copies`` per row of ``docs``.

    Null texts have size 0; documents without words get the certain copies alone. A
    null source is a source of its own, the last one. Rows that agree in id and size
    are taken together. Columns beyond the named ones are not read. An empty table
    gives an empty result.
    """
    sized, plan = cut_ranks(docs, bins=bins, **options)
    ranked = _ranked(attach(sized, plan), options.get("most_copies", MOST_COPIES), options.get("seed", "mix"))
    return _copies(ranked, bins).select("key", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, *, bins: int = BINS, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, same columns."""
    _, plan = cut_ranks(docs, bins=bins, **options)
    names = [options.get(k, d) for k, d in (("key", "doc_id"), ("text", "text"), ("source", "source"))]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, *_named(*names, options.get("weight")))
    ranked = _ranked(attach(rows, plan), options.get("most_copies", MOST_COPIES), options.get("seed", "mix"))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return _copies(ranked, bins).filter(F.col("copies") > 0).select("row", times.alias("time")).select("row.*")
