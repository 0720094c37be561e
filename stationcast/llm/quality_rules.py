"""Quality rules whose cutoffs limit false rejection, certified on labelled documents.

Every rule compares one statistic with a cutoff. For a stratum (a language) and a rule,
the candidate cutoffs are tested from the loosest on: among the labelled good documents
of the stratum, ``k`` of ``n`` lie beyond the cutoff, and the hypothesis that the rule
rejects a share above its limit is refused if a binomial variable with that limit takes
a value of ``k`` or less with probability at most ``level / tests``. Testing stops at the
first cutoff that is not certified (a fixed sequence needs no correction inside itself),
and ``tests`` counts rules times strata, a Bonferroni correction. The limits of the rules
add up to ``risk``: with confidence ``1 - level`` no stratum loses more than that share of
its good documents. Of the certified cutoffs the loosest is taken that rejects nearly as
many bad documents as the strictest. Strata with too few labels get no cutoff and lose
nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.llm import text as tx
from stationcast.session import stage

RISK = 0.04
LEVEL = 0.05
#: Share of the bad documents that the strictest certified cutoff rejects, which is enough.
ENOUGH = 0.99
#: Candidate cutoffs, from loose to strict.
CUTOFFS = tuple(round(0.9 * 0.82**i, 5) for i in range(30))

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?")] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of them are not the first of their value."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def batch_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """All statistics of a batch of texts, computed over its bytes at once."""
    data, offsets = tx.batch_bytes(texts)
    n = len(offsets) - 1
    starts, ends, counts = tx.word_spans(data, offsets)
    words = tx.content_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), counts)
    salt = tx.mix64(np.arange(n, dtype=np.uint64) + np.uint64(1))
    # three-word windows; a text of fewer words has none
    covered = np.zeros(len(words), dtype=bool)
    if len(words) >= 3:
        whole = owner[2:] == owner[:-2]
        window = tx.mix64(tx.mix64(words[:-2] + np.uint64(1)) * np.uint64(3) + tx.mix64(words[1:-1] + np.uint64(2)) * np.uint64(5) + words[2:])
        at = np.flatnonzero(whole)
        twice, _ = _repeated(window[at] ^ salt[owner[at]])
        for k in range(3):
            covered[at[twice] + k] = True
    # lines: cut at line feeds and at the ends of texts
    feeds = np.flatnonzero(data == 10)
    line_ends = np.concatenate([feeds, offsets[1:]])
    line_owner = np.concatenate([np.searchsorted(offsets, feeds, side="right") - 1, np.arange(n)])
    # a text's first feed lies where the text before it ends, and an end comes after its own feeds
    order = np.lexsort((line_ends, line_owner))
    line_ends, line_owner = line_ends[order], line_owner[order]
    line_starts = np.empty_like(line_ends)
    if len(line_ends):
        line_starts[0] = 0
        line_starts[1:] = line_ends[:-1] + (np.isin(line_ends[:-1], feeds))
        first = np.ones(len(line_ends), dtype=bool)
        first[1:] = line_owner[1:] != line_owner[:-1]
        line_starts[first] = offsets[line_owner[first]]
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~tx._IS_SPACE[data], out=inside[1:])
    wordy = np.flatnonzero(inside[line_ends] > inside[line_starts])
    lines = tx.content_hashes(data, line_starts[wordy], line_ends[wordy]) ^ salt[line_owner[wordy]]
    _, later = _repeated(lines)
    lead = (data & 0xC0) != 0x80
    return {
        "n_words": counts,
        "word_chars": _per_text(lead & ~tx._IS_SPACE[data], offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_owner[wordy][later], minlength=n),
        "n_repeat_words": np.bincount(owner[covered], minlength=n),
        "n_lines": np.bincount(line_owner[wordy], minlength=n),
        "n_upper": _per_text(_UPPER[data], offsets),
        "n_letters": _per_text(_LETTER[data], offsets),
        "n_marks": _per_text(_MARK[data], offsets),
    }


def text_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``doc, stratum`` and the counts of ``STATS`` for every row; null texts count as empty."""
    schema = pa.schema([("doc", pa.int64()), ("stratum", pa.string()), *[(c, pa.int64()) for c in STATS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, "text", 2 << 20):
            found = batch_statistics(batch.column(2))
            yield tx.table_rows({"doc": batch.column(0), "stratum": batch.column(1), **found}, schema)

    named = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc"),
        F.col(f"`{stratum}`").cast("string").alias("stratum"),
        F.col(f"`{text}`").alias("text"),
    )
    return named.mapInArrow(run, "doc bigint, stratum string, " + ", ".join(f"{c} bigint" for c in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The statistic of each rule, larger being worse."""

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_upper", "n_letters"),
        "marks": share("n_marks", "word_chars"),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for a binomial variable of ``n`` trials; only needed below the mean, else 1."""
    if k >= n * p:
        return 1.0
    i = np.arange(k, dtype=float)
    steps = np.log(n - i) - np.log(i + 1) + math.log(p) - math.log1p(-p)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def choose_cutoff(good: list[int], bad: list[int], n_good: int, limit: float, level: float) -> int | None:
    """Index of the cutoff; ``good[i]`` and ``bad[i]`` are the documents beyond cutoff ``i``."""
    certified = -1
    for i, k in enumerate(good):
        if n_good == 0 or binomial_tail(int(k), n_good, limit) > level:
            break
        certified = i
    if certified < 0 or bad[certified] == 0:
        return None
    need = ENOUGH * bad[certified]
    return next(i for i in range(certified + 1) if bad[i] >= need)


def certified_cutoffs(stats: DataFrame, labels: DataFrame, *, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``stratum, rule, cutoff`` from the labelled documents that pass the base rules.

    ``labels`` has ``doc, good``. The labelled rows are counted by stratum, rule and place
    among the cutoffs inside tasks; only those counts meet.
    """
    names = rules()
    place = {r: sum(((x <= c).cast("int") for c in CUTOFFS[1:]), (x <= CUTOFFS[0]).cast("int")) for r, x in names.items()}
    marks = F.array(*[F.struct(F.lit(r).alias("rule"), place[r].alias("place")) for r in names])
    counts = (
        stats.filter(~base_failed())
        .join(labels, "doc")
        .select("stratum", "good", F.explode(marks).alias("m"))
        .groupBy("stratum", "m.rule", "m.place")
        .agg(F.sum(F.col("good").cast("bigint")).alias("good"), F.sum((~F.col("good")).cast("bigint")).alias("bad"))
    )
    counts = stage(counts, "rule-counts")
    n_strata = counts.select("stratum").distinct().count()
    limit, each = risk / len(names), level / max(1, n_strata * len(names))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(len(CUTOFFS) + 1, dtype=np.int64), np.zeros(len(CUTOFFS) + 1, dtype=np.int64)
        np.add.at(good, group["place"].to_numpy(), group["good"].to_numpy())
        np.add.at(bad, group["place"].to_numpy(), group["bad"].to_numpy())
        # place counts the cutoffs not exceeded: beyond cutoff i are the places up to i
        at = choose_cutoff(np.cumsum(good)[:-1].tolist(), np.cumsum(bad)[:-1].tolist(), int(good.sum()), limit, each)
        first = group.iloc[: 0 if at is None else 1]
        names = {c: pd.Series([None if pd.isna(x) else str(x) for x in first[c]], dtype=object) for c in ("stratum", "rule")}
        return pd.DataFrame({**names, "cutoff": pd.Series([] if at is None else [CUTOFFS[at]], dtype=float)})

    return counts.groupBy("stratum", "rule").applyInPandas(pick, "stratum string, rule string, cutoff double")


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", **limits) -> DataFrame:
    """``key, stratum``, the statistics, ``base_failed``, ``failed`` (rules beyond their cutoff) and ``kept``.

    ``labels`` has ``key`` and ``good``. Null texts are empty, a null stratum is one of its
    own, repeated rows are judged each, further columns are not read. Without labels, or
    with too few, only the base rules decide. An empty table gives an empty result.
    """
    stats = stage(text_statistics(docs, key=key, text=text, stratum=stratum), "text-statistics")
    known = labels.select(F.col(f"`{key}`").alias("doc"), F.col("good").cast("boolean").alias("good")).filter("good is not null")
    cutoffs = certified_cutoffs(stats, known, **limits)
    per = stage(
        cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")).select(
            F.col("stratum").alias("of"), "cutoffs"
        ),
        "cutoffs",
    )
    few = per.limit(10_001).count() <= 10_000
    joined = stats.join(F.broadcast(per) if few else per, F.col("stratum").eqNullSafe(F.col("of")), "left")
    beyond = F.array_compact(
        F.array(*[F.when(x > F.element_at("cutoffs", r), F.lit(r)) for r, x in rules().items()])
    )
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("failed", F.coalesce(beyond, F.array().cast("array<string>")))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
        .select(F.col("doc").alias(key), "stratum", *STATS, "base_failed", "failed", "kept")
    )
