"""Toxicity: two Kneser-Ney models, one of toxic and one of ordinary texts, compared.

The models predict each byte of a text (A-Z lower-cased, white space as one space) from the
four before it. Both count five-byte strings in all labelled texts of their class; Spark adds
the counts up. Lower orders use Kneser-Ney continuation counts, the number of different
bytes that a string follows. The two lowest orders are counted over both classes together:
expressions that neither class knows well fall back to the same shared counts and say
nothing about the class.

A text's figure is the difference of its two log-likelihoods divided by a power of its
length: by the length itself short texts scatter more than long ones, by its square root a
slight lean of the models adds up in very long texts. The power, the figure where the score
is 0.5, and the slope there come from labelled texts that the models have not counted.

Counts grow with the labelled texts, and both models hold all of them, as tables that Spark
smooths order by order. What is sent to the tasks is bounded: the most frequent string of
each slot of a table of fixed size, and the most frequent of the others and of the contexts.
Strings of a text that these leave open are looked up in the whole tables by a join, so a
score does not depend on what fits.

Defined results: null and empty texts get the score of a figure of zero; a null key has no
label; a key with two labels counts with both; repeated rows count each; without labelled
texts of both classes the score is the share of toxic labels (0.5 without any). Keys are cast
to bigint, and text that is no number raises. An existing score column is replaced, others
stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationcast.llm import text as tx
from stationcast.llm.jaccard import text_digest
from stationcast.session import stage

ORDER = 5
#: Orders up to this one are counted over both classes together.
SHARED = 2
#: Slots of the table of each order: primes for hashed orders, all byte strings for the lowest.
SLOTS = {1: 1 << 8, 2: 1 << 16, 3: 262_139, 4: 1_048_573, 5: 1_048_573}
#: Strings without a slot of their own, and contexts, that are sent along for each order, at most.
MOST_MORE = 1 << 20
#: Labelled texts that the cut is chosen on, at most, and one of how many labelled texts is set aside.
MOST_CUT_ROWS, CUT_SHARE = 8192, 4
#: Labels that are broadcast, by a count; more are joined by a shuffle.
FEW_LABELS = 1_000_000
#: Powers of the length to choose from.
POWERS = (0.5, 0.625, 0.75, 0.875, 1.0)
#: Different strings held by a counting task, and bytes looked at together.
_HELD, _STEP = 1 << 21, 1 << 20


def plain_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one array of bytes, a zero before each, and the places of the zeros.

    A-Z are lower-cased; runs of white space (zeros too) are one space; none is at an end.
    """
    data, offsets = tx.batch_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = tx._IS_SPACE[data] | (data == 0)
    data = np.where(space, np.uint8(32), data)
    marked = np.insert(data, offsets[:-1], 0)
    gap = np.insert(space, offsets[:-1], True)
    keep = ~gap | (marked == 0)
    # a space stays where a word ended just before it and another follows in the same text
    stays = gap & (marked != 0)
    stays[1:] &= ~gap[:-1]
    keep |= stays
    out = marked[keep]
    last = np.zeros(len(out), dtype=bool)
    last[:-1] = (out[:-1] == 32) & (out[1:] == 0)
    if len(out):
        last[-1] = out[-1] == 32
    out = out[~last]
    return out, np.flatnonzero(out == 0)


def strings(stream: np.ndarray, zeros: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of text in the part, and the ``ORDER`` bytes ending at each, those before its text zero."""
    at = np.arange(begin, end)
    since = at - zeros[np.searchsorted(zeros, at, side="right") - 1]
    at, since = at[since > 0], since[since > 0]
    found = np.zeros(len(at), dtype=np.uint64)
    for back in range(ORDER):
        inside = since >= back
        found[inside] |= stream[at[inside] - back].astype(np.uint64) << np.uint64(8 * back)
    return at, found


def count_strings(rows: DataFrame) -> DataFrame:
    """``key, ordinary, toxic``: how often each five-byte string ends in the texts of ``rows`` (``text, toxic``)."""
    schema = pa.schema([("key", pa.int64()), ("ordinary", pa.int64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in tx.small_batches(batches, 0):
            stream, zeros = plain_stream(batch.column(0))
            toxic = np.array(batch.column(1).to_pylist(), dtype=bool)
            for begin in range(0, len(stream), 4 * _STEP):
                at, found = strings(stream, zeros, begin, min(begin + 4 * _STEP, len(stream)))
                kind = toxic[np.searchsorted(zeros, at) - 1]
                new, times = np.unique(found << np.uint64(1) | kind, return_counts=True)
                keys, counts = added(np.concatenate([keys, new]), np.concatenate([counts, times]))
                if len(keys) > _HELD:
                    yield rows_of(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield rows_of(keys, counts)

    def rows_of(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        toxic = (keys & np.uint64(1)).astype(bool)
        return tx.table_rows(
            {"key": (keys >> np.uint64(1)).astype(np.int64), "ordinary": np.where(toxic, 0, counts), "toxic": np.where(toxic, counts, 0)},
            schema,
        )

    found = rows.select("text", "toxic").mapInArrow(run, "key bigint, ordinary bigint, toxic bigint")
    return found.groupBy("key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, where = np.unique(keys, return_inverse=True)
    return one, np.bincount(where, weights=counts, minlength=len(one)).astype(np.int64)


@dataclass(frozen=True)
class Level:
    """What tasks hold of one order: strings by slot (``key``, -1 where empty, and ``ratio``), others in order
    (``more``), contexts in order (``context``, ``backoff``); and whether these are all strings, all contexts."""

    key: np.ndarray
    ratio: np.ndarray
    context: np.ndarray
    backoff: np.ndarray
    more: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    more_ratio: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    all_strings: bool = True
    all_contexts: bool = True


#: Of one order all strings (``key, times, ratio``) and all contexts (``context, times, backoff``).
Tables = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Model:
    """``tables`` are given where the levels do not hold all of them."""

    levels: tuple[Level, ...]
    power: float = 1.0
    cut: float = 0.0
    slope: float = 1.0
    tables: tuple[Tables, ...] = ()

    def ratios(self, found: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of the last byte of each string, after the others."""
        return self.settled(found)[0]

    def settled(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, zero for strings that the levels leave open, and which these are."""
        out, unknown = np.zeros(len(found)), np.zeros(len(found), dtype=bool)
        todo, left = np.arange(len(found)), found.astype(np.int64)
        for k in range(len(self.levels), 0, -1):
            level = self.levels[k - 1]
            left = left & ((1 << 8 * k) - 1)
            slot = left % len(level.key)
            hit = level.key[slot] == left
            out[todo[hit]] += level.ratio[slot[hit]]
            taken = level.key[slot[~hit]] >= 0  # an empty slot has no string at all
            todo, left = todo[~hit], left[~hit]
            if len(level.more):
                at = np.minimum(np.searchsorted(level.more, left), len(level.more) - 1)
                hit = level.more[at] == left
                out[todo[hit]] += level.more_ratio[at[hit]]
                todo, left, taken = todo[~hit], left[~hit], taken[~hit]
            if not len(todo):
                break
            if not level.all_strings:
                unknown[todo[taken]] = True
                todo, left = todo[~taken], left[~taken]
            if not level.all_contexts:
                known = np.isin(left >> 8, level.context)
                unknown[todo[~known]] = True
                todo, left = todo[known], left[known]
            out[todo] += looked_up(level.context, level.backoff, left >> 8)
        out[unknown] = 0
        return out, unknown

    def differences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Differences of the texts' log-likelihoods and their lengths; text and string of every place left open."""
        stream, zeros = plain_stream(texts)
        total, n = np.zeros(len(zeros)), np.zeros(len(zeros), dtype=np.int64)
        owners, opens = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for begin in range(0, len(stream), _STEP):
            at, found = strings(stream, zeros, begin, min(begin + _STEP, len(stream)))
            owner = np.searchsorted(zeros, at) - 1
            values, unknown = self.settled(found)
            total += np.bincount(owner, weights=values, minlength=len(zeros))
            n += np.bincount(owner, minlength=len(zeros))
            owners.append(owner[unknown])
            opens.append(found[unknown].astype(np.int64))
        return total, n, np.concatenate(owners), np.concatenate(opens)


def normalised(total: np.ndarray, n: np.ndarray, power: float) -> np.ndarray:
    return total / np.maximum(n, 1) ** power


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys, 0 where there is none; ``keys`` is in order."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def orders(counts: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """``key, ordinary, toxic`` from the highest order down; lower ones count what their strings follow."""
    level = counts
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            shorter = F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))
            kinds = {c: F.count(F.when(F.col(c) > 0, 1)) for c in ("ordinary", "toxic")}
            if k <= SHARED:
                kinds = dict.fromkeys(kinds, F.count(F.lit(1)))
            level = stage(level.groupBy(shorter.alias("key")).agg(*[x.alias(c) for c, x in kinds.items()]), f"strings-{k}")
        yield k, level


def kept_strings(level: DataFrame, k: int) -> DataFrame:
    """The most frequent string of each slot, with the totals of its context over all strings; for ``fit`` alone."""
    context = F.shiftright("key", 8)
    same = Window.partitionBy(context)  # at most 256 rows
    whole = level.select(
        "key", "ordinary", "toxic", F.sum("ordinary").over(same).alias("all_ordinary"), F.sum("toxic").over(same).alias("all_toxic")
    )
    best = F.max_by(F.struct("*"), F.struct(F.col("ordinary") + F.col("toxic"), "key"))
    return whole.groupBy((F.col("key") % SLOTS[k]).alias("slot")).agg(best.alias("s")).select("s.*")


def fit(counts: DataFrame) -> tuple[Level, ...]:
    """Levels of bounded size without tables beside them: strings that lose their slot go to the lower order.

    ``train`` does not use it; its models hold every string. The driver holds at most ``SLOTS`` rows of each order.
    """
    names = ("ordinary", "toxic")
    tables = {}
    for k, level in orders(stage(counts, "strings")):
        seen = level.agg(*[F.count(F.when(F.col(c) == n, 1)).alias(f"{c}{n}") for c in names for n in (1, 2)]).first()
        rows = kept_strings(level, k).toArrow()
        columns = {c: rows[c].to_numpy().astype(np.int64) for c in rows.column_names}
        by = np.argsort(columns["key"])
        off = []
        for c in names:
            once, twice = seen[f"{c}1"], seen[f"{c}2"]
            off.append(min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5)
        tables[k] = {c: x[by] for c, x in columns.items()} | {"off": off}
    return bounded(tables)


def bounded(tables: dict[int, dict]) -> tuple[Level, ...]:
    """Interpolated Kneser-Ney, order by order from the lowest; what a string does not keep goes to the order below."""
    levels: list[Level] = []
    known: list[tuple] = []  # of each order: keys, probabilities of both classes, contexts, their backoff masses

    def chances(wanted: np.ndarray, k: int) -> np.ndarray:
        """Probabilities of the last bytes by the models of order ``k``, for both classes."""
        if k == 0:
            return np.full((2, len(wanted)), 1 / 256)
        keys, probability, contexts, mass = known[k - 1]
        wanted = wanted & ((1 << 8 * k) - 1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        out = np.empty((2, len(wanted)))
        out[:, hit] = probability[:, at[hit]]
        rest = wanted[~hit]
        if len(rest):
            c = np.minimum(np.searchsorted(contexts, rest >> 8), len(contexts) - 1)
            out[:, ~hit] = np.where(contexts[c] == rest >> 8, mass[:, c], 1.0) * chances(rest, k - 1)
        return out

    for k in range(1, ORDER + 1):
        t = tables[k]
        contexts, which = np.unique(t["key"] >> 8, return_inverse=True)
        own, mass = np.zeros((2, len(t["key"]))), np.ones((2, len(contexts)))
        for c, name in enumerate(("ordinary", "toxic")):
            own[c] = np.maximum(t[name] - t["off"][c], 0) / np.maximum(t[f"all_{name}"], 1)
            mass[c] = np.maximum(1 - np.bincount(which, own[c], len(contexts)), 1e-9)
        probability = own + mass[:, which] * chances(t["key"], k - 1)
        known.append((t["key"], probability, contexts, mass))
        key, ratio = np.full(SLOTS[k], -1, dtype=np.int64), np.zeros(SLOTS[k], dtype=np.float32)
        slot = t["key"] % SLOTS[k]
        key[slot] = t["key"]
        ratio[slot] = np.log(probability[1]) - np.log(probability[0])
        levels.append(Level(key, ratio, contexts, np.log(mass[1]) - np.log(mass[0])))
    return tuple(levels)


def slot_winners(table: DataFrame, k: int) -> DataFrame:
    """The most frequent string of each slot; ``Level.more`` and the whole table have the others."""
    best = F.max_by(F.struct("key", "ratio"), F.struct("times", "key"))
    return table.groupBy((F.col("key") % SLOTS[k]).alias("slot")).agg(best.alias("s")).select("s.*")


def smoothed(counts: DataFrame) -> tuple[Tables, ...]:
    """Interpolated Kneser-Ney, order by order from the lowest; what the strings of a context give up goes to the order below."""
    names = ("ordinary", "toxic")
    by_order = dict(orders(stage(counts, "strings")))
    out: list[Tables] = []
    lower = None
    for k in range(1, ORDER + 1):
        level = by_order[k]
        seen = level.agg(*[F.count(F.when(F.col(c) == n, 1)).alias(f"{c}{n}") for c in names for n in (1, 2)]).first()
        off = {}
        for c in names:
            once, twice = seen[f"{c}1"], seen[f"{c}2"]
            off[c] = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5

        def given_up(c: str) -> Column:
            """Every string of the context gives up the same; a class without the context all of it."""
            return F.greatest(F.when(F.col(f"all_{c}") > 0, F.lit(off[c]) * F.col(f"kinds_{c}") / F.col(f"all_{c}")).otherwise(1.0), F.lit(1e-9))

        sums = [F.sum(c).alias(f"all_{c}") for c in names] + [F.count(F.when(F.col(c) > 0, 1)).alias(f"kinds_{c}") for c in names]
        grouped = level.groupBy(F.shiftright("key", 8).alias("context")).agg(*sums)
        contexts = grouped.select("*", *[given_up(c).alias(f"mass_{c}") for c in names], (F.col("all_ordinary") + F.col("all_toxic")).alias("times"))
        contexts = stage(contexts.withColumn("backoff", F.log("mass_toxic") - F.log("mass_ordinary")), f"contexts-{k}")
        rows = level.withColumn("context", F.shiftright("key", 8)).join(contexts.drop("times"), "context")
        if lower is None:
            rows = rows.select("*", *[F.lit(1 / 256).alias(f"below_{c}") for c in names])
        else:
            below = lower.select(F.col("key").alias("shorter"), *[F.col(f"chance_{c}").alias(f"below_{c}") for c in names])
            rows = rows.join(below, F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == F.col("shorter"))

        def chance(c: str) -> Column:
            own = F.greatest(F.col(c) - F.lit(off[c]), F.lit(0.0)) / F.greatest(F.col(f"all_{c}"), F.lit(1))
            return own + F.col(f"mass_{c}") * F.col(f"below_{c}")

        rows = rows.select("key", (F.col("ordinary") + F.col("toxic")).alias("times"), *[chance(c).alias(f"chance_{c}") for c in names])
        lower = stage(rows.withColumn("ratio", F.log("chance_toxic") - F.log("chance_ordinary")), f"smoothed-{k}")
        out.append((lower.select("key", "times", "ratio"), contexts.select("context", "times", "backoff")))
    return tuple(out)


def held(table: DataFrame, contexts: DataFrame, k: int) -> Level:
    """The driver and the tasks hold at most ``SLOTS`` and twice ``MOST_MORE`` rows of an order."""

    def columns(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        arrow = rows.toArrow()
        keys, values = (arrow[c].to_numpy() for c in rows.columns)
        order = np.argsort(keys)
        return keys[order].astype(np.int64), values[order].astype(np.float64)

    best = stage(slot_winners(table, k), f"kept-{k}")
    first, ratios = columns(best)
    others = table.join(best.select("key"), "key", "left_anti")
    more, more_ratio = columns(others.orderBy(F.desc("times"), "key").limit(MOST_MORE).select("key", "ratio"))
    context, backoff = columns(contexts.orderBy(F.desc("times"), "context").limit(MOST_MORE).select("context", "backoff"))
    key, ratio = np.full(SLOTS[k], -1, dtype=np.int64), np.zeros(SLOTS[k], dtype=np.float32)
    slot = first % SLOTS[k]
    key[slot], ratio[slot] = first, ratios
    complete = table.count() == len(first) + len(more), contexts.count() == len(context)
    return Level(key, ratio, context, backoff, more, more_ratio.astype(np.float32), *complete)


def levels_of(tables: tuple[Tables, ...]) -> tuple[Level, ...]:
    return tuple(held(*t, k) for k, t in enumerate(tables, 1))


def choose_cut(figures: np.ndarray, toxic: np.ndarray) -> tuple[int, float, float]:
    """Labelled texts on the wrong side of the best cut, the cut, and a slope that puts the classes' medians far from it."""
    order = np.argsort(-figures, kind="stable")
    x, t = figures[order], toxic[order]
    wrong = np.concatenate([[t.sum()], t.sum() - np.cumsum(t) + np.cumsum(~t)])
    wrong[1:-1][x[1:] == x[:-1]] = len(t) + 1  # no cut between equal figures
    at = int(np.argmin(wrong))
    cut = x[0] + 1e-9 if at == 0 else x[-1] - 1e-9 if at == len(x) else (x[at - 1] + x[at]) / 2
    apart = abs(np.median(figures[toxic]) - np.median(figures[~toxic]))
    return int(wrong[at]), float(cut), float(max(apart / 8, 1e-6))


def best_power(total: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Power, cut and slope with fewest texts on the wrong side."""
    found = [(*choose_cut(normalised(total, n, p), toxic), p) for p in POWERS]
    _, cut, slope, power = min(found, key=lambda f: f[0])
    return power, cut, slope


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> Model:
    """Both models from all labelled documents; ``labels`` has ``key`` and ``toxic`` (boolean).

    One of ``CUT_SHARE`` labelled documents, at most ``MOST_CUT_ROWS``, is not counted: the
    cut is chosen on these.
    """
    known = labels.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col("toxic").cast("boolean").alias("toxic"))
    known = known.filter("doc is not null and toxic is not null")
    order = F.xxhash64("doc")
    aside = known.filter(F.pmod(order, F.lit(CUT_SHARE)) == 0).select("doc").distinct()
    aside = F.broadcast(stage(aside.orderBy(F.xxhash64("doc"), "doc").limit(MOST_CUT_ROWS), "cut-rows"))
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    rest = known.join(aside, "doc", "left_anti")
    # texts need not move to labels that every task can hold
    few = known.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    counted = stage(count_strings(texts.join(F.broadcast(rest) if few else rest, "doc")), "string-counts")
    totals = counted.agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).first()
    if not totals["ordinary"] or not totals["toxic"]:
        share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        share = 0.5 if share is None else min(max(share, 0.01), 0.99)
        return Model((), cut=-float(np.log(share / (1 - share))))
    tables = smoothed(counted)
    levels = levels_of(tables)
    whole = all(level.all_strings and level.all_contexts for level in levels)
    model = Model(levels, tables=() if whole else tables)
    cut_rows = F.broadcast(known.join(aside, "doc").distinct())  # at most two labels a key
    found = measured(texts.join(cut_rows, "doc").select("toxic", "text"), model, "text").select("toxic", "_total", "_n").toArrow()
    toxic = found["toxic"].to_numpy(zero_copy_only=False).astype(bool)
    if toxic.all() or not toxic.any():
        return model
    power, cut, slope = best_power(found["_total"].to_numpy(), found["_n"].to_numpy(), toxic)
    return replace(model, power=power, cut=cut, slope=slope)


def measured(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """``rows`` with ``_total`` and ``_n``: the difference of a text's log-likelihoods, and its length."""
    if model.tables:
        return _measured_by_join(rows, model, text)
    at = rows.columns.index(text)
    sent = rows.sparkSession.sparkContext.broadcast(model)  # its size is bounded by SLOTS and MOST_MORE
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _total double, _n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, at, 2 << 20):
            total, n, _, _ = sent.value.differences(batch.column(at))
            columns = [*batch.columns, pa.array(total, type=pa.float64()), pa.array(n, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_total", "_n"])

    return rows.mapInArrow(run, out)


def _measured_by_join(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """The same for a model that tasks hold in part: strings left open come from its tables, once for each different text."""
    sent = rows.sparkSession.sparkContext.broadcast(replace(model, tables=()))
    schema = pa.schema(
        [("digest", pa.binary()), ("total", pa.float64()), ("_n", pa.int64()), ("open", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, 1, 2 << 20):
            total, n, owner, found = sent.value.differences(batch.column(1))
            order = np.lexsort((found, owner))
            owner, found = owner[order], found[order]
            new = np.ones(len(found), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
            first = np.flatnonzero(new)
            places = np.diff(np.append(first, len(found)))
            ends = np.append(0, np.cumsum(np.bincount(owner[first], minlength=len(n)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, type=pa.int64())) for x in (found[first], places)]
            yield tx.table_rows({"digest": batch.column(0), "total": total, "_n": n, "open": lists[0], "places": lists[1]}, schema)

    named = rows.select(text_digest(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text"))
    said = named.mapInArrow(run, "digest binary, total double, _n bigint, open array<bigint>, places array<bigint>")
    texts = stage(said, "text-figures").dropDuplicates(["digest"])  # equal texts have equal figures
    left = texts.select("digest", F.explode(F.arrays_zip("open", "places")).alias("s")).select("digest", F.col("s.open").alias("string"), "s.places")
    values = _from_tables(left.select("string").distinct(), model.tables)
    # whole numbers add up the same in any order
    sums = left.join(values, "string").groupBy("digest").agg((F.sum(F.round(F.col("value") * 2.0**32).cast("bigint") * F.col("places")) / 2.0**32).alias("rest"))
    figures = texts.join(sums, "digest", "left").select(
        F.col("digest").alias("_digest"), (F.col("total") + F.coalesce("rest", F.lit(0.0))).alias("_total"), "_n"
    )
    return rows.withColumn("_digest", text_digest(F.col(f"`{text}`"))).join(figures, "_digest").drop("_digest")


def _from_tables(wanted: DataFrame, tables: tuple[Tables, ...]) -> DataFrame:
    """``string, value``: the log-ratio of every wanted string by all orders of the whole model."""
    rows = wanted.select("string", F.lit(0.0).alias("value"), F.lit(False).alias("found"))
    for k in range(len(tables), 0, -1):
        table, contexts = tables[k - 1]
        last = F.col("string").bitwiseAND(F.lit((1 << 8 * k) - 1))
        rows = rows.join(table.select("key", "ratio"), last == F.col("key"), "left")
        rows = rows.join(contexts.select("context", "backoff"), F.shiftright(last, 8) == F.col("context"), "left")
        more = F.when(~F.col("found"), F.coalesce("ratio", "backoff", F.lit(0.0))).otherwise(0.0)
        rows = rows.select("string", (F.col("value") + more).alias("value"), (F.col("found") | F.col("ratio").isNotNull()).alias("found"))
    return rows.select("string", "value")


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, 0 to 1, higher for toxic texts."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    rows = measured(docs.select(*[F.col(f"`{c}`") for c in kept]), model, text)
    figure = F.col("_total") / F.pow(F.greatest("_n", F.lit(1)), F.lit(model.power))
    steps = F.greatest(F.least((figure - F.lit(model.cut)) / F.lit(model.slope), F.lit(50.0)), F.lit(-50.0))
    return rows.select(*[F.col(f"`{c}`") for c in kept], (1 / (1 + F.exp(-steps))).alias(name))
