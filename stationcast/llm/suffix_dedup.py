"""Removal of long repeated byte strings by longest-previous-factor arrays.

A byte position is a *repeat* if the ``length`` bytes from it also start elsewhere, and a
*later copy* if they also start at a smaller position, positions being ordered by
document and place; the longest previous factor (LPF) of a position is at least
``length`` exactly then. LPF values come from the suffix order: the longest earlier match
of a position is with the previous or next smaller position in that order. Only matches
of ``length`` bytes count: in a run of suffixes that agree on so many, ordered by
position, the previous smaller position is the row before.

One suffix array of a whole corpus fits no machine, so matches are first made local. In
every window of ``length`` bytes the smallest hash of its ``k``-byte strings is an
*anchor*; equal windows have equal anchors at the same place, so all matches of a window
are found at anchors whose ``k`` bytes agree. Anchors whose bytes occur nowhere else are
dropped after one shuffle, before anything else is stored or moved. Around an anchor lies its context, all
windows that contain it. Contexts that are equal as a whole are one class, found by a
count that every task pre-aggregates: long copies, however many, cost no comparison, and
a class is represented by its smallest position. Only where an anchor has several
classes are their contexts collected, by anchor, and ordered in blocks: as suffixes from
the anchor on, and backwards from it. The longest common prefixes of neighbours in either
order give, for every offset of a window, the runs of contexts that agree so far, and a
window's matches are those in its run of both. So the contexts are sorted, and not all
their bytes as suffixes. Anchors with very many classes are dealt by more of the bytes
that windows have in common, each part of the windows by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationcast.llm import text as tx
from stationcast.session import stage

LENGTH = 400
#: Contexts of one anchor that are ordered in one block.
TILE = 4096
#: Parts of the windows around an anchor that has more.
PARTS = 4
_BLOCK_BYTES = 1 << 20
_FEW = 500_000


def window_of(length: int) -> int:
    """Starts of a window among which its anchor is chosen: a power of two near two thirds of the length."""
    return 1 << ((2 * length // 3).bit_length() - 1)


# --- anchors ------------------------------------------------------------------------


def anchors(data: np.ndarray, sums: np.ndarray, length: int) -> np.ndarray:
    """Positions that hold the leftmost smallest k-gram hash of some window of the text."""
    w = window_of(length)
    k = length - w + 1
    n = len(data) - length + 1  # starts of windows
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(len(data) - k + 1)
    h = tx.span_hashes(sums, at, at + k)
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    rows = padded.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[:n], head[w - 1 : w - 1 + n])
    # in a row of windows with one minimum all its places are chosen, and the first from the last window on
    own = np.flatnonzero(h[:n] == least)
    ends = np.append(np.flatnonzero(least[1:] != least[:-1]), n - 1)
    chosen = [own]
    for part in range(0, len(ends), 4096):
        e = ends[part : part + 4096]
        chosen.append(e + (h[e[:, None] + np.arange(w)[None, :]] == least[e][:, None]).argmax(axis=1))
    return np.unique(np.concatenate(chosen))


def _keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A document is known by its id and a hash of its text."""
    return docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("mark"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("bytes"),
    )


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """``doc, mark, at, core, full, seen``: anchors with the hashes of their k bytes and of their context.

    ``seen`` is 0 for a core that its batch of texts has once, 1 for the first of several and 2 for the others.
    """
    w = window_of(length)
    k = length - w + 1
    schema = pa.schema(
        [("doc", pa.int64()), ("mark", pa.int64()), ("at", pa.int32()), ("core", pa.int64()), ("full", pa.int64()), ("seen", pa.int8())]
    )

    def of_text(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums = tx.prefix_hashes(data)
        at = anchors(data, sums, length)
        left, right = np.maximum(at - w + 1, 0), np.minimum(at + length, len(data))
        full = tx.mix64(tx.span_hashes(sums, left, right) + (at - left).astype(np.uint64))
        return at, tx.span_hashes(sums, at, at + k), full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, 2, 4 << 20):
            data, offsets = tx.batch_bytes(batch.column(2))
            long = np.flatnonzero(np.diff(offsets) >= length)
            if not len(long):
                continue
            made = [of_text(data[offsets[i] : offsets[i + 1]]) for i in long]
            owner = pa.array(np.repeat(long, [len(at) for at, _, _ in made]))
            core = np.concatenate([core for _, core, _ in made])
            _, first, same, count = np.unique(core, return_index=True, return_inverse=True, return_counts=True)
            seen = np.where(count > 1, 2, 0)[same]
            seen[first[count > 1]] = 1
            yield tx.table_rows(
                {
                    "doc": batch.column(0).take(owner),
                    "mark": batch.column(1).take(owner),
                    "at": np.concatenate([at for at, _, _ in made]).astype(np.int32),
                    "core": core.view(np.int64),
                    "full": np.concatenate([full for _, _, full in made]).view(np.int64),
                    "seen": seen.astype(np.int8),
                },
                schema,
            )

    return keyed.mapInArrow(run, "doc bigint, mark bigint, at int, core bigint, full bigint, seen tinyint")


def _repeated_cores(rows: DataFrame) -> DataFrame:
    """``doc, mark, at, core, full`` of the anchors whose core occurs more than once; one shuffle.

    What a batch of texts shows to be repeated stays without being counted, and is dealt by
    place: only the first of it goes to the others of its core, so a frequent core fills no task.
    """
    dealt = F.when(F.col("seen") == 2, F.xxhash64("doc", "mark", "at")).otherwise(F.col("core"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.withColumn("dealt", dealt).repartition(parts, "dealt")
    counted = counted.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("dealt")))
    return counted.filter("seen > 0 or met > 1").select("doc", "mark", "at", "core", "full")


# --- suffix order in a block --------------------------------------------------------


def common_prefixes(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, and how many bytes each shares with the one before (-1 for the first).

    Two strings of a group agree on ``t`` bytes exactly if none between them in this order shares fewer.
    """
    order = np.array(sorted(range(len(strings)), key=list(zip(group.tolist(), strings)).__getitem__), dtype=np.int64)
    size = np.array([len(strings[i]) for i in order])
    starts = np.cumsum(size) - size
    data = np.frombuffer(b"".join([*(strings[i] for i in order), bytes(int(size.max(initial=0)) + 1)]), dtype=np.uint8)
    shared = np.full(len(order), -1, dtype=np.int64)
    for low in range(1, len(order), 4096):
        high = min(low + 4096, len(order))
        both = np.minimum(size[low - 1 : high - 1], size[low:high])
        at = np.arange(int(both.max()) + 1)
        differ = data[starts[low:high, None] + at] != data[starts[low - 1 : high - 1, None] + at]
        differ |= at >= both[:, None]
        shared[low:high] = differ.argmax(axis=1)
    shared[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, shared


def _runs(order: np.ndarray, shared: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each string (row) and number of bytes in ``least`` (column) the run of strings that agree on so many."""
    out = np.empty((len(order), len(least)), dtype=np.int64)
    out[order] = np.cumsum(shared[:, None] < least, axis=0)
    return out


def earlier_and_other(run: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which positions have a smaller position in their run, and which any other position."""
    order = np.lexsort((place, run)) if np.any(place[1:] < place[:-1]) else np.argsort(run, kind="stable")
    r, p = run[order], place[order]
    new = np.append(True, r[1:] != r[:-1])
    at = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(r)) if len(r) else np.zeros(1, dtype=np.int64)
    smallest, largest = p[first[:-1]], p[first[1:] - 1]
    later, repeated = np.zeros(len(r), dtype=bool), np.zeros(len(r), dtype=bool)
    later[order] = p > smallest[at]
    repeated[order] = (p > smallest[at]) | (p < largest[at])
    return later, repeated


def _order_blocks(length: int, later_only: bool):
    schema = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def found(rows: list[tuple]) -> pa.RecordBatch | None:
        # positions in the order of documents: a null id comes first
        named = sorted({(r[1] is not None, r[1] or 0, r[2]) for r in rows})
        number = {x: i for i, x in enumerate(named)}
        rows = sorted(rows, key=lambda r: (number[r[1] is not None, r[1] or 0, r[2]], r[4]))
        base = np.array([number[r[1] is not None, r[1] or 0, r[2]] for r in rows], dtype=np.int64) << 40
        anchor = np.array([r[4] for r in rows], dtype=np.int64)
        before = anchor - np.array([r[3] for r in rows], dtype=np.int64)
        after = np.array([len(r[6]) for r in rows]) - before
        group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
        # windows of a place that are equal have their anchors at one offset: they agree so far back and so far on
        low, high = min(r[5] for r in rows), max(int(before.max()), 0) + 1
        back = np.arange(low, high)
        on = _runs(*common_prefixes([r[6][b:] for r, b in zip(rows, before.tolist())], group), length - back)
        off = _runs(*common_prefixes([r[6][:b][::-1] for r, b in zip(rows, before.tolist())], group), back)
        there = (before[:, None] >= back) & (after[:, None] >= length - back) & (np.array([r[5] for r in rows])[:, None] <= back)
        who, which = np.nonzero(there)
        if not len(who):
            return None
        code = (which * (len(rows) + 1) + off[who, which]) * (len(rows) + 1) + on[who, which]
        later, repeated = earlier_and_other(code, (base + anchor)[who])
        hit = np.flatnonzero(later if later_only else repeated)
        if not len(hit):
            return None
        # what a document has covered in this block, as few spans as may be
        begins = np.unique((base + anchor)[who[hit]] - back[which[hit]])
        fresh = np.append(True, begins[1:] > begins[:-1] + length)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:] - 1, len(begins) - 1)
        place, within = begins[first] >> 40, (1 << 40) - 1
        return tx.table_rows(
            {
                "doc": [named[i][1] if named[i][0] else None for i in place],
                "mark": [named[i][2] for i in place],
                "begin": begins[first] & within,
                "end": (begins[last] & within) + length,
            },
            schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``place, doc, mark, left, at, least, context`` come sorted by place; whole places make a block."""
        block: list[tuple] = []
        group: list[tuple] = []
        seen: set[tuple] = set()  # repeated rows are one place
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if group and row[0] != group[0][0]:
                    block += group if len(group) > 1 else []
                    group, seen = [], set()
                    if size > _BLOCK_BYTES:
                        if block and (out := found(block)) is not None:
                            yield out
                        block, size = [], 0
                if row[1:6] not in seen:
                    seen.add(row[1:6])
                    group.append(row)
                    size += len(row[6])
        block += group if len(group) > 1 else []
        if block and (out := found(block)) is not None:
            yield out

    return run


# --- spans --------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """``doc, mark, spans``: byte spans covered by repeats, merged and sorted, per document that has any.

    With ``keep_first`` only later copies count, otherwise all repeats. Matches never
    cross documents. Null texts are empty; documents are known by id and text, so rows
    equal in both are one place for ``keep_first``, and repeats of each other otherwise.
    """
    w = window_of(length)
    keyed = _keys(docs, key, text)
    rows = stage(_repeated_cores(_anchor_rows(keyed, length)), "anchors")
    where = F.struct("doc", "mark", "at")
    classes = rows.groupBy("core", "full").agg(
        F.count(F.lit(1)).alias("n"), F.min(where).alias("first")
    )
    per_core = classes.groupBy("core").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    found = stage(classes.join(per_core.filter("all > 1"), "core"), "anchor-classes")

    # contexts equal as a whole: every window in them has a copy
    same = found.filter("n > 1").select("core", "full", F.struct("first.doc", "first.mark", "first.at").alias("first"))
    members = rows.join(same, ["core", "full"]).withColumn("here", where)
    if keep_first:
        members = members.filter(~F.col("here").eqNullSafe(F.col("first")))
    # the context may be cut by the ends of the text; the span is cut with it later
    whole = members.select("doc", "mark", (F.col("at") - (w - 1)).cast("bigint").alias("begin"), (F.col("at") + length).cast("bigint").alias("end"))

    # one context of every class of the anchors that have several
    several = found.filter("kinds > 1")
    row = ["place", "doc", "mark", "left", "at", "least", "context"]
    placed = _contexts(keyed, several.filter(F.col("kinds") <= TILE), w, length).withColumn("place", F.xxhash64("core")).withColumn("least", F.lit(0)).select(*row)
    large = several.filter(F.col("kinds") > TILE)
    rows_of_large = large.limit(_FEW + 1).count()
    if rows_of_large:
        placed = placed.unionByName(_parted(_contexts(keyed, large, w, length, rows_of_large <= _FEW), length).select(*row))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = placed.repartition(parts, "place").sortWithinPartitions("place")
    partly = blocks.mapInArrow(_order_blocks(length, keep_first), "doc bigint, mark bigint, begin bigint, end bigint")

    spans = whole.unionByName(partly).groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    return spans.withColumn("spans", _merged(F.col("spans")))


def _contexts(keyed: DataFrame, classes: DataFrame, w: int, length: int, few: bool = False) -> DataFrame:
    """``core, full, doc, mark, left, at, context`` at the first place of each class; where these are few, texts are not moved.

    A row of ``keyed`` that is repeated gives repeated contexts.
    """
    per_doc = classes.select("core", "full", "first.doc", "first.mark", "first.at").groupBy("doc", "mark")
    per_doc = per_doc.agg(F.collect_list(F.struct("core", "full", "at")).alias("a")).select(F.col("doc").alias("d"), F.col("mark").alias("m"), "a")
    texts = keyed.join(F.broadcast(per_doc) if few else per_doc, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    left = F.greatest(F.col("a.at") - (w - 1), F.lit(0))
    return texts.select("doc", "mark", "bytes", F.explode("a").alias("a")).select(
        "a.core", "a.full", "doc", "mark", left.alias("left"), "a.at", F.substring("bytes", left + 1, F.col("a.at") + length - left).alias("context")
    )


def _parted(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts of the anchors with many classes by ``place``, in ``PARTS`` parts of the windows around the anchor.

    All windows of a part share the bytes in its middle, so a part is placed by these; what
    does not have them whole has no window there. Only places that are still too large are
    cut into tiles, a place for every pair of them.
    """
    step = window_of(length) // PARTS
    own = contexts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("least", F.col("part") * step)
    before = F.col("at") - F.col("left")
    shared = length - step + 1
    middle = F.substring("context", before - F.col("least") + 1, F.lit(shared))
    own = own.filter((before >= F.col("least")) & (F.octet_length(middle) == shared)).withColumn("own", F.xxhash64("core", "part", middle))
    begin = F.greatest(F.col("at") - F.col("least") - (step - 1), F.col("left"))
    piece = F.substring("context", begin - F.col("left") + 1, F.col("at") + length - F.col("least") - begin)
    own = stage(own.select("own", "full", "doc", "mark", begin.alias("left"), "at", "least", piece.alias("context")), "parts")
    large = own.groupBy("own").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    large = stage(large.select(F.col("own").alias("large"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "large-parts")
    few = large.limit(_FEW + 1).count() <= _FEW
    sized = own.join(F.broadcast(large) if few else large, F.col("own") == F.col("large"), "left")
    tiles = F.coalesce("tiles", F.lit(1))
    tiled = sized.withColumn("tile", F.pmod(F.xxhash64("full"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return tiled.withColumn("place", F.xxhash64("own", F.least("tile", "other"), F.greatest("tile", "other")))


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans as one; they come sorted."""

    def add(state: Column, s: Column) -> Column:
        joins = s["begin"] <= state["end"]
        return F.when(
            joins,
            F.struct(state["begin"].alias("begin"), F.greatest(state["end"], s["end"]).alias("end"), state["done"].alias("done")),
        ).otherwise(
            F.struct(
                s["begin"].alias("begin"),
                s["end"].alias("end"),
                F.array_append(state["done"], F.struct(state["begin"].alias("begin"), state["end"].alias("end"))).alias("done"),
            )
        )

    zero = F.struct(
        spans[0]["begin"].alias("begin"), spans[0]["end"].alias("end"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("done")
    )
    return F.aggregate(
        spans, zero, add, lambda s: F.array_append(s["done"], F.struct(s["begin"].alias("begin"), s["end"].alias("end")))
    )


def _clip(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    return [(max(0, s["begin"]), min(size, s["end"])) for s in spans or []]


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _with_spans(docs: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """``docs`` with ``mark`` and ``spans`` joined by document; one shuffle of the texts."""
    named = spans.select(F.col("doc").alias("span_doc"), F.col("mark").alias("span_mark"), "spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mark = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    keyed = docs.select(row, F.col(f"`{key}`").cast("bigint").alias("doc"), mark.alias("mark"))
    return keyed.join(named, F.col("doc").eqNullSafe(F.col("span_doc")) & (F.col("mark") == F.col("span_mark")), "left")


def dedup_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """``doc, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    Null texts are empty. Repeated rows give repeated results, further columns are not
    read, and an empty table gives an empty result.
    """
    spans = repeated_spans(docs, key=key, text=text, length=length, keep_first=keep_first)
    narrow = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    joined = _with_spans(narrow, key, text, spans).select("doc", F.coalesce(F.col(f"row.`{text}`"), F.lit("")).cast("binary").alias("bytes"), "spans")
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, lists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cut = [_clip(s, len(r)) for r, s in zip(raws, lists)]
            yield tx.table_rows(
                {
                    "doc": batch.column(0),
                    "n_bytes": [len(r) for r in raws],
                    "n_removed": [sum(b - a for a, b in c) for c in cut],
                    "n_spans": [len(c) for c in cut],
                    "kept_sha256": [hashlib.sha256(cut_spans(r, c)).hexdigest() for r, c in zip(raws, cut)],
                },
                schema,
            )

    return joined.mapInArrow(run, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans made smaller so that they hold whole UTF-8 characters only."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """``docs`` with the spans taken out of the text, whole characters only; rows and columns stay.

    A null text stays null. A text may become empty.
    """
    spans = repeated_spans(docs, key=key, text=text, length=length, keep_first=keep_first)
    joined = _with_spans(docs, key, text, spans).select("row", F.col(f"row.`{text}`").alias("text"), "spans")
    fields = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if t is None or not s:
                    made.append(t)
                    continue
                raw = t.encode()
                made.append(cut_spans(raw, whole_characters(raw, _clip(s, len(raw)))).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["row", "text"])

    done = joined.mapInArrow(run, f"row {fields}, text string")
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
