"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint bit is 1 if it is set in over half of a document's shingle hashes. Equal
fingerprints are one row from there on, so copies cost nothing. To find fingerprints
within a radius, each is dealt to buckets by groups of its bits; rows of a bucket are
compared in blocks whose bits are stored vertically, one plane per bit position with 64
fingerprints to a machine word. Distances of a fingerprint to all lanes of a block grow
together in carry-save counters of bit planes, started so that they overflow just beyond
the radius, and a fingerprint leaves the comparison once all its lanes have overflowed.
A block returns a spanning forest of its links rather than all pairs, which keeps every
component and bounds the output by its rows. Buckets above ``TILE`` rows are cut into
tiles, every pair of tiles being compared, so no task holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.llm import text as tx
from stationcast.llm.components import components
from stationcast.llm.jaccard import (
    DIGEST,
    alike,
    bin_counts,
    class_rows,
    class_sets,
    dealt_prefixes,
    frequent_members,
    if_few,
    maybe_alike,
    named_texts,
    read_sets,
    sampled,
    set_prefixes,
    set_prints,
    shingles,
    text_digest,
)
from stationcast.session import stage

#: Rows of a bucket that are compared in one block; larger buckets are cut into tiles of this size.
TILE = 1024
#: Rows gathered into a block when buckets are small.
_BLOCK = 512
#: Rows of a bucket table that may be broadcast, by a count.
_FEW = 100_000

#: Bits in which fingerprints of near-duplicates may differ to be judged as a group first.
RADIUS = 3

#: Two ends and a cost for each linked pair of a block.
Links = tuple[np.ndarray, np.ndarray, np.ndarray]

_BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 64-bit words: ``hashes`` has one column per word.

    Counts the values of each byte position per document, then adds up the bits of
    the 256 values, instead of unpacking every hash into bits.
    """
    n, words = len(counts), hashes.shape[1]
    owner = np.repeat(np.arange(n, dtype=np.int64) * 256, counts)
    out = np.zeros((n, words), dtype=np.uint64)
    for w in range(words):
        for byte in range(8):
            value = ((hashes[:, w] >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            seen = np.bincount(owner + value, minlength=n * 256).reshape(n, 256)
            ones = (seen @ _BITS_OF_BYTE) * 2 > counts[:, None]
            for bit in range(8):
                out[:, w] |= ones[:, bit].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def exact_hashes(texts: list[bytes], size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all runs of ``size`` lower-cased words, joined by one space, per text."""
    digest = xxhash.xxh64_intdigest
    all_hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, raw in enumerate(texts):
        words = raw.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        k = min(size, len(words))
        got = [digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
        all_hashes.append(np.array(got, dtype=np.uint64))
        counts[i] = len(got)
    return (np.concatenate(all_hashes) if all_hashes else np.zeros(0, dtype=np.uint64)), counts


def _spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """Further independent words from one hash, for fingerprints of more than 64 bits."""
    if words == 1:
        return hashes[:, None]
    salts = np.array([(0x9E3779B97F4A7C15 * (w + 1)) & (2**64 - 1) for w in range(words)], dtype=np.uint64)
    return tx.mix64(hashes[:, None] ^ salts[None, :])


def fingerprints(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42, bits: int = 64, distinct: bool = False
) -> DataFrame:
    """``key, fp`` (big-endian bytes) per row; texts without words have fingerprint zero.

    With 64 bits the hashes are XXH64 of the lower-cased shingle strings, repeats included;
    longer fingerprints derive theirs from vectorised hashes of the words as they stand.
    ``distinct`` counts
    each shingle of a document once, which ties distances to set similarity. Null texts
    are empty; null keys and repeated rows are kept; an empty table gives an empty one.
    """
    words = bits // 64
    schema = pa.schema([("doc", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, "text", 2 << 20):
            texts = batch.column(1)
            if words == 1:
                raw = texts.cast(pa.large_binary()).fill_null(b"").to_pylist()
                hashes, counts = exact_hashes(raw, size, seed)
            else:
                hashes, counts = shingles(texts, size)
            if distinct:
                hashes, counts = _once_per_document(hashes, counts)
            made = majority(_spread(hashes, words), counts)
            packed = np.ascontiguousarray(made[:, ::-1]).astype(">u8").tobytes()
            width = bits // 8
            yield tx.table_rows(
                {"doc": batch.column(0), "fp": [packed[i * width : (i + 1) * width] for i in range(len(counts))]}, schema
            )

    named = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, "doc bigint, fp binary").withColumnRenamed("doc", key)


def _once_per_document(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[first], np.bincount(o[first], minlength=len(counts))


# --- buckets ----------------------------------------------------------------------


def pigeonhole_groups(bits: int, radius: int, blocks: int | None = None) -> list[list[int]]:
    """Bit groups such that fingerprints within ``radius`` agree on all bits of at least one.

    The bits are cut into ``radius + 2`` blocks; of these at least two stay untouched, so
    every pair of blocks makes a group.
    """
    blocks = blocks or radius + 2
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    parts = [list(range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(chosen, []) for chosen in combinations(parts, blocks - radius)]


def _as_words(column: pa.Array) -> np.ndarray:
    raw = column.cast(pa.large_binary())
    joined = b"".join(raw.to_pylist())
    return np.frombuffer(joined, dtype=">u8").astype(np.uint64).reshape(len(column), -1)[:, ::-1].copy()


def _dealt(fps: DataFrame, groups: list[list[int]]) -> DataFrame:
    """A row per fingerprint and bit group: ``bucket, fp``."""
    schema = pa.schema([("bucket", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _as_words(batch.column(0))
            for g, bits in enumerate(groups):
                value = np.full(len(words), g + 1, dtype=np.uint64)
                for b in bits:
                    value = value * np.uint64(2) + ((words[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1))
                    if b == bits[len(bits) // 2]:
                        value = tx.mix64(value + np.uint64(g))
                key = tx.mix64(value ^ np.uint64((g + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                yield tx.table_rows({"bucket": key.view(np.int64), "fp": batch.column(0)}, schema)

    return fps.select("fp").mapInArrow(run, "bucket bigint, fp binary")


# --- bit-sliced comparison --------------------------------------------------------


def block_links(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs ``i < j`` of rows that differ in at most ``radius`` bits."""
    n, bits = len(words), words.shape[1] * 64
    lanes = -(-n // 64)
    padded = np.zeros((lanes * 64, words.shape[1]), dtype=np.uint64)
    padded[:n] = words
    rows = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(lanes * 64, -1), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(rows.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)  # bit position x lane words
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    # lanes up to the row itself, and those that pad, are out from the start
    ahead = np.arange(lanes * 64)[None, :] > np.arange(n)[:, None]
    ahead[:, n:] = False
    over = ~np.ascontiguousarray(np.packbits(ahead, axis=1, bitorder="little")).view("<u8").astype(np.uint64)
    depth = max(1, (radius + 1).bit_length())
    start = (1 << depth) - 1 - radius  # counters overflow at radius + 1
    counters = [np.full((n, lanes), full if start >> d & 1 else 0, dtype=np.uint64) for d in range(depth)]
    alive = np.arange(n)
    for b in range(0, bits, 2):
        q = np.where(rows[alive, b], full, np.uint64(0))[:, None]
        r = np.where(rows[alive, b + 1], full, np.uint64(0))[:, None]
        x, y = planes[b][None, :] ^ q, planes[b + 1][None, :] ^ r
        half = x ^ y
        carry = (x & y) | (half & counters[0])  # two planes and the low counter in one carry-save step
        counters[0] ^= half
        for d in range(1, depth):
            kept = counters[d] & carry
            counters[d] ^= carry
            carry = kept
        over |= carry
        if b % 16 == 14:
            left = (over != full).any(axis=1)
            if not left.all():
                alive, over, counters = alive[left], over[left], [c[left] for c in counters]
                if not len(alive):
                    break
    if not len(alive):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    near = np.unpackbits(np.ascontiguousarray(~over).astype("<u8").view(np.uint8).reshape(len(alive), -1), axis=1, bitorder="little")
    i, j = np.nonzero(near)
    return alive[i], j


def spanning_forest(i: np.ndarray, j: np.ndarray, cost: np.ndarray, n: int) -> np.ndarray:
    """Indices of the links of a cheapest spanning forest.

    Of the pairs it leaves out, each is at least as costly as all links on the way between
    its ends; so a check that later drops links by this same cost keeps the components of
    the rest. A check by anything else comes before the forest.
    Components take their cheapest outgoing link round by round, all at once.
    """
    order = np.lexsort((j, i, cost))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    root, kept = np.arange(n), np.zeros(0, dtype=np.int64)
    while True:
        a, b = root[i], root[j]
        out = a != b
        if not out.any():
            return kept
        best = np.full(n, len(order), dtype=np.int64)
        np.minimum.at(best, a[out], rank[out])
        np.minimum.at(best, b[out], rank[out])
        new = order[np.unique(best[best < len(order)])]
        kept = np.concatenate([kept, new])
        while True:  # unite what the new links join
            low = np.minimum(root[i[new]], root[j[new]])
            united = np.arange(n)
            np.minimum.at(united, root[i[new]], low)
            np.minimum.at(united, root[j[new]], low)
            moved = united[root]
            if (moved == root).all():
                break
            root = moved


def _within(radius: int):
    def compare(fps: list[bytes]) -> Links:
        words = _as_words(pa.array(fps, pa.binary()))
        i, j = block_links(words, radius)
        return i, j, np.bitwise_count(words[i] ^ words[j]).sum(axis=1)

    return compare


def _forest(compare: Callable[[list[bytes]], Links]):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def links(fps: list[bytes]) -> pa.RecordBatch | None:
        fps = sorted(set(fps))
        if len(fps) < 2:
            return None
        i, j, cost = compare(fps)
        if not len(i):
            return None
        kept = spanning_forest(i, j, cost, len(fps))
        return tx.table_rows({"a": [fps[x] for x in i[kept]], "b": [fps[x] for x in j[kept]]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; whole buckets are gathered into blocks."""
        block: list[bytes] = []
        bucket: list[bytes] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.asarray(batch.column(0))
            opens = np.append(True, places[1:] != places[:-1])
            opens[0] = at is None or places[0] != at
            alone = opens[:-1] & opens[1:]  # the batch's last row may have others of its bucket behind it
            batch = batch.filter(pa.array(np.append(~alone, True)))
            for place, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if place != at:
                    if len(bucket) > 1:  # a bucket of one has nothing to compare
                        if len(block) + len(bucket) > _BLOCK and block:
                            if (out := links(block)) is not None:
                                yield out
                            block = []
                        block += bucket
                    bucket, at = [], place
                bucket.append(fp)
        if len(bucket) > 1:
            block += bucket
        if (out := links(block)) is not None:
            yield out

    return run


def linked_in_blocks(dealt: DataFrame, compare: Callable[[list[bytes]], Links]) -> DataFrame:
    """Links ``a, b`` among the values ``fp`` of each ``bucket``, a spanning forest per block.

    ``compare`` gets sorted distinct values and returns indices and costs of all linked pairs.
    Every linked pair that shares a bucket ends in one component.
    """
    blocks = _by_place(_placed(stage(dealt, "buckets"), TILE))
    return blocks.mapInArrow(_forest(compare), "a binary, b binary")


def _placed(dealt: DataFrame, most: int) -> DataFrame:
    """``place, fp``: buckets of more than ``most`` rows in tiles, a place for every pair of them."""
    large = stage(
        dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
        .select(F.col("bucket").alias("large"), F.ceil(F.col("n") / most).cast("int").alias("tiles")),
        "large-buckets",
    )
    few = large.limit(_FEW + 1).count() <= _FEW
    sized = dealt.join(F.broadcast(large) if few else large, F.col("bucket") == F.col("large"), "left")
    tile = F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("tiles", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)
    pair: Column = F.xxhash64("bucket", F.least("tile", "other"), F.greatest("tile", "other"))
    return (
        sized.withColumn("tile", tile)
        .select("bucket", "fp", "tile", F.explode(every).alias("other"))
        .select(pair.alias("place"), "fp")
    )


def _by_place(placed: DataFrame) -> DataFrame:
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "place").sortWithinPartitions("place")


def _shared_buckets(dealt: DataFrame, similarity: float) -> DataFrame:
    """``bucket, fp`` where more than one class is dealt; buckets that share their first member (by a hash) are one.

    The many buckets of a group of near copies become a few, so a set is moved a few times
    only, and every pair of a bucket stays together. Of the buckets of prefixes those go that
    have no ``early`` place, and those of two classes whose sizes, or what both have left
    from the shared member on, cannot make the similarity: at the first member that an alike
    pair shares they can.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("fp")).alias("lead")]
    sums += [F.max(F.xxhash64("fp")).alias("trail")]
    useful = F.col("lead") < F.col("trail")  # copies of one class are none to compare
    if "early" in dealt.columns:
        sums += [F.max("early").alias("early"), F.min("size").alias("least"), F.max("size").alias("most"), F.min("left").alias("left")]
        sums += [F.sum("size").alias("both")]
        possible = (F.col("least") >= F.col("most") * similarity - 1e-6) & (
            F.col("left") * (1 + similarity) >= F.col("both") * similarity - 1e-6
        )
        useful = useful & F.col("early") & ((F.col("n") > 2) | possible)
    kept = dealt.groupBy("bucket").agg(*sums).filter(useful).select("bucket", "lead")
    return stage(dealt.join(kept, "bucket").select(F.col("lead").alias("bucket"), "fp").distinct(), "shared-buckets")


def _tile(tiles: Column) -> Column:
    return F.pmod(F.xxhash64("fp", F.lit(1)), tiles).cast("int")


def _first_places(rows: DataFrame, most: int) -> DataFrame:
    """``place, fp``: every class once, in its largest bucket, and the bucket's first class in each of its tiles."""
    sized = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("pivot"))
    best = F.max_by(F.struct("bucket", "n", "pivot"), F.struct("n", "bucket"))
    own = rows.join(sized, "bucket").groupBy("fp").agg(best.alias("b")).select("fp", "b.*")
    placed = own.withColumn("place", F.xxhash64("bucket", _tile(F.ceil(F.col("n") / most)))).select("place", "fp", "pivot")
    return placed.select("place", "fp").unionByName(placed.select("place", F.col("pivot").alias("fp"))).distinct()


def _other_places(rows: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """``place, fp`` of the buckets that still hold several components.

    A large bucket has tiles of its largest component's classes and tiles of all others, and
    a place for each two tiles that are not both of the largest: each pair of different
    components meets, pairs of the largest need not, and a bucket of many components costs
    its pairs once or twice and not again for each tile.
    """
    known = rows.join(roots, F.col("fp") == F.col("node"), "left").select("bucket", "fp", F.coalesce("root", "fp").alias("root"))
    parts = known.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("major")
    )
    tiles = [F.when(F.col("n") > 2 * most, F.ceil(n / most).cast("int")).otherwise(0) for n in (F.col("n") - F.col("most"), F.col("most"))]
    mixed = mixed.filter("roots > 1").select("bucket", "major", tiles[0].alias("tiles"), tiles[1].alias("major_tiles"))

    def place(kind: int, one: Column, other: Column) -> Column:
        return F.xxhash64("bucket", F.lit(kind), one, other)

    tile, major_tile = _tile(F.greatest("tiles", F.lit(1))), _tile(F.greatest("major_tiles", F.lit(1)))
    of_major = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: place(1, x, major_tile))
    with_others = F.transform(F.array_remove(F.sequence(F.lit(0), F.col("tiles") - 1), tile), lambda x: place(0, F.least(tile, x), F.greatest(tile, x)))
    with_major = F.transform(F.sequence(F.lit(0), F.col("major_tiles") - 1), lambda x: place(1, tile, x))
    several = F.when(F.col("root") == F.col("major"), of_major).otherwise(F.concat(with_others, with_major))
    places = F.when(F.col("tiles") == 0, F.array(place(2, F.lit(0), F.lit(0)))).otherwise(several)
    return known.join(mixed, "bucket").select(F.explode(places).alias("place"), "fp")


def _judged(placed: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` of classes of one ``place`` whose sets (``held``) are at least ``similarity`` alike, spanning forests."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def links(fps: list[bytes], sets: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
        if len(fps) < 2:
            return [], []
        i, j = alike(sets, similarity)
        kept = spanning_forest(i, j, np.zeros(len(i)), len(fps))
        return [fps[x] for x in i[kept]], [fps[x] for x in j[kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps: list[bytes] = []
        sets: list[np.ndarray] = []
        seen: set[bytes] = set()
        at = None
        for batch in batches:
            a: list[bytes] = []
            b: list[bytes] = []
            flat, ends = np.asarray(batch.column(2).values), np.asarray(batch.column(2).offsets)
            for k, (place, fp) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if place != at:
                    x, y = links(fps, sets)
                    a += x
                    b += y
                    fps, sets, at, seen = [], [], place, set()
                if fp not in seen:
                    seen.add(fp)
                    fps.append(fp)
                    sets.append(flat[ends[k] : ends[k + 1]])
            if a:
                yield tx.table_rows({"a": a, "b": b}, schema)
            sets = [x.copy() for x in sets]  # lets the batch go
        x, y = links(fps, sets)
        yield tx.table_rows({"a": x, "b": y}, schema)

    rows = _by_place(placed.join(held, "fp").select("place", "fp", "set"))
    return stage(rows.mapInArrow(run, "a binary, b binary"), "sure-links")


def _hopeful(placed: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The rows ``place, fp`` of ``placed`` that may be alike to another of their place, by ``counts`` and ``size`` of the classes."""
    schema = pa.schema([("place", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[bytes, tuple[bytes, int]] = {}
        at = None

        def hopeful() -> list[bytes]:
            if len(group) < 2:
                return []
            counts, sizes = zip(*group.values())
            return [fp for fp, x in zip(group, maybe_alike(counts, np.array(sizes), similarity)) if x]

        for batch in batches:
            places: list[int] = []
            fps: list[bytes] = []
            for place, fp, counts, size in zip(*[c.to_pylist() for c in batch.columns]):
                if place != at:
                    kept = hopeful()
                    places += [at] * len(kept)
                    fps += kept
                    group, at = {}, place
                group[fp] = counts, size
            yield tx.table_rows({"place": places, "fp": fps}, schema)
        kept = hopeful()
        yield tx.table_rows({"place": [at] * len(kept), "fp": kept}, schema)

    rows = _by_place(placed.join(classes.select("fp", "counts", "size"), "fp").select("place", "fp", "counts", "size"))
    return rows.mapInArrow(run, "place bigint, fp binary")


def sure_links(dealt: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` of classes in a ``bucket`` whose sets are at least ``similarity`` alike, spanning forests.

    ``dealt`` has ``bucket, fp``, ``held`` the sets (``fp, set``), which come along with the
    rows. Pairs are judged by their exact similarity before a forest is taken. First every
    class is compared in its largest bucket alone, in tiles that share one member; that joins
    most copies. Then only buckets that still hold several components are compared, each
    pair of different components in them, so the links have all components of the pairs
    that hold, and a bucket of one group of copies costs its rows and not their pairs.
    """
    rows = _shared_buckets(dealt, similarity)
    first = _judged(_first_places(rows, TILE // 4), held, similarity)
    return first.unionByName(_judged(_other_places(rows, components(first), TILE // 4), held, similarity))


def _sketch(sets: list[np.ndarray]) -> list[bytes]:
    """64-bit SimHash fingerprints of sets of hashes, big-endian."""
    counts = np.array([len(x) for x in sets], dtype=np.int64)
    made = majority(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])[:, None], counts)
    packed = made.astype(">u8").tobytes()
    return [packed[8 * i : 8 * i + 8] for i in range(len(sets))]


def _groups_by_simhash(classes: DataFrame, radius: int) -> DataFrame:
    """``bucket, fp`` of the classes whose fingerprints (``sketch``) are linked to another class's, within ``radius`` bits."""
    values = stage(classes.select(F.col("sketch").alias("fp")).distinct(), "simhashes")
    roots = components(near_fingerprints(values, radius, pigeonhole_groups(64, radius)))
    rows = classes.join(roots, F.col("sketch") == F.col("node"), "left").select(F.xxhash64(F.coalesce("root", "sketch")).alias("bucket"), "fp")
    several = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return stage(rows.join(several, "bucket"), "simhash-groups")


def near_fingerprints(fps: DataFrame, radius: int, groups: list[list[int]]) -> DataFrame:
    """Links of distinct fingerprints (column ``fp``) that differ in at most ``radius`` bits and share a bit group."""
    return linked_in_blocks(_dealt(fps, groups), _within(radius))


def _named_components(prints: DataFrame, classes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``key, fp, component_id`` per row of ``prints``: the smallest key of all linked classes."""
    roots = components(links)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stage(named.join(least, "root").select(F.col("fp").alias("own"), "component_id"), "components")
    return prints.join(by_print, F.col("fp") == F.col("own")).select(key, "fp", "component_id")


def _classes(prints: DataFrame, key: str) -> DataFrame:
    return stage(prints.groupBy("fp").agg(F.min(key).alias("least")), "fingerprints")


def link_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """Documents with 64-bit fingerprints over three words, and their components at ``radius`` bits.

    Exact: two fingerprints within the radius share one of the bit groups.
    """
    prints = stage(fingerprints(docs, key=key, text=text), "prints")
    classes = _classes(prints, key)
    return _named_components(prints, classes, near_fingerprints(classes, radius, pigeonhole_groups(64, radius)), key)


def near_duplicate_groups(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8
) -> DataFrame:
    """Documents whose sets of ``size``-word shingles are at least ``similarity`` alike, as components.

    Exact up to collisions of 64-bit hashes: ``fp`` is a digest of the set, so a class holds
    equal sets. SimHash fingerprints within ``RADIUS`` bits make the groups that are judged
    first; two alike sets that they leave apart share a shingle of their prefixes, which are
    buckets. All pairs of a group or a bucket are judged by the exact similarity: a distance
    of fingerprints, which only estimates it, joins or parts nothing by itself. Texts without
    words form a group of their own.
    """
    prints, named = _near_classes(docs, key, text, size, similarity)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stage(named.join(least, "root").select(F.col("fp").alias("own"), "component_id"), "components")
    return prints.join(by_print, F.col("fp") == F.col("own")).select(F.col("doc").alias(key), "fp", "component_id")


def _near_classes(docs: DataFrame, key: str, text: str, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows' classes (``doc, digest, fp``), and of each class its row and component (``fp, least, digest, root``).

    SimHash fingerprints of the sets are linked within ``RADIUS`` bits, and the pairs of their
    groups are judged by exact similarity. Alike sets whose fingerprints differ by more share
    a member of their prefixes: buckets that still hold several components are judged too.
    Prefixes are made with the digests, in one reading of the texts, and sets only of classes that
    may be alike to another of their place by the counts of their members in bins, a bound without misses.
    """
    texts = named_texts(docs, key, text)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_members(read_sets(sampled(texts), size)))
    made = set_prints(
        docs, key=key, text=text, words=size, sketch=_sketch, counts=bin_counts,
        prefix=lambda sets: set_prefixes(sets, similarity, frequent.value),
    )
    prints = stage(made, "prints")
    rows = stage(class_rows(prints.drop("prefix")), "set-classes")
    classes = rows.filter(F.col("fp") != F.lit(bytes(DIGEST)))

    def judged(placed: DataFrame) -> DataFrame:
        placed = stage(_hopeful(placed, classes, similarity), "places")
        wanted = classes.join(placed.select("fp").distinct(), "fp", "left_semi")
        return _judged(placed, class_sets(wanted, texts, size), similarity)

    first = judged(_first_places(_groups_by_simhash(classes, RADIUS), TILE // 4))
    dealt = dealt_prefixes(prints, similarity)
    rest = judged(_other_places(_shared_buckets(dealt, similarity), components(first), TILE // 4))
    roots = components(first.unionByName(rest)).withColumnRenamed("node", "fp")
    named = rows.select("fp", "least", "digest").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return prints, stage(named, "near-classes")


def keep_one_per_group(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8
) -> DataFrame:
    """One document of each near-duplicate group; same columns.

    A row is known by its key and its text. Of a group the row with the smallest key stays,
    a null key being the largest, and of several texts with that key the one of the smallest
    digest; of rows that repeat both, one stays. Rows of another text that share its key are
    judged by their own text. Documents without any word are no copies of each other and stay.
    """
    prints, named = _near_classes(docs, key, text, size, similarity)
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "digest"))
    kept = named.groupBy("root").agg(best.alias("r")).select(F.col("r.least").alias("_kept_key"), F.col("r.digest").alias("_kept_text"))
    # what goes, and what stays but comes repeatedly; all other rows stay as they are, unmoved where those are few
    times = prints.filter(F.col("fp") != F.lit(bytes(DIGEST))).groupBy("doc", "digest").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc").eqNullSafe(F.col("_kept_key")) & (F.col("digest") == F.col("_kept_text"))
    marks = times.join(kept, known, "left").withColumn("_goes", F.col("_kept_text").isNull()).filter("_goes or n > 1")
    marks = stage(marks.select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), "_goes"), "marks")
    same = F.col("_key").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_digest"))
    marked = docs.withColumn("_key", F.col(f"`{key}`").cast("bigint")).withColumn("_text", text_digest(F.col(f"`{text}`")))
    left = marked.join(if_few(marks), same, "left_anti")
    repeated = marks.filter(~F.col("_goes"))
    if not repeated.isEmpty():
        left = left.unionByName(marked.join(if_few(repeated), same, "left_semi").dropDuplicates(["_key", "_text"]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
