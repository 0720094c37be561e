"""Exact Jaccard similarity of linked documents' shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.llm import text as tx
from stationcast.session import stage

#: Sets that share a member, up to which their pairs are counted one by one; cells of a part of the other members' table.
_LIGHT = 16
_CELLS = 1 << 21
#: Bytes of a digest of a set.
DIGEST = 16
#: Rows of a table that may be broadcast, by a count.
_FEW = 500_000
#: Sets among which frequent members are looked for: so many, or this part of a large table's rows, so that members are
#: found from one number of sets on however many there are; the count above which they are frequent, and how many are kept.
_SAMPLE = 8_000
_SHARE = 32
_OFTEN = 4
_MOST_FREQUENT = 200_000


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, and how many each text has."""
    data, offsets = tx.batch_bytes(texts)
    starts, ends, counts = tx.word_spans(data, offsets)
    return tx.shingle_hashes(tx.content_hashes(data, starts, ends), counts, size)


def text_digest(text: Column) -> Column:
    """16 bytes of the SHA-256 of a text, null being empty: with the key they name a row's content."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, 2 * DIGEST))


def named_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, digest, text`` of every row; the key is cast to bigint, and text that is no number raises."""
    said = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), text_digest(said).alias("digest"), said.alias("text"))


def class_rows(prints: DataFrame) -> DataFrame:
    """``fp, least, digest``: key and digest of the row that stands for each class of ``prints`` (``doc, digest, fp``).

    The row of the smallest key, null last, and of the smallest digest among rows that share
    it. Further columns of ``prints`` are alike within a class and follow.
    """
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "digest"))
    more = [c for c in prints.columns if c not in ("doc", "digest", "fp")]
    rows = prints.groupBy("fp").agg(least.alias("r"), *[F.first(c).alias(c) for c in more])
    return rows.select("fp", F.col("r.doc").alias("least"), "r.digest", *more)


def class_sets(classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``fp, set``: the distinct shingles, in order, of the document that stands for each class.

    ``classes`` are those of ``class_rows``, ``texts`` those of ``named_texts``. A set is made
    once for each class; where a row is repeated, once in a partition at most. The texts are
    not moved where the classes are few, by a count.
    """
    schema = pa.schema([("fp", pa.binary()), ("set", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows have equal texts
        for batch in tx.small_batches(batches, "text", 2 << 20):
            fresh = {}
            for i, fp in enumerate(batch.column(0).to_pylist()):
                if fp not in seen:
                    fresh[fp] = i
                    seen.add(fp)
            own = text_sets(batch.column(1).take(pa.array(fresh.values(), pa.int64())), size)
            yield tx.table_rows({"fp": list(fresh), "set": [x.view(np.int64) for x in own]}, schema)

    members = if_few(classes.select("fp", "least", F.col("digest").alias("own")))
    same = F.col("doc").eqNullSafe(F.col("least")) & (F.col("digest") == F.col("own"))
    return stage(texts.join(members, same).select("fp", "text").mapInArrow(sets, "fp binary, set array<bigint>"), "shingle-sets")


def if_few(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if it has at most ``_FEW`` rows."""
    return F.broadcast(table) if table.limit(_FEW + 1).count() <= _FEW else table


def text_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, in order."""
    hashes, counts = shingles(texts, size)
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - c : e]) for e, c in zip(ends, counts)]


def set_digest(members: np.ndarray) -> bytes:
    """A digest of a set in order, zero for one without members."""
    return hashlib.blake2b(members.tobytes(), digest_size=DIGEST).digest() if len(members) else bytes(DIGEST)


def read_sets(texts: DataFrame, size: int) -> DataFrame:
    """``fp, set`` of the texts of ``named_texts`` that have words, read where they lie; equal sets of a partition come once."""
    schema = pa.schema([("fp", pa.binary()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in tx.small_batches(batches, "text", 2 << 20):
            fresh = {}
            for x in text_sets(batch.column(0), size):
                if len(x) and (fp := set_digest(x)) not in seen:
                    fresh[fp] = x.view(np.int64)
                    seen.add(fp)
            yield tx.table_rows({"fp": list(fresh), "set": list(fresh.values())}, schema)

    return texts.select("text").mapInArrow(run, "fp binary, set array<bigint>")


def set_prints(
    docs: DataFrame,
    *,
    key: str,
    text: str,
    words: int,
    prefix: Callable[[list[np.ndarray]], list[np.ndarray]] | None = None,
    **more: Callable[[list[np.ndarray]], list[bytes]],
) -> DataFrame:
    """``doc, digest, fp, size`` per row: a digest of the text's set of shingles, zero for texts without words, and its size.

    Each of ``more`` makes a column of binaries from the sets, ``prefix`` one of members
    (``prefix``), which is empty where a set comes again in a partition.
    """
    kinds = {"doc": ("bigint", pa.int64()), "digest": ("binary", pa.binary()), "fp": ("binary", pa.binary()), "size": ("bigint", pa.int64())}
    kinds |= {c: ("binary", pa.binary()) for c in more}
    if prefix is not None:
        kinds["prefix"] = ("array<bigint>", pa.list_(pa.int64()))
    schema = pa.schema([(c, kind) for c, (_, kind) in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in tx.small_batches(batches, "text", 2 << 20):
            own = text_sets(batch.column(2), words)
            made = {"doc": batch.column(0), "digest": batch.column(1), "fp": [set_digest(x) for x in own], "size": [len(x) for x in own]}
            made |= {c: make(own) for c, make in more.items()}
            if prefix is not None:
                fresh = []
                for fp, x in zip(made["fp"], own):
                    fresh.append(x[:0] if fp in seen else x)
                    seen.add(fp)
                made["prefix"] = [x.view(np.int64) for x in prefix(fresh)]
            yield tx.table_rows(made, schema)

    return named_texts(docs, key, text).mapInArrow(run, ", ".join(f"{c} {kind}" for c, (kind, _) in kinds.items()))


def sampled(texts: DataFrame) -> DataFrame:
    """About ``_SAMPLE`` of the texts of ``named_texts``, or one of ``_SHARE`` if that is more, by hash."""
    rows = texts.count()
    most = max(_SAMPLE, rows // _SHARE)
    return texts if rows <= most else texts.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * most / rows) + 1)


def frequent_members(held: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Members of many of the sets (``fp, set``; rows of one ``fp`` count once), and in how many; at most ``_MOST_FREQUENT``."""
    members = held.dropDuplicates(["fp"]).select(F.explode("set").alias("member"))
    counts = members.groupBy("member").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > _OFTEN)
    found = counts.orderBy(F.desc("n"), "member").limit(_MOST_FREQUENT).toArrow()
    members, n = np.asarray(found["member"]).astype(np.int64).view(np.uint64), np.asarray(found["n"]).astype(np.int64)
    order = np.argsort(members)
    return members[order], n[order]


def set_prefixes(sets: list[np.ndarray], similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Of each set as many members, rarest first, as any set alike must share one of.

    Two sets of that similarity share at least ``similarity`` times the size of either, so
    in one order of all members the first of those they share lies in both prefixes. Any
    order does; that of the frequencies in a sample (``frequent_members``) keeps common
    passages out of the prefixes.
    """
    members, n = frequent
    out = []
    for own in sets:
        take = len(own) - math.ceil(similarity * len(own)) + 1 if len(own) else 0
        if len(members) and len(own):
            at = np.minimum(np.searchsorted(members, own), len(members) - 1)
            own = own[np.argsort(np.where(members[at] == own, n[at], 0), kind="stable")]
        out.append(own[:take])
    return out


def dealt_prefixes(prints: DataFrame, similarity: float) -> DataFrame:
    """``bucket, fp, early, size, left`` for each member of the column ``prefix`` of ``set_prints``.

    In the smaller of two alike sets the first shared member has at least ``2 s / (1 + s)``
    of its size left, itself included: ``early`` marks those places, one of which a bucket
    needs. ``size`` is the set's and ``left`` what it has from that member on.
    """
    share = 2 * similarity / (1 + similarity)
    rows = prints.select("fp", F.col("size").cast("int").alias("size"), F.posexplode("prefix").alias("at", "bucket"))
    left = F.col("size") - F.col("at")
    return rows.select("bucket", "fp", (left >= F.col("size") * share - 1e-6).alias("early"), "size", left.alias("left"))  # roundings only let more pass


def bin_counts(sets: list[np.ndarray]) -> list[bytes]:
    """How many members of each set fall into each of a power of two of bins, four to eight to a bin; 255 says that or more."""
    out = []
    for x in sets:
        bins = 1 << max(3, (len(x) // 4).bit_length() - 1)
        n = np.bincount((x & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
        out.append(np.minimum(n, 255).astype(np.uint8).tobytes())
    return out


def maybe_alike(counts: list[bytes], sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets may be ``similarity`` alike to another one, by their sizes and bins: all that are, and few others.

    Two sets share no more members of a bin than the smaller of its counts. The counts of
    the one with more bins are added up to as many as the other has. Larger sets have no
    fewer bins, so each set is compared with the next larger ones, up to the size that an
    alike one may have.
    """
    found = np.zeros(len(counts), dtype=bool)
    order = np.argsort(sizes, kind="stable")
    sizes = np.asarray(sizes, dtype=np.int64)[order]
    width = np.array([len(counts[r]) for r in order])
    ends = np.searchsorted(sizes, sizes / similarity + 1e-6, side="right")
    for bins in np.unique(width):
        first, after = np.searchsorted(width, [bins, bins + 1])
        last = int(ends[first:after].max())
        if last - first < 2:
            continue
        table = np.array([np.frombuffer(counts[r], dtype=np.uint8).reshape(-1, bins).sum(axis=0, dtype=np.int32) for r in order[first:last]])
        full = (table >= 255).any()
        for i in range(first, min(after, last)):
            others = slice(i + 1, int(ends[i]))
            if others.start >= others.stop:
                continue
            low = np.minimum(table[i + 1 - first : others.stop - first], table[i - first])
            most = low.sum(axis=1, dtype=np.int64)
            if full:
                most = most + np.where((low >= 255).any(axis=1), sizes[i], 0)  # full bins may hold any number
            near = most * (1 + similarity) >= similarity * (sizes[others] + sizes[i]) - 1e-6
            if near.any():
                found[order[others][near]] = True
                found[order[i]] = True
    return found


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs ``i < j`` of sets, each without repeats, that are at least ``similarity`` alike."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    common = np.zeros((n, n))
    for light in (True, False):
        some = (seen > 1) & ((seen <= _LIGHT) == light)
        used = some[at]
        column, row = (np.cumsum(some) - 1)[at[used]], owner[used]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        if light:  # members of few sets: their pairs are counted one by one
            codes = [np.zeros(0, dtype=np.int64)]
            for d in range(1, _LIGHT):
                same = column[d:] == column[:-d]
                codes.append(row[:-d][same] * n + row[d:][same])
            pairs, times = np.unique(np.concatenate(codes), return_counts=True)
            common.ravel()[pairs] += times
            continue
        width = max(1, _CELLS // n)
        for low in range(0, int(some.sum()), width):
            lo, hi = np.searchsorted(column, [low, low + width])
            part = np.zeros((n, width), dtype=np.float32)
            part[row[lo:hi], column[lo:hi] - low] = 1
            common += part @ part.T
    near = np.triu(common >= similarity * (sizes[:, None] + sizes[None, :] - common), 1)
    return np.nonzero(near & (common > 0))
