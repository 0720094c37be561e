"""Document fingerprints by MinHash, compared with those of edited texts and of neighbours.

A signature holds, for each of ``PERMUTATIONS`` permutations of 32-bit numbers
(``a * x + b`` with odd ``a``), the smallest image of a document's five-word shingles, of
which 16 bits are kept. The share of equal entries estimates the Jaccard similarity of
the shingle sets. Near-duplicates come from bands of the signature that agree, compared
in blocks by the exact Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.llm import text as tx
from stationcast.llm.components import components
from stationcast.llm.jaccard import class_rows, class_sets, named_texts, shingles
from stationcast.llm.simhash import sure_links
from stationcast.session import stage

PERMUTATIONS = 128
SHINGLE = 5
BANDS, ROWS = 21, 6
_CHUNK = 1 << 21

_rng = np.random.default_rng(2024)
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def signatures(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """One row of 16-bit numbers per text; texts without words have zeros."""
    hashes, counts = shingles(texts, size)
    out = np.zeros((len(counts), PERMUTATIONS), dtype=np.uint16)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    at = (np.cumsum(counts) - counts)[some]
    folded = (hashes >> np.uint64(32)).astype(np.uint32)
    image = np.empty_like(folded)
    for p in range(PERMUTATIONS):
        np.multiply(folded, _A[p], out=image)
        image += _B[p]
        least = np.minimum.reduceat(image, at)
        out[some, p] = tx.mix64(least.astype(np.uint64)).astype(np.uint16)
    return out


def _hex(rows: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in rows.astype(">u2")]


# --- documents in descending order of their keys, each with the next ---------------


def _bounds(keys: DataFrame, buckets: int) -> list[list[int]]:
    """Quantiles of the keys, in groups, so that a key finds its bucket in two short scans."""
    steps = [i / buckets for i in range(1, buckets)]
    found = keys.agg(F.percentile_approx("doc", steps, 100 * buckets).alias("q")).first()["q"] or []
    found = sorted(set(found))
    width = max(1, math.isqrt(max(1, len(found))))
    return [found[i : i + width] for i in range(0, len(found), width)]


def _bucket(key: Column, bounds: list[list[int]]) -> Column:
    """How many bounds lie at or below the key."""
    if not bounds:
        return F.lit(0)
    width = len(bounds[0])
    coarse = F.size(F.filter(F.lit([b[0] for b in bounds]), lambda x: x <= key))
    fine = F.array(*[F.lit(b) for b in bounds])
    inside = F.size(F.filter(F.element_at(fine, F.greatest(coarse, F.lit(1))), lambda x: x <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + inside)


def neighbour_order(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket, guest, doc, text``, dealt by bucket and sorted so that each next document follows.

    Buckets are ranges of keys; the first document of a lower range is also sent to the
    range above as a guest, and the largest key to the lowest range, so every text is
    moved once and no sort or window spans the table. Rows without a key come last, as if
    their key were the smallest number.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(2**63)).cast("bigint")
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), lowest).alias("doc"), F.col(f"`{text}`").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select("doc")
    bounds = _bounds(keys, 4 * parts)
    # at most 4 * parts rows
    tops = sorted(
        (r["bucket"], r["top"])
        for r in keys.groupBy(_bucket(F.col("doc"), bounds).alias("bucket")).agg(F.max("doc").alias("top")).collect()
    )
    sent = [(top, tops[i + 1][0] if i + 1 < len(tops) else tops[0][0]) for i, (_, top) in enumerate(tops)]
    guests = spark.createDataFrame(sent, "top bigint, host int")
    placed = rows.join(F.broadcast(guests), F.col("doc") == F.col("top"), "left").select(
        "doc",
        "text",
        F.explode(
            F.filter(
                F.array(
                    F.struct(_bucket(F.col("doc"), bounds).alias("bucket"), F.lit(0).alias("guest")),
                    F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest")),
                ),
                lambda x: x["bucket"].isNotNull(),
            )
        ).alias("at"),
    )
    dealt = placed.select("at.bucket", "at.guest", "doc", "text").repartition(parts, "bucket")
    return dealt.sortWithinPartitions("bucket", "guest", F.col("doc").desc(), F.col("text").asc_nulls_first())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _with_next(rows: Iterator[tuple[int, int, int, str]]) -> Iterator[tuple[int, str, str]]:
    """``doc, text, text of the next document``; rows of one key share the next, its smallest text."""
    group: list[str] = []
    at: tuple | None = None
    for bucket, guest, doc, text in rows:
        if at is not None and (bucket, guest, doc) != at:
            if at[1] == 0:  # guests only serve as the next of others
                same = bucket == at[0]
                for own in group:
                    yield at[2], own, text if same else own
            group = []
        elif at is not None and at[1] == 1:
            continue
        group.append(text)
        at = (bucket, guest, doc)
    if at is not None and at[1] == 0:
        for own in group:
            yield at[2], own, own


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Null texts are empty, and two texts without words are alike. Repeated rows give
    repeated results. With one document the next is itself. Further columns are not read;
    an empty table gives an empty result.
    """
    names = ("doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    schema = pa.schema(list(zip(names, types)))

    def made(items: list[tuple[int, str, str]]) -> pa.RecordBatch:
        changed = [edited(own, following) for _, own, following in items]
        place: dict[str, int] = {}
        for _, own, following in items:
            place.setdefault(own, len(place))
            place.setdefault(following, len(place))
        prints = signatures(pa.array([*place, *changed], pa.large_string()))
        own = prints[[place[x] for _, x, _ in items]]
        after = prints[[place[x] for _, _, x in items]]
        new = prints[len(place) :]
        low = -(2**63)
        return tx.table_rows(
            {
                "doc": [None if d == low else d for d, _, _ in items],
                "n_chars": [len(x) for _, x, _ in items],
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in changed],
                "fingerprint": _hex(own),
                "edited_fingerprint": _hex(new),
                "near_edited": (own == new).mean(axis=1),
                "near_next": (own == after).mean(axis=1),
            },
            schema,
        )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, str]]:
        for batch in tx.small_batches(batches, "text", _CHUNK):
            columns = [batch.column(i).to_pylist() for i in range(3)]
            yield from zip(*columns, [x or "" for x in batch.column(3).to_pylist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, str, str]] = []
        size = 0
        for item in _with_next(rows_of(batches)):
            items.append(item)
            size += len(item[1])
            if size > _CHUNK // 2:
                yield made(items)
                items, size = [], 0
        if items:
            yield made(items)

    spec = "doc bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbour_order(docs, key=key, text=text).mapInArrow(run, spec)


# --- near-duplicates ----------------------------------------------------------------


def _minhash_prints(docs: DataFrame, key: str, text: str) -> DataFrame:
    schema = pa.schema([("doc", pa.int64()), ("digest", pa.binary()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, "text", _CHUNK):
            rows = signatures(batch.column(2)).astype(">u2")
            yield tx.table_rows({"doc": batch.column(0), "digest": batch.column(1), "fp": [x.tobytes() for x in rows]}, schema)

    return named_texts(docs, key, text).mapInArrow(run, "doc bigint, digest binary, fp binary")


def _bands(fps: DataFrame) -> DataFrame:
    def band(i: int) -> Column:
        return F.xxhash64(F.lit(i), F.substring("fp", 1 + 2 * ROWS * i, 2 * ROWS))

    return fps.select(F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("bucket"), "fp")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """``doc, component_id``: documents linked by an exact Jaccard similarity of at least ``similarity``.

    Equal signatures are one class, so copies are compared once. Signatures that agree in
    a band are compared in blocks on the classes' shingle sets, which return spanning
    forests of the pairs that hold. Texts without words form one class.
    """
    prints = stage(_minhash_prints(docs, key, text), "minhash")
    classes = stage(class_rows(prints), "minhash-classes")
    sure = sure_links(_bands(classes), class_sets(classes, named_texts(docs, key, text), SHINGLE), similarity)
    roots = components(sure).withColumnRenamed("node", "fp")
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc", "component_id")
