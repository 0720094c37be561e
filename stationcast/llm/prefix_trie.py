"""Prefix trie of conversations, built in sorted shards around a skeleton.

A conversation is a path: one 16-byte token a turn, cut from the SHA-256 of its role and text,
so the bytes of paths sort like sequences of turns and every trie node is an interval of the
sorted conversations. Range splitters cut that order into shards. A node whose interval a
splitter cuts is a proper prefix of the splitter: those nodes, the *skeleton*, are few and are
broadcast. Every other node lies in one shard, which finishes it alone: the shard's paths come
sorted, and a stack of the open nodes of the current path is all that is held. A shard hands
in partial aggregates for the skeleton nodes it has a part of; these are added up, one row per
node, and the sums of the skeleton's own subtrees are made from them.

Bounds. Splitters are the shortest prefixes that separate neighbouring paths of a bounded
sample, at most ``MOST_SHARDS`` of at most ``SPLITTER_TURNS`` turns, so the skeleton has a fixed
bound whatever the data. The sample only balances the shards. Paths alike in more turns than
that stay in one shard, as do equal paths; they are read as a stream. One conversation is one
row of 20 bytes a turn; its texts stay where they are.

Defined results: null roles and texts are empty; null turns come first, and rows of equal
turns are ordered by their token; null ids are one conversation, whose decimal id is empty
and which is the smallest member only where it is the only one; repeated rows are turns of
their own; no rows give no nodes; further columns are not read. Ids are cast to bigint, and
text that is no number raises.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.llm import text as tx
from stationcast.session import stage

TOKEN = 16
#: Shards at most, turns of a splitter, and sampled conversations that splitters are taken from.
MOST_SHARDS = 512
SPLITTER_TURNS = 64
SAMPLE = 4096

_NODE = (
    "skeleton int, conv_id bigint, depth bigint, parent int, parent_conv_id bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string"
)
_ARROW = pa.schema(
    [
        ("skeleton", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.int32()),
        ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends_sha256", pa.string()),
    ]
)
_NOTHING = hashlib.sha256().hexdigest()


def paths(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: the tokens and word counts of each conversation, in order."""
    who, said = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the length keeps (ab, c) apart from (a, bc)
    whole = F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said)
    turns = rows.select(
        F.col(f"`{conv}`").cast("bigint").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").cast("bigint").alias("turn"),
            F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * TOKEN)).alias("token"),
            tx.word_count(said).cast("int").alias("words"),
        ).alias("t"),
    )
    found = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return found.select("conv_id", F.transform("t", lambda t: F.struct(t["token"], t["words"])).alias("turns"))


def rebased(found: DataFrame, *, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin with the first turns of another one.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % every``, as many as there
    are, and goes on with its own turns after its first ``h``; ``h`` is the CRC-32 of the decimal
    id modulo ``most``. A null id begins with nothing.
    """
    heads = found.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head")
    )
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, F.lit(0)).cast("int")
    none = F.array().cast(found.schema["turns"].dataType)
    known = found.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)
    return known.join(heads, "base", "left").select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
        ).alias("turns"),
    )


def path_bytes(turns: Column) -> Column:
    return F.concat(F.lit(b""), F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["token"])), "")))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start."""
    most = min(len(a), len(b)) // TOKEN
    if a[: most * TOKEN] == b[: most * TOKEN]:
        return most
    low, high = 0, most - 1
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * TOKEN] == b[: middle * TOKEN]:
            low = middle
        else:
            high = middle - 1
    return low


@dataclass(frozen=True)
class Skeleton:
    """Splitters in order, and every proper prefix of one with its number; the root is 0."""

    splitters: list[bytes]
    number: dict[bytes, int] = field(default_factory=dict)

    @classmethod
    def of(cls, sample: list[bytes], shards: int) -> Skeleton:
        """Splitters at even places of the sample, each the shortest prefix above the path before it."""
        ordered = sorted(sample)
        splitters: list[bytes] = []
        for k in range(1, shards):
            at = k * len(ordered) // shards
            if 0 < at < len(ordered) and ordered[at] != ordered[at - 1]:
                part = ordered[at][: (shared(ordered[at - 1], ordered[at]) + 1) * TOKEN]
                if not splitters or part > splitters[-1]:
                    splitters.append(part)
        number = {b"": 0}
        for s in splitters:
            for d in range(1, len(s) // TOKEN):
                number.setdefault(s[: d * TOKEN], len(number))
        return cls(splitters, number)


class Open:
    """A node of the current path, its subtree not yet finished."""

    __slots__ = ("skeleton", "words", "least", "n_convs", "n_children", "n_leaves", "saved", "ends", "waiting")

    def __init__(self, skeleton: int | None, words: int) -> None:
        self.skeleton, self.words = skeleton, words
        self.least: int | None = None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.ends = None
        self.waiting: list[tuple] = []

    def end(self, conv: int | None) -> None:
        """One more conversation whose last turn this is; they come in order of their ids."""
        decimal = b"" if conv is None else str(conv).encode()
        if self.ends is None:
            self.ends = hashlib.sha256(decimal)
        else:
            self.ends.update(b"," + decimal)
        self.n_convs += 1
        self.least = smaller(self.least, conv)


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def walk(sorted_paths: Iterator[tuple[int | None, int, bytes, list[int]]], number: dict[bytes, int]) -> Iterator[tuple]:
    """Rows of ``_NODE`` from ``(conv_id, shard, path, words of each turn)`` in order of shard, path and id."""
    stack: list[Open] = []
    before, shard = b"", None

    def close() -> Iterator[tuple]:
        node = stack.pop()
        depth = len(stack)
        ends = node.ends.hexdigest() if node.ends else None
        if node.skeleton is not None:
            # a part: leaves and savings of the finished subtrees below it
            if stack:
                stack[-1].n_convs += node.n_convs
                stack[-1].least = smaller(stack[-1].least, node.least)
            yield (node.skeleton, node.least, depth, None, None, node.n_convs, node.n_children, node.n_leaves, node.saved, node.words, ends)
            return
        leaves = node.n_leaves or 1
        saved = node.saved + (node.n_convs - 1) * node.words
        for child in node.waiting:
            yield (*child[:4], node.least, *child[5:])
        above = stack[-1]
        above.n_convs += node.n_convs
        above.least = smaller(above.least, node.least)
        above.n_children += 1
        above.n_leaves += leaves
        above.saved += saved
        done = (None, node.least, depth, above.skeleton, None, node.n_convs, node.n_children, leaves, saved, None, ends or _NOTHING)
        if above.skeleton is None:
            above.waiting.append(done)  # until its parent's smallest member is known
        else:
            yield done

    for conv, place, path, words in sorted_paths:
        keep = 0
        if place == shard:
            keep = shared(before, path) + 1
        while len(stack) > keep:
            yield from close()
        shard, before = place, path
        for depth in range(len(stack), len(path) // TOKEN + 1):
            # below a node that is not in the skeleton there is none that is
            known = number.get(path[: depth * TOKEN]) if not stack or stack[-1].skeleton is not None else None
            stack.append(Open(known, words[depth - 1] if depth else 0))
        stack[-1].end(conv)
    while stack:
        yield from close()


def build(found: DataFrame, *, shards: int | None = None) -> DataFrame:
    """All nodes of the trie of ``found`` (``conv_id, turns`` as ``paths`` gives them, one row a conversation).

    Per node ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    spark = found.sparkSession
    if shards is None:
        shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(shards, MOST_SHARDS))
    whole = stage(
        found.select("conv_id", path_bytes(F.col("turns")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")),
        "trie-paths",
    )
    head = F.expr(f"substring(path, 1, {SPLITTER_TURNS * TOKEN})")
    sample = whole.select(head.alias("head"), F.xxhash64("conv_id").alias("at")).orderBy("at").limit(SAMPLE).toArrow()
    skeleton = Skeleton.of(sample["head"].to_pylist(), shards)
    cuts = spark.sparkContext.broadcast(skeleton)  # at most MOST_SHARDS * SPLITTER_TURNS short prefixes

    @F.pandas_udf("int")
    def shard_of(heads: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts.value.splitters, bytes(h)) for h in heads], dtype="int32")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in walk(rows(batches), cuts.value.number):
            held.append(row)
            if len(held) == 8192:
                yield tx.table_rows(dict(zip(_ARROW.names, zip(*held))), _ARROW)
                held = []
        if held:
            yield tx.table_rows(dict(zip(_ARROW.names, zip(*held))), _ARROW)

    # a splitter longer than the head does not occur, so heads compare with splitters as paths do
    ordered = (
        whole.select("conv_id", shard_of(head).alias("shard"), "path", "words")
        .repartition("shard")
        .sortWithinPartitions("shard", "path", F.col("conv_id").asc_nulls_first())
    )
    nodes = stage(ordered.mapInArrow(run, _NODE), "trie-nodes")
    top = skeleton_nodes(nodes, skeleton)
    smallest = top.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("of_parent"))
    rest = nodes.filter("skeleton is null").join(F.broadcast(smallest), "parent", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = rest.withColumn("parent_conv_id", F.coalesce("of_parent", "parent_conv_id")).select(*columns)
    return below.unionByName(top.select(*columns))


def skeleton_nodes(nodes: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Skeleton nodes: the shards' parts added up, then sums over the skeleton's own subtrees.

    The parts are added up by Spark; what reaches the driver is one row per skeleton node,
    of which there are at most ``MOST_SHARDS * SPLITTER_TURNS``.
    """
    parts = nodes.filter("skeleton is not null").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("words").alias("words"),
        F.max("ends_sha256").alias("ends_sha256"),  # equal paths share a shard, so one part at most has it
    )
    got = {r["skeleton"]: r.asDict() for r in parts.collect()}
    above = {n: skeleton.number[path[:-TOKEN]] for path, n in skeleton.number.items() if path}
    for n in sorted(got, key=lambda n: -got[n]["depth"]):
        node = got[n]
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        if n:
            parent = got[above[n]]
            parent["n_children"] += 1
            parent["n_leaves"] += node["n_leaves"]
            parent["saved_tokens"] += node["saved_tokens"]
    out = [
        (n, x["conv_id"], x["depth"], got[above[n]]["conv_id"] if n else None, x["n_convs"], x["n_children"], x["n_leaves"],
         x["saved_tokens"], x["ends_sha256"] or _NOTHING)
        for n, x in got.items()
    ]
    schema = (
        "skeleton int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint,"
        " n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    )
    return nodes.sparkSession.createDataFrame(out, schema)
