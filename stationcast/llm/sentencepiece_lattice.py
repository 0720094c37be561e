"""SentencePiece encoding by a relational lattice, and decoding.

Texts are cut into chunks that no piece of the model spans: at every space, which becomes
the first character of what follows, at line feeds and, if no piece of the model goes on
there, after Latin letters that something else follows. Distinct chunks are
encoded once: all their substrings up to the length of the longest piece that begins with
the same three characters are exploded, joined to the piece table, the matches (edges) grouped by chunk, and the best path folded from left
to right with the higher-order ``aggregate``: for each end the best score over all edges
into it, ties going to the earliest start, and a character that is no piece costs
``UNKNOWN_PENALTY`` more than the worst piece and is written as its bytes. That is the
Viterbi search of a unigram model over the pieces of the file. Of a file whose scores are
merge ranks it takes the pieces and ids, with log-probabilities made from the ranks; such
ids decode to the same text, but are not always those that merging in order gives.

Encoded chunks are then laid over the texts, in one way for every size. The most frequent ones
of a bounded sample of the texts, ``MOST_CHUNKS`` at most, are encoded first and broadcast; which
ones these are changes no result. Texts are taken in packs of about ``_PACK_BYTES``; every chunk
of a pack that is not in the table is encoded once for the corpus, and the pack, compressed,
meets its own by a join. So a text is moved once and packed, and only rare chunks beside it.

A chunk of over ``LONG`` characters (a line of Chinese, a run of digits or spaces) is not cut
either: it has no place in the tables and gets the same search, in time linear in its length,
where it is met in a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import text as tx
from stationcast.session import stage

SPACE = "\u2581"
CHUNK = "\\n|\u2581+[^\u2581\\n]*|[^\u2581\\n]+"
# Letters of Latin alphabets.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_OTHER = f"[^{_LATIN}\u2581\\n]"
#: Chunks that also end after Latin letters, for models without a piece that goes on there.
FINE_CHUNK = f"\\n|\u2581+{_OTHER}*[{_LATIN}]*|{_OTHER}+[{_LATIN}]*|[{_LATIN}]+"
#: Runs that chunks of either kind are parts of.
_RUN = CHUNK
#: Characters of a chunk that is encoded once for the whole corpus; longer ones hardly repeat.
LONG = 64
#: Chunks hashed at a time in a task.
_AT_ONCE = 1 << 16
#: Text that is packed and laid over at a time, about.
_PACK_BYTES = 2 << 20
_PACKING = pa.Codec("zstd", compression_level=6)
#: Chunks that one task encodes, about.
_TASK_CHUNKS = 25_000
UNKNOWN_PENALTY = 10.0
#: A substring that begins with this many characters need be no longer than the longest piece that does.
HEAD = 3
#: Chunks in the broadcast table, at most; about 20 bytes each.
MOST_CHUNKS = 500_000
#: Text from which the chunks of the table are chosen, about; all texts are encoded, whatever it holds.
SAMPLE_BYTES = 128 << 20

# The kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


#: Kind of a model file whose scores are merge ranks, and the offset of the law that makes them probabilities.
BPE_MODEL = 2
RANK_OFFSET = 50.0


def log_probabilities(scores: list[float]) -> list[float]:
    """Scores of a file whose scores are negative merge ranks, as log-probabilities.

    Ranks do not add up along a path; frequencies fall about as one over the rank, which
    gives a unigram model of the same pieces. Pieces set to be last get the last rank.
    """
    ranks = np.minimum(-np.array(scores), len(scores)) + RANK_OFFSET
    return (-np.log(ranks) - np.log((1 / ranks).sum())).tolist()


@dataclass(frozen=True)
class Model:
    """Pieces by id, with scores and kinds."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]

    @staticmethod
    def load(path: str) -> Model:
        """Read on the driver; the model has some tens of thousands of pieces."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        scores = [float(p.score) for p in spec.pieces]
        if spec.trainer_spec.model_type == BPE_MODEL:
            scores = log_probabilities(scores)
        return Model(tuple(p.piece for p in spec.pieces), tuple(scores), tuple(int(p.type) for p in spec.pieces))

    def edges(self) -> list[tuple[str, int, float]]:
        found = [(p, i, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds)) if k in (NORMAL, USER_DEFINED)]
        for piece, _, _ in found:
            if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                raise ValueError(f"piece {piece!r} spans chunks")
        return found

    def chunk_pattern(self) -> str:
        crosses = re.compile(f"[{_LATIN}][^{_LATIN}]")
        return CHUNK if any(crosses.search(p) for p, _, _ in self.edges()) else FINE_CHUNK

    def byte_ids(self) -> list[int]:
        ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        return [ids[f"<0x{b:02X}>"] for b in range(256)]

    def decoder(self) -> list[bytes]:
        out = []
        for piece, kind in zip(self.pieces, self.kinds):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            else:
                out.append(b"" if kind in (CONTROL, UNKNOWN) else piece.replace(SPACE, " ").encode())
        return out


def marked(text: Column) -> Column:
    """The text with its spaces as marks and one mark before it; empty stays empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE))))


def chunk_counts(docs: DataFrame, text: str = "text", pattern: str = CHUNK) -> DataFrame:
    """``chunk, n``: distinct chunks of up to ``LONG`` characters; runs are counted inside tasks first, and only distinct runs are cut finer."""
    runs = F.regexp_extract_all(marked(F.col(f"`{text}`")), F.lit(_RUN), F.lit(0))
    counted = docs.select(F.explode(runs).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.regexp_extract_all("run", F.lit(pattern), F.lit(0))
    short = counted.select(F.explode(chunks).alias("chunk"), "n").filter(F.char_length("chunk") <= LONG)
    return short.groupBy("chunk").agg(F.sum("n").alias("n"))


def encode_chunks(chunks: DataFrame, model: Model) -> DataFrame:
    """``chunk, n, ids`` by the lattice; ``chunks`` is a stored table of distinct ``chunk`` with ``n``."""
    spark = chunks.sparkSession
    edges = model.edges()
    table = spark.createDataFrame(edges, "piece string, id int, score double")  # one row per piece of the file
    unknown = min((s for _, _, s in edges), default=0.0) - UNKNOWN_PENALTY
    size = F.char_length("chunk")

    heads: dict[str, int] = {}
    for piece, _, _ in edges:
        if len(piece) >= HEAD:
            heads[piece[:HEAD]] = max(len(piece), heads.get(piece[:HEAD], 0))
    reach = spark.createDataFrame(list(heads.items()), "head string, reach int")  # at most one row per piece of the file

    # edges take about a hundred times a chunk's bytes: small tasks order them in memory, and sorted chunks leave little to order
    tasks = chunks.count() // _TASK_CHUNKS + 1
    spread = chunks.repartition(tasks, "chunk").sortWithinPartitions("chunk")
    starts = spread.select("chunk", "n", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    known = starts.withColumn("head", F.substring("chunk", F.col("start"), F.lit(HEAD))).join(F.broadcast(reach), "head", "left")
    until = F.least(size, F.col("start") + F.coalesce("reach", F.lit(HEAD - 1)) - 1)
    spans = known.select("chunk", "n", "start", F.explode(F.sequence(F.col("start"), until)).alias("end")).withColumn(
        "piece", F.substring("chunk", F.col("start"), F.col("end") - F.col("start") + 1)
    )
    lattice = (
        spans.join(F.broadcast(table), "piece", "left")
        .filter("id is not null or start = end")  # a character that is no piece keeps its place
        .groupBy("chunk", "n")
        .agg(F.array_sort(F.collect_list(F.struct("end", "start", "id", F.coalesce("score", F.lit(unknown)).alias("score")))).alias("edges"))
    )
    # edges come by end, then start: the fold meets every edge after all edges into its start
    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(-1).alias("id")))

    def step(best: Column, e: Column) -> Column:
        total = F.element_at(best, e["start"])["score"] + e["score"]
        here = F.struct(total.alias("score"), e["start"].alias("start"), F.coalesce(e["id"], F.lit(-1)).alias("id"))
        fresh = F.size(best) == e["end"]  # the first edge into this end
        better = total > F.element_at(best, -1)["score"]
        changed = F.concat(F.slice(best, F.lit(1), F.size(best) - 1), F.array(here))
        return F.when(fresh, F.array_append(best, here)).when(better, changed).otherwise(best)

    folded = lattice.select("chunk", "n", F.aggregate("edges", zero, step).alias("best"))
    back = F.struct(size.alias("at"), F.array().cast("array<struct<start:int,id:int>>").alias("path"))

    def walk(s: Column, _: Column) -> Column:
        into = F.element_at("best", s["at"] + 1)
        here = F.struct(into["start"].alias("start"), into["id"].alias("id"))
        return F.when(s["at"] < 1, s).otherwise(F.struct((into["start"] - 1).alias("at"), F.array_prepend(s["path"], here).alias("path")))

    walked = folded.select("chunk", "n", F.aggregate(F.sequence(F.lit(1), size), back, walk, lambda s: s["path"]).alias("path"))
    byte_ids = F.array(*[F.lit(i) for i in model.byte_ids()]) if BYTE in model.kinds else None

    def ids_of(p: Column) -> Column:
        if byte_ids is None:
            return F.array(F.greatest(p["id"], F.lit(model.kinds.index(UNKNOWN))))
        digits = F.hex(F.encode(F.substring("chunk", p["start"], F.lit(1)), "UTF-8"))
        places = F.sequence(F.lit(1), F.char_length(digits), F.lit(2))
        values = F.transform(places, lambda i: F.element_at(byte_ids, (F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int") + 1)))
        return F.when(p["id"] >= 0, F.array(p["id"])).otherwise(values)

    return walked.select("chunk", "n", F.flatten(F.transform("path", ids_of)).alias("ids"))


@dataclass(frozen=True)
class LongChunks:
    """The search of ``encode_chunks`` for one chunk of any length."""

    pieces: dict[str, tuple[int, float]]
    longest: int
    unknown: float
    byte_ids: list[int] | None
    unknown_id: int

    @staticmethod
    def of(model: Model) -> LongChunks:
        edges = model.edges()
        return LongChunks(
            {p: (i, s) for p, i, s in edges},
            max((len(p) for p, _, _ in edges), default=1),
            min((s for _, _, s in edges), default=0.0) - UNKNOWN_PENALTY,
            model.byte_ids() if BYTE in model.kinds else None,
            model.kinds.index(UNKNOWN) if UNKNOWN in model.kinds else 0,
        )

    def ids(self, chunk: str) -> np.ndarray:
        """Starts come in order, so that the earliest keeps a tie, as in the fold."""
        n, get = len(chunk), self.pieces.get
        best, start, into = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for s in range(n):
            for e in range(s + 1, min(n, s + self.longest) + 1):
                found = get(chunk[s:e])
                if found is None:
                    if e > s + 1:
                        continue
                    found = -1, self.unknown
                total = best[s] + found[1]
                if total > best[e]:
                    best[e], start[e], into[e] = total, s, found[0]
        out: list[int] = []
        at = n
        while at:
            if into[at] >= 0:
                out.append(into[at])
            elif self.byte_ids is None:
                out.append(self.unknown_id)
            else:
                out += [self.byte_ids[b] for b in reversed(chunk[start[at] : at].encode())]
            at = start[at]
        return np.array(out[::-1], dtype=np.uint32)


@dataclass(frozen=True)
class ChunkTable:
    """Ids of chunks by a 64-bit hash, in flat arrays."""

    hashes: np.ndarray
    begins: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(chunks: DataFrame) -> ChunkTable:
        """Hashes are made in tasks; the driver gets them and the ids, as many as the caller allows."""
        schema = pa.schema([("hash", pa.int64()), ("ids", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [np.array(x, dtype="<u4").tobytes() for x in batch.column(1).to_pylist()]
                yield tx.table_rows({"hash": chunk_hashes(batch.column(0)).view(np.int64), "ids": lists}, schema)

        rows = chunks.select("chunk", "ids").mapInArrow(run, "hash bigint, ids binary").toArrow()
        hashes = np.asarray(rows["hash"]).view(np.uint64)
        data, offsets = tx.batch_bytes(rows["ids"])
        flat = np.frombuffer(data.tobytes(), dtype="<u4")
        if not len(flat) or flat.max() < 1 << 16:
            flat = flat.astype(np.uint16)  # every Python worker holds the table
        order = np.argsort(hashes)
        if (hashes[order][1:] == hashes[order][:-1]).any():
            raise ValueError("two chunks share a hash")
        begins = offsets // 4
        sizes = np.diff(begins)[order]
        new = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.repeat(begins[:-1][order] - new[:-1], sizes) + np.arange(new[-1])
        return ChunkTable(hashes[order], new.astype(np.uint32), flat[taken])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def chunk_hashes(chunks: pa.Array) -> np.ndarray:
    data, offsets = tx.batch_bytes(pc.replace_substring(chunks, SPACE, " "))
    return tx.content_hashes(data, offsets[:-1], offsets[1:])


_OTHER_KIND, _LATIN_KIND, _MARK_KIND, _LINE_KIND, _LATIN_LEAD = range(5)
#: Kinds of first bytes; those of two-byte Latin letters are told from others by their second.
_KINDS = np.full(256, _OTHER_KIND, dtype=np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]] = _LATIN_KIND
_KINDS[32], _KINDS[10] = _MARK_KIND, _LINE_KIND
_KINDS[0xC3:0xCA] = _LATIN_LEAD


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of the texts as ``marked`` makes them, with a space for every mark."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return tx.batch_bytes(pc.if_else(pc.equal(texts, nothing), texts, pc.binary_join_element_wise(space, texts, nothing)))


def cut_chunks(data: np.ndarray, offsets: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of spaced texts, and how many each text has: ``FINE_CHUNK`` or ``CHUNK`` over bytes."""
    kind = _KINDS[data]
    lead = np.flatnonzero(kind == _LATIN_LEAD)
    first, second = data[lead], data[lead + 1]
    other = (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC9) & (second > 0x8F)
    kind[lead] = kind[lead + 1] = np.where(other, _OTHER_KIND, _LATIN_KIND)
    opens = np.zeros(len(data), dtype=bool)
    now, before = kind[1:], kind[:-1]
    opens[1:] = (now == _LINE_KIND) | (before == _LINE_KIND) | (now == _MARK_KIND) & (before != _MARK_KIND)
    if fine:
        opens[1:] |= (now == _OTHER_KIND) & (before == _LATIN_KIND)
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(opens)
    return starts, np.append(starts[1:], len(data)), np.diff(np.searchsorted(starts, offsets))


@dataclass(frozen=True)
class Cut:
    """The chunks of a batch of texts and their places in a table, -1 where there is none."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    rare: np.ndarray
    rare_at: np.ndarray

    @staticmethod
    def of(texts: pa.Array, known: ChunkTable, fine: bool) -> Cut:
        """``rare`` has the hashes of the chunks without a place, each once, ``rare_at`` one chunk of each."""
        data, offsets = spaced(texts)
        starts, ends, counts = cut_chunks(data, offsets, fine)
        places = np.full(len(starts), -1, dtype=np.int32)
        hashes, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i in range(0, len(starts), _AT_ONCE):
            low, high = starts[i : i + _AT_ONCE], ends[i : i + _AT_ONCE]
            found = tx.content_hashes(data[low[0] : high[-1]], low - low[0], high - low[0])
            places[i : i + _AT_ONCE] = known.find(found)
            out = np.flatnonzero(places[i : i + _AT_ONCE] < 0)
            own, where = np.unique(found[out], return_index=True)
            hashes.append(own)
            at.append(out[where] + i)
        rare, where = np.unique(np.concatenate(hashes), return_index=True)
        return Cut(data, starts, ends, counts, places, rare, np.concatenate(at)[where])

    def chunk(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode().replace(" ", SPACE)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return tx.content_hashes(self.data, self.starts[at], self.ends[at])


def pack_mark(texts: pa.Array) -> int:
    """Packs of other texts have other marks; equal packs have the same chunks, so they may share one."""
    data, offsets = tx.batch_bytes(texts)
    mark = xxhash.xxh64(offsets.tobytes())
    mark.update(data.tobytes())
    return mark.intdigest() - (1 << 63)


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_PACKING)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def frequent_chunks(docs: DataFrame, text: str, key: str, pattern: str, most: int) -> DataFrame:
    """``chunk, n`` of the chunks met most often in the sample, ``most`` at most; all or none of equal counts."""
    column = F.col(f"`{text}`")
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    mark = F.xxhash64(column, *[F.col(f"`{c}`").cast("string") for c in docs.columns if c == key])
    sample = docs.filter(F.pmod(mark, F.lit(size // SAMPLE_BYTES + 1)) == 0)
    counts = stage(chunk_counts(sample, text, pattern), "chunks")
    least, total = 1 << 62, 0
    for n, chunks in counts.groupBy("n").agg(F.count(F.lit(1))).orderBy(F.desc("n")).collect():  # a row per count, a few thousand
        total += chunks
        if total > most:
            break
        least = n
    return counts.filter(F.col("n") >= least)


def encode(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int), all other columns as they are.

    Null and empty texts have no ids. Repeated rows give repeated results; an existing
    column ``ids`` is replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pattern = model.chunk_pattern()
    fine = pattern == FINE_CHUNK
    table = spark.sparkContext.broadcast(ChunkTable.of(encode_chunks(frequent_chunks(docs, text, key, pattern, most_chunks), model)))
    long = spark.sparkContext.broadcast(LongChunks.of(model))
    kept = [c for c in docs.columns if c.lower() != "ids"]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    schema = pa.schema([("pack", pa.int64()), ("chunk", pa.string())])
    packed = pa.schema([("pack", pa.int64()), ("rows", pa.binary())])

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, at, _PACK_BYTES):
            cut = Cut.of(batch.column(at), table.value, fine)
            chunks = [c for c in map(cut.chunk, cut.rare_at.tolist()) if len(c) <= LONG]
            yield tx.table_rows({"pack": [pack_mark(batch.column(at))] * len(chunks), "chunk": chunks}, schema)
        pa.default_memory_pool().release_unused()  # idle workers stay while other stages need the memory

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, at, _PACK_BYTES):
            yield tx.table_rows({"pack": [pack_mark(batch.column(at))], "rows": [pack(batch)]}, packed)
        pa.default_memory_pool().release_unused()

    needed = base.mapInArrow(missing, "pack bigint, chunk string")
    rare = stage(needed.groupBy("chunk").agg(F.collect_set("pack").alias("packs")), "rare-chunks")
    coded = encode_chunks(rare.select("chunk", F.lit(1).alias("n")), model)
    own = coded.join(rare, "chunk").select(F.explode("packs").alias("pack"), "chunk", "ids")
    more = own.groupBy("pack").agg(F.collect_list(F.struct("chunk", "ids")).alias("more"))
    joined = base.mapInArrow(packs, "pack bigint, rows binary").join(more, "pack", "left").select("rows", "more")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, chunks in zip(*batch.columns):
                with pa.ipc.open_stream(rows.as_buffer()) as stream:
                    for part in stream:
                        yield _with_ids(part, at, chunks.values, table.value, long.value, fine)

    return joined.mapInArrow(lay, f"{spec}, ids array<int>")


def _with_ids(batch: pa.RecordBatch, at: int, more: pa.StructArray | None, known: ChunkTable, long: LongChunks, fine: bool) -> pa.RecordBatch:
    """The batch and its ids, from the table, from ``more`` and, for long chunks, by the search.

    A chunk in neither is searched too: packs that come in another order when Spark reads them again have others' chunks.
    """
    cut = Cut.of(batch.column(at), known, fine)
    ids_of: dict[int, np.ndarray] = {}
    if more is not None and len(cut.rare):
        lists = more.field("ids")
        flat, begins = np.asarray(lists.values), np.asarray(lists.offsets)
        ids_of = {h: flat[b:e] for h, b, e in zip(chunk_hashes(more.field("chunk")).tolist(), begins[:-1].tolist(), begins[1:].tolist())}
    extra = [ids_of[h] if h in ids_of else long.ids(cut.chunk(i)) for h, i in zip(cut.rare.tolist(), cut.rare_at.tolist())]
    ids = np.concatenate([known.ids.astype(np.int32), *extra], dtype=np.int32, casting="unsafe")
    begins = np.concatenate([known.begins.astype(np.int64), len(known.ids) + np.cumsum([len(x) for x in extra], dtype=np.int64)])
    out = np.flatnonzero(cut.places < 0)
    places = cut.places.astype(np.int64)
    for i in range(0, len(out), _AT_ONCE):
        some = out[i : i + _AT_ONCE]
        places[some] = len(known.hashes) + np.searchsorted(cut.rare, cut.hashes(some))
    first = begins[places]
    sizes = begins[places + 1] - first
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = ids[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
    offsets = ends[np.concatenate([[0], np.cumsum(cut.counts)])].astype(np.int32)
    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "ids"])


def decode(rows: DataFrame, model: Model, *, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with a text column ``name`` from the ids; null ids give null.

    Decoding gives the text back, except that a text's own U+2581 reads as a space. The
    mark before the text is taken away, broken bytes become U+FFFD.
    """
    kept = [c for c in rows.columns if c.lower() != name.lower()]
    pieces = F.split(F.lit(",".join(b.hex() for b in model.decoder())), ",")  # folded to one array by the optimizer
    digits = F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: F.element_at(pieces, i + 1)), "")
    read = rows.select(*[F.col(f"`{c}`") for c in kept], F.make_valid_utf8(F.unhex(digits).cast("string")).alias(name))
    text = F.col(f"`{name}`")
    bare = F.when(F.startswith(text, F.lit(" ")), F.substring(text, 2, (1 << 31) - 1)).otherwise(text)
    return read.select(*[F.col(f"`{c}`") for c in kept], bare.alias(name))


def default_model() -> str:
    """Path of the public model file of the installed package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def session_model(spark: SparkSession, path: str | None = None) -> Model:
    """The model named by ``spark.stationcast.pieceModel``, the public one where that is unset."""
    return Model.load(path or spark.conf.get("spark.stationcast.pieceModel", None) or default_model())
