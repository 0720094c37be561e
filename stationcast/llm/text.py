"""Helpers shared by the corpus operators: columns, words and vectorised word hashes.

A *word* is a maximal run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return, which is what ``bytes.split()`` gives; null texts have
no words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (9, 10, 11, 12, 13, 32)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand, one set per process."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            cls.up = _geometric(_BASE, size)
            cls.down = _geometric(_INVERSE, size)
        return cls.up, cls.down


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done, step = 1, base
    while done < n:  # doubles what is known: out[done:2*done] = out[:done] * base**done
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        step = step * step & _MASK
        done += take
    return out


#: Bytes above which a span is hashed on its own.
_LONG_SPAN = 1024


def content_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes after the other through a mixer; XXH64 for long spans.

    Unlike polynomial sums, these have no pairs of texts that collide whatever the base.
    """
    starts, sizes = np.asarray(starts, dtype=np.int64), np.asarray(ends - starts, dtype=np.int64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    found = mix64(sizes.astype(np.uint64) + np.uint64(_BASE))
    short = np.flatnonzero(sizes <= _LONG_SPAN)
    short = short[np.argsort(-sizes[short], kind="stable")]
    falling = -sizes[short]
    for k in range(0, _LONG_SPAN, 8):
        now = short[: np.searchsorted(falling, -k, side="left")]  # spans that go on beyond k bytes
        if not len(now):
            break
        left = np.minimum(sizes[now] - k, 8).astype(np.uint64)
        part = eights[starts[now] + k] & (np.uint64(_MASK) >> (np.uint64(64) - np.uint64(8) * left))
        found[now] = mix64(mix64(found[now] ^ part) + part * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(sizes > _LONG_SPAN):
        found[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes(), seed=_BASE >> 1)
    return found


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial sums before each byte; ``span_hashes`` takes overlapping spans from them.

    Texts can be constructed whose spans collide, so a match found by these is only a hint.
    """
    up, _ = _Powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand."""
    _, down = _Powers.to(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts])


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch in a row, and the offsets of the texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return raw[first:last], offsets - first


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the batch, and the number of words of each text."""
    n = len(data)
    inside = ~_IS_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] = inside[edges]  # a text's first byte opens a word
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] if n else True
    closes[edges - 1] = inside[edges - 1]
    ends = np.flatnonzero(closes) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and how many each text has.

    A text of fewer words has one shingle, the whole sequence; a text of none has none.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    got = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        part = np.zeros(n, dtype=np.uint64)
        left = max(n - k, 0)
        part[:left] = words[k:]
        if k:
            same = np.zeros(n, dtype=bool)
            same[:left] = owner[k:] == owner[:left]
            part[~same] = 0
        got = mix64(got * np.uint64(0xD6E8FEB86659FD93) + part + np.uint64(k + 1))
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    mine = np.maximum(counts - size + 1, np.minimum(counts, 1))
    return got[place < np.repeat(mine, counts)], mine


def small_batches(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, whole rows each.

    Spark's batches are bounded by rows; a few thousand very long texts in one batch
    would take many times their size in temporary arrays.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = batch_bytes(batch.column(column))
        total = offsets[1:]
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def table_rows(columns: dict[str, Sequence | np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
