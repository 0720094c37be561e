"""Quality classifier: a factorisation machine over hashed words, structure and length.

A text's features are its distinct words, hashed, whose values have length one together,
and one bin for each structure statistic (shares of symbols, capitals, repeated words,
repeated lines, exclamation marks, mean word and line length) and for its length. The
score is a logistic function of

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

the second sum being all pairwise interactions of low rank, computed in time linear in
the number of features by the sum-of-squares identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast.llm import text as tx
from stationcast.llm.quality_rules import batch_statistics

WORD_BITS = 14
RANK = 8
#: Labelled documents that the machine is fitted on, at most; those of the smallest hash.
MOST_ROWS = 12_000
EPOCHS = 6
_BINS = 24
_STATS = ("symbols", "capitals", "repeats", "dup_lines", "marks", "word_length", "line_length", "n_words", "length")
_WIDTH = (1 << WORD_BITS) + _BINS * len(_STATS)


@dataclass(frozen=True)
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, index: np.ndarray, value: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One number per text; every text has features, so no segment is empty."""
        if not len(counts):
            return np.zeros(0)
        at = np.cumsum(counts) - counts
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, at, axis=0)
        q = np.add.reduceat(vx * vx, at, axis=0)
        linear = np.add.reduceat(self.w[index] * value, at)
        return self.bias + linear + 0.5 * (s * s - q).sum(axis=1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, values and the number of features of each text of a batch."""
    data, offsets = tx.batch_bytes(texts)
    n = len(offsets) - 1
    lowered = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, counts = tx.word_spans(lowered, offsets)
    slot = (tx.content_hashes(lowered, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int64), counts)
    key, times = np.unique((owner << WORD_BITS) | slot, return_counts=True)
    value = np.log1p(times)
    who = key >> WORD_BITS
    norm = np.sqrt(np.bincount(who, weights=value * value, minlength=n))
    value = value / np.maximum(norm, 1e-12)[who]

    s = batch_statistics(texts)
    words, chars, lines = (np.maximum(s[c], 1) for c in ("n_words", "word_chars", "n_lines"))
    shares = {
        "symbols": s["n_symbols"] / chars,
        "capitals": s["n_upper"] / np.maximum(s["n_letters"], 1),
        "repeats": s["n_repeat_words"] / words,
        "dup_lines": s["n_dup_lines"] / lines,
        "marks": s["n_marks"] / chars,
    }
    # square roots spread small shares over the bins, logarithms the sizes
    bins = [np.minimum(np.ceil(np.sqrt(shares[c]) * (_BINS - 1)), _BINS - 1) for c in _STATS[:5]]
    sizes = [s["word_chars"] / words * 4, s["n_words"] / lines, s["n_words"], np.diff(offsets)]
    bins += [np.minimum(np.floor(1.5 * np.log1p(x)), _BINS - 1) for x in sizes]
    structure = np.stack([b.astype(np.int64) + (1 << WORD_BITS) + _BINS * k for k, b in enumerate(bins)], axis=1)

    index = np.concatenate([key & ((1 << WORD_BITS) - 1), structure.ravel()])
    values = np.concatenate([value, np.ones(structure.size)])
    owners = np.concatenate([who, np.repeat(np.arange(n), structure.shape[1])])
    order = np.argsort(owners, kind="stable")
    return index[order], values[order], np.bincount(owners, minlength=n)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> Machine:
    """Adaptive gradient descent on the logistic loss, in batches, from a fixed seed.

    Without rows of both classes the machine returns the labels' mean, 0.5 without any.
    """
    w, v = np.zeros(_WIDTH), np.zeros((_WIDTH, RANK))
    mean = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    bias = float(np.log(mean / (1 - mean)))
    if len(set(labels.tolist())) < 2:
        return Machine(bias, w, v)
    rng = np.random.default_rng(seed)
    v += rng.normal(0, 0.02, v.shape)
    gw, gv, gb = np.full(_WIDTH, 1e-4), np.full((_WIDTH, RANK), 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            counts = np.array([len(rows[i][0]) for i in chosen])
            machine = Machine(bias, w, v)
            error = 1 / (1 + np.exp(-machine.margins(index, value, counts))) - labels[chosen]
            error /= len(chosen)
            starts = np.cumsum(counts) - counts
            vx = v[index] * value[:, None]
            s = np.repeat(np.add.reduceat(vx, starts, axis=0), counts, axis=0)
            e = np.repeat(error, counts) * value
            by = np.argsort(index, kind="stable")
            slots, first = np.unique(index[by], return_index=True)
            dw = np.add.reduceat(e[by], first) + 1e-6 * w[slots]
            dv = np.add.reduceat((e[:, None] * (s - vx))[by], first, axis=0) + 1e-5 * v[slots]
            gw[slots] += dw * dw
            gv[slots] += dv * dv
            gb += error.sum() ** 2
            w[slots] -= 0.15 * dw / np.sqrt(gw[slots])
            v[slots] -= 0.03 * dv / np.sqrt(gv[slots])
            bias -= 0.05 * error.sum() / gb**0.5
    return Machine(bias, w, v)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS) -> Machine:
    """Fit on at most ``most_rows`` labelled documents; ``labels`` has ``key`` and ``good`` (boolean).

    The bound is on the fit alone: a linear-size model gains nothing from more rows, and
    the sample reaches the driver as sparse features. Null labels and keys are left out;
    a key with two labels counts with both.
    """
    known = labels.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col("good").cast("boolean").alias("good"))
    known = known.filter("doc is not null and good is not null")
    chosen = known.orderBy(F.xxhash64("doc"), "doc", "good").limit(most_rows)
    # at most most_rows rows of two narrow columns
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc").select("doc", "good", "text")
    schema = pa.schema([("doc", pa.int64()), ("good", pa.bool_()), ("index", pa.binary()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, "text", 2 << 20):
            index, value, counts = features(batch.column(2))
            ends = np.cumsum(counts)
            spans = list(zip((ends - counts).tolist(), ends.tolist()))
            yield tx.table_rows(
                {
                    "doc": batch.column(0),
                    "good": batch.column(1),
                    "index": [index[a:b].astype("<u2").tobytes() for a, b in spans],
                    "value": [value[a:b].astype("<f4").tobytes() for a, b in spans],
                },
                schema,
            )

    found = joined.mapInArrow(run, "doc bigint, good boolean, index binary, value binary").toArrow()
    found = found.sort_by([("doc", "ascending"), ("good", "ascending")])
    rows = [
        (np.frombuffer(i, dtype="<u2").astype(np.int64), np.frombuffer(x, dtype="<f4").astype(float))
        for i, x in zip(found["index"].to_pylist(), found["value"].to_pylist())
    ]
    # rows that repeat a document come in any order, but equal; so the fit does not change
    return fit(rows, np.array(found["good"].to_pylist(), dtype=float))


def score(docs: DataFrame, machine: Machine, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, 0 to 1; all other columns as they are.

    Null and empty texts have structure features only and get a score too. An existing
    column of that name is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    model = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size: _WIDTH rows of RANK + 1 numbers
    at = kept.index(text)
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, at, 2 << 20):
            margin = model.value.margins(*features(batch.column(at)))
            scores = pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))), type=pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return base.mapInArrow(run, out)
