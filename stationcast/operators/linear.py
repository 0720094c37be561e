"""Linear models from Gram statistics: ridge with chronological validation, OLS.

One scan adds up ``ZᵀZ`` of ``Z = [features, label, 1]`` per key and fold block.
Every fold and every penalty is then solved from those small matrices, so the
rows are read once however many fits are needed, and nothing that grows with the
rows leaves the tasks.  Wide matrices are added up in tiles, pairs of feature blocks,
each by a scan of the columns of its two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast.functions.names import ref
from stationcast.operators.buckets import keys_list, lookup_join
from stationcast.operators.splits import FOLDS, fold_limits, time_series_folds
from stationcast.session import stage

# Penalties tried, weakest first.
RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0)
_TILE = 2_048  # features of a block; a tile of two blocks takes at most 34 MB
_HELD_BYTES = 256 * 1024 * 1024
# Partial matrices are added up in two steps, over groups of so many rows and input splits.
_SALTS = 64
_ROWS_TOGETHER = 16


def gram_statistics(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    group: Sequence[str],
    tile: int | None = None,
    n_features: int | None = None,
) -> DataFrame:
    """(group, row, col, values): row ``row`` of ``ZᵀZ`` summed per group, from column ``col`` on.

    ``ZᵀZ`` is cut into tiles of ``tile`` by ``tile`` entries, of which those on and above
    the diagonal are given.  A tile needs the columns of its two blocks of features alone,
    so a task holds one tile per group whatever the number of features, and a table of
    ``b`` blocks reads each column ``b`` times.  Missing values are refused.

    Thousands of named columns make plans that Spark is slow to optimise.  With
    ``n_features`` the one name in ``features`` is an array column of so many values;
    arrays of another length are refused.
    """
    tile = tile or _TILE
    group = list(group)
    n_keys = len(group)
    width = (n_features or len(features)) + 2
    blocks = [range(i, min(i + tile, width)) for i in range(0, width, tile)]
    last = [ref(label).cast("double"), F.lit(1.0)]

    def packed(block: range) -> Column:
        tail = last[max(block.start - (width - 2), 0) : max(block.stop - (width - 2), 0)]
        if n_features is None:
            return F.array(*[ref(c).cast("double") for c in features[block.start : block.stop]], *tail)
        (name,) = features
        vector = F.when(F.size(ref(name)) == n_features, ref(name).cast("array<double>"))
        own = F.slice(vector, block.start + 1, max(min(block.stop, n_features) - block.start, 0))
        own = F.coalesce(own, F.array(F.lit(None).cast("double")))  # refused as a missing value below
        return F.concat(own, F.array(*tail)) if tail else own

    # One array per block: plans stay short, and tiles still read no columns of other blocks.
    flat = df.select(*[ref(k) for k in group], *[packed(b).alias(f"z{b.start}") for b in blocks])
    key_fields = [flat.schema[k] for k in group]
    place = [T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())]
    partial_schema = T.StructType([*key_fields, *place, T.StructField("values", T.ArrayType(T.DoubleType()))])
    # Which task and which of its releases a partial comes from: partials add up in that order.
    placed_schema = T.StructType([*partial_schema, T.StructField("part", T.LongType())])

    def tile_sums(upper: range, right: range) -> DataFrame:
        sides = [upper] if upper == right else [upper, right]
        high, wide = len(upper), len(right)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            release_no = TaskContext.get().partitionId() << 32
            key_types: list[pa.DataType] = []

            def release() -> Iterator[pa.RecordBatch]:
                for key, total in held.items():
                    out = [pa.array([k] * high, type=t) for k, t in zip(key, key_types, strict=True)]
                    out.append(pa.array(np.arange(upper.start, upper.stop, dtype=np.int32)))
                    out.append(pa.array(np.full(high, right.start, dtype=np.int32)))
                    ends = pa.array(np.arange(high + 1, dtype=np.int32) * wide)
                    out.append(pa.ListArray.from_arrays(ends, pa.array(total.ravel())))
                    out.append(pa.array([release_no] * high, type=pa.int64()))
                    yield pa.RecordBatch.from_arrays(out, names=[*group, "row", "col", "values", "part"])
                held.clear()

            for batch in batches:
                if batch.num_rows == 0:
                    continue
                key_types = [batch.schema.field(i).type for i in range(n_keys)]
                flats = [batch.column(n_keys + i).flatten().to_numpy(zero_copy_only=False) for i in range(len(sides))]
                if any(np.isnan(v).any() for v in flats):
                    raise ValueError("missing values among features or label; drop incomplete rows first")
                parts = [v.reshape(-1, len(b)) for v, b in zip(flats, sides, strict=True)]
                codes, uniques = _key_codes([batch.column(i) for i in range(n_keys)], batch.num_rows)
                for code, key in enumerate(uniques):
                    own = codes == code
                    held[key] = held.get(key, 0.0) + parts[0][own].T @ parts[-1][own]
                # Sums add up again later, so they may be let go at any time.
                if len(held) * high * wide * 8 > _HELD_BYTES:
                    yield from release()
                    release_no += 1
            yield from release()

        return flat.select(*[ref(k) for k in group], *[f"z{b.start}" for b in sides]).mapInArrow(add_up, placed_schema)

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "part"], kind="stable")
        rows, at = np.unique(pdf["row"].to_numpy(), return_inverse=True)
        values = np.stack(pdf["values"].to_numpy())
        sums = np.zeros((len(rows), values.shape[1]))
        np.add.at(sums, at, values)
        out = pdf.iloc[[0] * len(rows)][[*group, "row", "col"]].reset_index(drop=True)
        out["row"] = rows
        out["values"] = list(sums)
        out["part"] = int(pdf["part"].min())
        return out

    chunk = F.floor(F.col("row") / F.lit(float(_ROWS_TOGETHER)))
    salt = F.pmod(F.spark_partition_id(), F.lit(_SALTS))
    tiles = [tile_sums(upper, right) for i, upper in enumerate(blocks) for right in blocks[i:]]
    partials = reduce(DataFrame.unionByName, tiles).withColumn("_chunk", chunk).withColumn("_salt", salt)
    salted = partials.groupBy(*group, "_chunk", "col", "_salt").applyInPandas(total, placed_schema)
    return salted.withColumn("_chunk", chunk).groupBy(*group, "_chunk", "col").applyInPandas(total, placed_schema).drop("part")


def _key_codes(columns: Sequence[pa.Array], n: int) -> tuple[np.ndarray, list[tuple]]:
    """A number per row for its key, and the keys by number; nulls are a key like any other."""
    codes = np.zeros(n, dtype=np.int64)
    for column in columns:
        coded = column.dictionary_encode(null_encoding="encode")
        # numbered anew after each column, so that the numbers stay below the number of rows
        codes = codes * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    _, first = np.unique(codes, return_index=True)
    return codes, list(zip(*[column.take(pa.array(first)).to_pylist() for column in columns], strict=True)) or [()]


def _square(pdf: pd.DataFrame) -> np.ndarray:
    """The whole matrix from the rows of its tiles on and above the diagonal."""
    width = int(pdf["row"].max()) + 1
    out = np.empty((width, width))
    for row, col, values in zip(pdf["row"], pdf["col"], pdf["values"], strict=True):
        out[row, col : col + len(values)] = values
        if col > row:
            out[col : col + len(values), row] = values
    return out


def _blocks(pdf: pd.DataFrame, block: str | None) -> list[np.ndarray]:
    if block is None:
        return [_square(pdf)]
    return [_square(g) for _, g in pdf.groupby(block, sort=True)]


class _Ridge:
    """Ridge solutions for any penalty; target centred, features not.

    ``gram`` is that of ``Z`` less ``shift`` in every row (zero for the last column).
    """

    def __init__(self, gram: np.ndarray, shift: np.ndarray):
        p, n = len(gram) - 2, gram[-1, -1]
        low = gram[p, p + 1] / n
        self.offset = shift[p] + low
        sums = gram[:p, p + 1]
        # ``XᵀX`` is the scatter about the mean plus one large direction, which is kept apart.
        self.roots, self.vectors = np.linalg.eigh(gram[:p, :p] - np.outer(sums, sums) / n)
        self.n, self.mean = n, self.vectors.T @ (shift[:p] + sums / n)
        # what is left of the target adds up to zero, so the features' shift drops out
        self.moment = self.vectors.T @ (gram[:p, p] - low * sums)

    def weights(self, alpha: float) -> np.ndarray:
        size = np.maximum(self.roots, 0.0) + alpha
        free, mean = self.moment / size, self.mean / size
        return self.vectors @ (free - mean * (self.mean @ free) / (1 / self.n + self.mean @ mean))


def _error(gram: np.ndarray, shift: np.ndarray, weights: np.ndarray, offset: float) -> float:
    """RMSE on the rows behind ``gram`` of ``offset + x·weights``, from deviations from ``shift`` alone."""
    coefficients = np.concatenate([-weights, [1.0, -offset]])
    coefficients[-1] += shift @ coefficients
    return float(np.sqrt(max(coefficients @ gram @ coefficients, 0.0) / gram[-1, -1]))


MODEL_FIELDS = "alpha double, y_offset double, coefficients array<double>, cv_alphas array<double>, cv_rmse array<double>, n bigint"


def fit_ridge_cv(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    alphas: Sequence[float] = RIDGE_ALPHAS,
    folds: int = FOLDS,
) -> DataFrame:
    """One ridge model per key; the penalty is chosen on expanding folds.

    ``df`` holds the train rows, features already scaled.  The first penalty with
    the least mean fold RMSE wins; with too few rows for folds the last is used.  The task
    that solves a key holds the matrices of its folds, the square of the features each.
    """
    if not alphas:
        raise ValueError("at least one alpha is needed")
    keys = keys_list(keys)
    limits = stage(fold_limits(df, folds, keys, ts), "fold-limits")  # small, and seen to be: the rows stay where they are
    blocked = time_series_folds(df, folds, keys, ts, limits=limits).withColumn("_folds", F.coalesce("n_folds", F.lit(0)))
    columns = [*features, label]
    # Sums of squares about the mean keep the digits that squares of values far from zero lose.
    about = F.array(*[F.coalesce(F.avg(ref(c).cast("double")).cast("float").cast("double"), F.lit(0.0)) for c in columns], F.lit(0.0))
    shift = stage(df.groupBy(*keys).agg(about.alias("_shift")), "shift")
    near = lookup_join(blocked, shift, keys, [ts]).select(
        *[ref(c) for c in (*keys, "_folds", "fold_block")],
        *[(ref(c).cast("double") - F.col("_shift")[i]).alias(f"_z{i}") for i, c in enumerate(columns)],
    )
    gram = gram_statistics(near, [f"_z{i}" for i in range(len(features))], f"_z{len(features)}", [*keys, "_folds", "fold_block"])
    kinds = {f.name: f.dataType for f in gram.schema.fields}
    shift_rows = shift.select(
        *keys, F.lit(0).cast(kinds["_folds"]).alias("_folds"), F.lit(-1).cast(kinds["fold_block"]).alias("fold_block"),
        F.lit(-1).alias("row"), F.lit(0).alias("col"), F.col("_shift").alias("values"),
    )
    penalties = [float(a) for a in alphas]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["row"] == -1
        shift = np.asarray(pdf[first]["values"].iloc[0], dtype=float)
        pdf = pdf[~first]
        if not len(pdf):  # a key of null matches no row of the other tables
            return pd.DataFrame()
        blocks = _blocks(pdf, "fold_block")
        whole = np.sum(blocks, axis=0)
        scores = np.full(len(penalties), np.nan)
        alpha = penalties[-1]
        if int(pdf["_folds"].iloc[0]) > 0:
            errors = []
            train = np.zeros_like(whole)
            for before, test in zip(blocks, blocks[1:]):
                train = train + before
                fit = _Ridge(train, shift)
                errors.append([_error(test, shift, fit.weights(a), fit.offset) for a in penalties])
            scores = np.mean(errors, axis=0)
            alpha = penalties[int(np.argmin(scores))]
        final = _Ridge(whole, shift)
        row = {
            **{k: pdf[k].iloc[0] for k in keys},
            "alpha": alpha,
            "y_offset": final.offset,
            "coefficients": final.weights(alpha).tolist(),
            "cv_alphas": penalties,
            "cv_rmse": scores.tolist(),
            "n": int(round(whole[-1, -1])),
        }
        return pd.DataFrame([row])

    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return gram.unionByName(shift_rows).groupBy(*keys).applyInPandas(solve, f"{key_ddl}, {MODEL_FIELDS}")


def fit_ols(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: str | Sequence[str] = "station_id",
) -> DataFrame:
    """Least squares with intercept, one model per key: (keys, y_offset, coefficients, n)."""
    keys = keys_list(keys)
    gram = gram_statistics(df, features, label, keys)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (g,) = _blocks(pdf, None)
        p, n = len(g) - 2, g[-1, -1]
        centre = g[: p + 1, p + 1] / n
        spread = g[: p + 1, : p + 1] - n * np.outer(centre, centre)
        # Scale to unit variance before the least-norm solve: columns differ by orders of magnitude.
        size = np.sqrt(np.maximum(np.diag(spread)[:p], 0.0))
        size[size == 0] = 1.0
        scaled, *_ = np.linalg.lstsq(spread[:p, :p] / np.outer(size, size), spread[:p, p] / size, rcond=1e-12)
        weights = scaled / size
        row = {
            **{k: pdf[k].iloc[0] for k in keys},
            "y_offset": float(centre[p] - centre[:p] @ weights),
            "coefficients": weights.tolist(),
            "n": int(round(n)),
        }
        return pd.DataFrame([row])

    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return gram.groupBy(*keys).applyInPandas(solve, f"{key_ddl}, y_offset double, coefficients array<double>, n bigint")


def predict_linear(
    df: DataFrame,
    models: DataFrame,
    features: Sequence[str],
    keys: str | Sequence[str] = "station_id",
    spread_on: Sequence[str] = ("ts_utc",),
    name: str = "y_pred",
) -> DataFrame:
    """Add ``y_offset + x·coefficients`` of the model of each row's key."""
    keys = keys_list(keys)
    fitted = models.select(*keys, F.col("y_offset").alias("_b"), F.col("coefficients").alias("_w"))
    joined = lookup_join(df, fitted, keys, spread_on)
    x = F.array(*[ref(c).cast("double") for c in features])
    dot = F.aggregate(F.zip_with(x, F.col("_w"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return joined.select(*[ref(c) for c in df.columns], (F.col("_b") + dot).alias(name))
