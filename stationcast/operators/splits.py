"""Chronological splits, expanding folds and their metadata."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.functions.names import ref
from stationcast.operators.buckets import BUCKET_SECONDS, keys_list, lookup_join, rank_boundaries

SPLITS = ("train", "val", "test")
FOLDS = 5


def _share(n: Column, *fractions: float) -> Column:
    """``floor(n * sum of the fractions)``, taking each as the decimal number it is written as."""
    part = sum((Fraction(repr(float(f))) for f in fractions), Fraction(0))
    whole = n.cast("decimal(38,0)") * F.lit(part.numerator).cast("decimal(20,0)")
    by = F.lit(part.denominator).cast("decimal(20,0)")
    return ((whole - whole % by) / by).cast("bigint")


def split_boundaries(
    df: DataFrame,
    train: float = 0.70,
    validation: float = 0.15,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    on_empty: str = "error",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Last train and last validation time per key: (keys, n, train_end, val_end).

    Train holds the first ``floor(n * train)`` rows, validation those up to
    ``floor(n * (train + validation))``.  ``on_empty="error"`` fails when a part
    of any series would be empty, ``"keep"`` lets it be.
    """
    if not 0 < train < 1 or validation < 0 or train + validation >= 1:
        raise ValueError("fractions must leave room for train, validation and test rows")
    n = F.col("n")
    bounds = rank_boundaries(
        df, keys, ts, {"train_end": _share(n, train), "val_end": _share(n, train, validation)}, bucket_seconds
    )
    if on_empty == "error":
        n_train, n_val = _share(n, train), _share(n, train, validation)
        empty = (n_train < 1) | (n_val <= n_train) | (n_val >= n)
        problem = F.raise_error(F.lit("chronological split gives an empty train, validation or test part"))
        bounds = bounds.withColumn("n", F.when(empty, problem.cast("bigint")).otherwise(n))
    return bounds


def split_label(ts: Column, train_end: Column, val_end: Column) -> Column:
    return (
        F.when(train_end.isNotNull() & (ts <= train_end), "train")
        .when(val_end.isNotNull() & (ts <= val_end), "val")
        .otherwise("test")
    )


def chronological_split(
    df: DataFrame,
    train: float = 0.70,
    validation: float = 0.15,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    on_empty: str = "error",
    boundaries: DataFrame | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Add ``split`` (train, val, test) by rank in time, per key; no shuffling, no purge gap.

    Ranks become boundary times first, so the rows are only compared with two
    timestamps of their series.
    """
    keys = keys_list(keys)
    if boundaries is None:
        boundaries = split_boundaries(df, train, validation, keys, ts, on_empty, bucket_seconds)
    limits = boundaries.select(*keys, "n", F.col("train_end").alias("_t"), F.col("val_end").alias("_v"))
    joined = lookup_join(df, limits.withColumnRenamed("n", "_n"), keys, [ts])
    # "_n" carries the empty-part check, so it must be read.
    label = F.when(F.col("_n").isNotNull(), split_label(ref(ts), F.col("_t"), F.col("_v")))
    return joined.select(*[ref(c) for c in df.columns], label.alias("split"))


def fold_count(n: Column, folds: int = FOLDS) -> Column:
    """Folds actually used: at least two, fewer than the rows."""
    return F.least(F.lit(max(2, int(folds))), F.greatest(F.lit(2), n - 1))


def fold_limits(
    df: DataFrame,
    folds: int = FOLDS,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Per key the number of folds and the last time of each block but the last."""
    keys = keys_list(keys)
    n = F.col("n")
    k = fold_count(n, folds)
    size = F.floor(n / (k + 1))
    names = _fold_names(folds)
    ranks = {
        name: F.when((n > k) & (F.lit(i) < k), n - (k - i) * size) for i, name in enumerate(names)
    }
    bounds = rank_boundaries(df, keys, ts, ranks, bucket_seconds)
    return bounds.select(*keys, F.when(n > k, k).cast("int").alias("n_folds"), *names)


def _fold_names(folds: int) -> list[str]:
    return [f"_end{i}" for i in range(max(2, int(folds)))]


def time_series_folds(
    df: DataFrame,
    folds: int = FOLDS,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    bucket_seconds: int = BUCKET_SECONDS,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Add ``fold_block`` and ``n_folds`` for expanding-window validation.

    With test size ``n // (k + 1)``, the rows of fold i (1..k) form block i and
    its training rows are all earlier blocks; block 0 is only ever trained on.
    A series with too few rows for any fold has ``n_folds`` NULL.  ``limits`` takes
    what ``fold_limits`` gave, stored for example.
    """
    keys = keys_list(keys)
    if limits is None:
        limits = fold_limits(df, folds, keys, ts, bucket_seconds)
    joined = lookup_join(df, limits, keys, [ts])
    block = sum(
        (F.when(F.col(name).isNotNull() & (ref(ts) > F.col(name)), 1).otherwise(0) for name in _fold_names(folds)), F.lit(0)
    )
    return joined.select(*[ref(c) for c in df.columns], block.cast("int").alias("fold_block"), "n_folds")


def split_metadata(
    df: DataFrame,
    target_column: str,
    feature_columns: Sequence[str],
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    split: str = "split",
) -> DataFrame:
    """First and last time and row count of each split, one row per key."""
    keys = keys_list(keys)

    def part(name: str, label: str) -> list[Column]:
        inside = F.when(F.col(split) == name, ref(ts))
        return [
            F.min(inside).alias(f"{label}_start"),
            F.max(inside).alias(f"{label}_end"),
            F.count(inside).alias(f"n_{label}"),
        ]

    return df.groupBy(*keys).agg(
        F.lit(target_column).alias("target_column"),
        F.array(*[F.lit(c) for c in feature_columns]).cast("array<string>").alias("feature_columns"),
        *part("train", "train"),
        *part("val", "validation"),
        *part("test", "test"),
    )
