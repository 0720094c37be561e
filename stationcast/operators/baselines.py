"""Baseline forecasts: persistence, moving average, climatology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.functions import scoring
from stationcast.functions.names import lag_columns_of, ref, rolling_column, rolling_mean_windows
from stationcast.operators.buckets import keys_list, lookup_join

BASELINES = ("persistence", "moving_average", "climatology")
MAX_LAGS = 4


def persistence(columns: Sequence[str], target: str) -> Column:
    """The present value of the target."""
    if target not in columns:
        raise ValueError(f"persistence needs the column {target!r}")
    return ref(target)


def moving_average(columns: Sequence[str], target: str, max_lags: int = MAX_LAGS) -> Column:
    """Shortest trailing mean of the target, else the mean of its nearest lags."""
    windows = rolling_mean_windows(columns, target)
    if windows:
        return ref(rolling_column(target, windows[0], "mean"))
    lags = lag_columns_of(columns, target)[:max_lags]
    if not lags:
        raise ValueError(f"no lag or rolling-mean column of {target!r}")
    total = sum((F.coalesce(ref(c), F.lit(0.0)) for c in lags), F.lit(0.0))
    known = sum((ref(c).isNotNull().cast("int") for c in lags), F.lit(0))
    return F.when(known > 0, total / known)


def fit_climatology(
    df: DataFrame,
    target: str,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    split: str | None = "split",
) -> DataFrame:
    """Mean present target per (month, hour) of the train rows, with the overall mean.

    At most 288 rows per key; serves every horizon.
    """
    if target not in df.columns:
        raise ValueError(f"climatology needs the column {target!r}")
    keys = keys_list(keys)
    train = df if split is None else df.where(F.col(split) == "train")
    cells = train.groupBy(*keys, F.month(ts).alias("month"), F.hour(ts).alias("hour")).agg(
        scoring.stable_sum(ref(target)).alias("_sum"), F.count(ref(target)).alias("_n")
    )
    overall = cells.groupBy(*keys).agg((scoring.stable_sum(F.col("_sum")) / F.nullif(F.sum("_n"), F.lit(0))).alias("global_mean"))
    return cells.join(overall, keys).select(
        *keys, "month", "hour", (F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))).alias("mean"), "global_mean"
    )


def climatology(
    df: DataFrame,
    lookup: DataFrame,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    name: str = "y_pred",
) -> DataFrame:
    """Add the (month, hour) mean of the forecast origin, else the overall mean."""
    keys = keys_list(keys)
    per_key = lookup.groupBy(*keys).agg(
        F.max("global_mean").alias("_global"),
        # Bounded: one entry per month and hour.
        F.map_from_entries(F.collect_list(F.struct(F.col("month") * 100 + F.col("hour"), F.col("mean")))).alias("_cells"),
    )
    joined = lookup_join(df, per_key, keys, [ts])
    cell = F.col("_cells")[F.month(ref(ts)) * 100 + F.hour(ref(ts))]
    return joined.withColumn(name, F.coalesce(cell, F.col("_global"))).drop("_cells", "_global")


def baseline_predictions(
    df: DataFrame,
    target: str,
    models: Sequence[str] = BASELINES,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    horizon: Sequence[str] = ("horizon_label", "horizon_steps"),
    y_true: str = "y_true",
    predict_split: str = "test",
) -> DataFrame:
    """All baselines on all horizons in one pass over the test rows.

    ``df`` is unscaled, has ``split`` and one row per origin and horizon.
    Output: (keys, horizon..., model, model_family, ts, y_true, y_pred).
    """
    keys = keys_list(keys)
    unknown = set(models) - set(BASELINES)
    if unknown:
        raise ValueError(f"unknown baseline models {sorted(unknown)}")
    test = df.where(F.col("split") == predict_split)
    value: dict[str, Column] = {}
    if "climatology" in models:
        group = [*keys, *horizon]
        test = climatology(test, fit_climatology(df, target, group, ts), group, ts, "_climatology")
        value["climatology"] = F.col("_climatology")
    if "persistence" in models:
        value["persistence"] = persistence(df.columns, target)
    if "moving_average" in models:
        value["moving_average"] = moving_average(df.columns, target)
    entries = F.array(*[F.struct(F.lit(m).alias("model"), value[m].cast("double").alias("y_pred")) for m in models])
    return test.select(*keys, *horizon, ref(ts), ref(y_true).alias("y_true"), F.explode(entries).alias("_m")).select(
        *keys, *horizon, "_m.model", F.lit("baseline").alias("model_family"), ref(ts), "y_true", "_m.y_pred"
    )
