"""Linear models of all series and horizons: fitted in one job, stored by version, scored by a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.functions.names import ref
from stationcast.operators import linear
from stationcast.operators.buckets import keys_list, lookup_join
from stationcast.operators.scaling import apply_scaler, fit_scaler
from stationcast.session import stage

HORIZON = ("horizon_label", "horizon_steps")
MODELS = ("ridge", "linear_regression")


def fit_horizons(
    rows: DataFrame,
    features: Sequence[str],
    name: str = "ridge",
    scaling: str = "standard",
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    split: str = "split",
) -> DataFrame:
    """One model per key and horizon, with the scaler of its features, in one table.

    ``rows`` are stacked: the features, ``horizon_label, horizon_steps, y_true`` and the
    split of each. All groups are scaled and fitted by the same two jobs, so a run of many
    horizons takes the passes of one. Each row holds what scoring needs: feature names,
    their centres and widths, offset and coefficients.
    """
    if name not in MODELS:
        raise ValueError(f"no linear model {name!r}")
    group = [*keys_list(keys), *HORIZON]
    train = rows.where(F.col(split) == "train")
    scaler = stage(fit_scaler(train, features, scaling, group, None, ts), "scaler")
    scaled = apply_scaler(train, scaler, features, group, [ts])
    if name == "ridge":
        fitted = linear.fit_ridge_cv(scaled, features, "y_true", group, ts)
    else:
        fitted = linear.fit_ols(scaled, features, "y_true", group).withColumn("alpha", F.lit(0.0))
    centre = F.coalesce("mean", "min", "median")
    width = F.coalesce("scale", "iqr")
    # one entry per feature
    per_group = scaler.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(centre.alias("c"), width.alias("w"))))).alias("_s"))
    names = F.array(*[F.lit(c) for c in features])

    def of(part: str) -> Column:
        return F.transform(names, lambda c: F.element_at("_s", c)[part])

    return fitted.join(per_group, group).select(
        *group, F.lit(name).alias("model"), names.alias("features"), of("c").alias("centres"), of("w").alias("widths"),
        "alpha", "y_offset", "coefficients", "n",
    )


def save_models(models: DataFrame, path: str, version: str) -> None:
    """Store ``models`` as ``version`` under ``path``; other versions stay, an equal one is replaced."""
    if not version or "/" in version or "=" in version:
        raise ValueError(f"not a version name: {version!r}")
    models.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_models(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The models of ``version``, by default of the last one in name order, with a column ``version``."""
    stored = spark.read.parquet(path).withColumn("version", F.col("version").cast("string"))
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == F.lit(version))


def score_horizons(
    rows: DataFrame, models: DataFrame, keys: str | Sequence[str] = "station_id", ts: str = "ts_utc"
) -> DataFrame:
    """``rows`` with a row per stored model of their key: (..., horizon_label, horizon_steps, model, y_pred).

    Rows that are stacked already meet the models of their own horizon only. Features are
    taken by the names stored with the models, which must agree within one table. Rows
    without a model get none; a missing feature gives a missing prediction.
    """
    keys = keys_list(keys)
    names = [r["features"] for r in models.select("features").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("models of one table must share their features")
    absent = [c for c in names[0] if c not in rows.columns]
    if absent:
        raise ValueError(f"features missing: {absent}")
    on = [*keys, *[c for c in HORIZON if c in rows.columns]]
    shown = [c for c in (*HORIZON, "model") if c not in on]
    fitted = models.select(*on, *shown, F.col("y_offset").alias("_b"), *[F.col(a).alias(b) for a, b in (("centres", "_c"), ("widths", "_s"), ("coefficients", "_w"))])
    joined = lookup_join(rows, fitted, on, [ts], "inner")
    x = F.array(*[ref(c).cast("double") for c in names[0]])
    scaled = F.zip_with(F.zip_with(x, F.col("_c"), lambda a, b: a - b), F.col("_s"), lambda a, b: a / b)
    dot = F.aggregate(F.zip_with(scaled, F.col("_w"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return joined.select(*[ref(c) for c in rows.columns], *shown, (F.col("_b") + dot).alias("y_pred"))
