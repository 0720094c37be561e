"""Comparison and merging of runs kept as tables with a ``run_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.operators.evaluate import order_metrics

# Horizons assumed when no run names any.
FALLBACK_HORIZONS = ("m10", "h01", "h03", "h06", "h12", "h24")
VERIFIED_FIELDS = ("train_start", "train_end", "test_start", "test_end", "n_train", "n_test")
SHARED_CATEGORIES = ("configs", "scalers", "interim", "split_metadata", "supervised")


def merge_metrics(
    baseline: DataFrame | None,
    delta: DataFrame | None,
    roster: Sequence[str],
    granularity: str = "model",
) -> DataFrame:
    """Delta rows and the baseline rows they do not supersede, roster only, ordered.

    A model measured anew in delta replaces all its baseline rows; with
    ``granularity="model_horizon"`` only those of the same horizon.  Scores are
    taken over as they are.
    """
    keys = {"model": ["model"], "model_horizon": ["model", "horizon_label"]}[granularity]
    in_roster = F.col("model").isin(list(roster))
    if baseline is None and delta is None:
        raise ValueError("neither run has metrics")
    if delta is None:
        return order_metrics(baseline.where(in_roster))
    fresh = delta.where(in_roster)
    if baseline is None:
        return order_metrics(fresh)
    kept = baseline.where(in_roster).join(fresh.select(*keys).distinct(), keys, "left_anti")
    return order_metrics(fresh.unionByName(kept, allowMissingColumns=True))


def discover_horizons(*runs: DataFrame) -> DataFrame:
    """(horizon_order, horizon_label) over the runs, in first-seen order.

    Each run lists its labels in alphabetical order; the fallback list stands in
    when no run has any.
    """
    spark: SparkSession = runs[0].sparkSession
    seen = None
    for i, run in enumerate(runs):
        labels = run.where(F.col("horizon_label").isNotNull()).select("horizon_label").distinct().withColumn("run", F.lit(i))
        seen = labels if seen is None else seen.unionByName(labels)
    # One small array: a run has a handful of horizons.
    found = seen.groupBy("horizon_label").agg(F.min("run").alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("run", "horizon_label"))).alias("_l")
    )
    fallback = F.array(*[F.struct(F.lit(0).alias("run"), F.lit(h).alias("horizon_label")) for h in FALLBACK_HORIZONS])
    labels = F.when(F.size("_l") > 0, F.col("_l")).otherwise(fallback)
    return found.select(F.posexplode(labels).alias("horizon_order", "_h")).select("horizon_order", "_h.horizon_label")


def artifact_provenance(
    roster: Sequence[str],
    horizons: DataFrame,
    baseline: DataFrame,
    delta: DataFrame,
) -> DataFrame:
    """(model, horizon_label, source): delta where it has the artifact, else baseline, else missing."""
    keys = ["model", "horizon_label"]
    models = F.explode(F.array(*[F.lit(m) for m in dict.fromkeys(roster)])).alias("model")
    wanted = horizons.select("horizon_label").distinct().select(models, "horizon_label")
    in_delta = delta.select(*keys).distinct().withColumn("_d", F.lit(True))
    in_baseline = baseline.select(*keys).distinct().withColumn("_b", F.lit(True))
    source = F.when(F.col("_d"), "delta").when(F.col("_b"), "baseline").otherwise("missing")
    return wanted.join(in_delta, keys, "left").join(in_baseline, keys, "left").select(*keys, source.alias("source"))


def shared_provenance(baseline: DataFrame, delta: DataFrame, categories: Sequence[str] = SHARED_CATEGORIES) -> DataFrame:
    """(category, source) from catalogues with a ``kind`` column."""
    names = F.explode(F.array(*[F.lit(c) for c in categories])).alias("category")
    wanted = baseline.sparkSession.range(1).select(names)
    in_delta = delta.select(F.col("kind").alias("category")).distinct().withColumn("_d", F.lit(True))
    in_baseline = baseline.select(F.col("kind").alias("category")).distinct().withColumn("_b", F.lit(True))
    source = F.when(F.col("_d"), "delta").when(F.col("_b"), "baseline").otherwise("missing")
    return wanted.join(in_delta, "category", "left").join(in_baseline, "category", "left").select("category", source.alias("source"))


def verify_splits(baseline: DataFrame, delta: DataFrame, keys: Sequence[str] = ("horizon_label",)) -> DataFrame:
    """One row per field whose value differs between the runs: (keys, field, baseline, delta)."""
    keys = list(keys)
    left = baseline.select(*keys, *[F.col(f).cast("string").alias(f"_b_{f}") for f in VERIFIED_FIELDS])
    right = delta.select(*keys, *[F.col(f).cast("string").alias(f"_d_{f}") for f in VERIFIED_FIELDS])
    fields = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"_b_{f}").alias("baseline"), F.col(f"_d_{f}").alias("delta"))
            for f in VERIFIED_FIELDS
        ]
    )
    return (
        left.join(right, keys)
        .select(*keys, F.explode(fields).alias("_f"))
        .select(*keys, "_f.*")
        .where(~F.col("baseline").eqNullSafe(F.col("delta")))
    )


def split_digest(
    df: DataFrame,
    keys: Sequence[str] = ("station_id",),
    ts: str = "ts_utc",
    split: str = "split",
) -> DataFrame:
    """Which rows each split holds, in few bytes: (keys, split, n_rows, digest).

    Two sums of 60-bit hashes of key and time, which do not depend on the order or the
    partitions of the rows; repeated rows count as often as they occur. Bounds and counts
    may agree where a row was exchanged, digests do not.
    """
    keys = list(keys)
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    name = F.md5(F.concat_ws("\x1f", *parts, F.coalesce(F.unix_micros(F.col(ts)).cast("string"), F.lit(""))))

    def total(at: int) -> Column:
        return F.sum(F.conv(F.substring(name, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")

    return df.groupBy(*keys, split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.concat(total(1), F.lit("-"), total(16)).alias("digest")
    )


def compare_digests(baseline: DataFrame, delta: DataFrame, keys: Sequence[str] = ("station_id",), split: str = "split") -> DataFrame:
    """(keys, split, same): whether two runs hold the same rows in each split; a split only one has is not the same."""
    keys = [*keys, split]
    left = baseline.select(*keys, F.col("n_rows").alias("_n"), F.col("digest").alias("_d"))
    right = delta.select(*keys, F.col("n_rows").alias("_m"), F.col("digest").alias("_e"))
    same = F.coalesce((F.col("_n") == F.col("_m")) & (F.col("_d") == F.col("_e")), F.lit(False))
    return left.join(right, keys, "full").select(*keys, same.alias("same"))


def run_inventory(catalogue: DataFrame) -> DataFrame:
    """Number of items of each kind per run."""
    return catalogue.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("items"))
