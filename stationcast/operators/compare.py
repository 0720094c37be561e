"""Tables behind the comparison and prediction plots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationcast.functions.names import ref
from stationcast.operators.buckets import (
    BUCKET,
    BUCKET_SECONDS,
    keys_list,
    lookup_join,
    rank_boundaries,
    time_bucket,
    with_running_sum,
)
from stationcast.session import stage

# Horizon order and labels, families, target labels and units.
HORIZON_LABELS = {"m10": "10 min", "h01": "1 h", "h03": "3 h", "h06": "6 h", "h12": "12 h", "h24": "24 h"}
FAMILIES = ("baseline", "ml", "dl")
TARGET_LABELS = {"temp_c": "Temperature", "rh_pct": "Relative humidity", "pres_hpa": "Pressure"}
TARGET_UNITS = {"temp_c": "deg C", "rh_pct": "%RH", "pres_hpa": "hPa"}
PREDICTION_KEYS = ("station_id", "model", "horizon_label")


def _horizon_axis(horizons: Sequence[str]) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(i).alias("horizon_order"), F.lit(h).alias("horizon_label")) for i, h in enumerate(horizons)])
    )


def ordered_horizons(spark: SparkSession, horizons: Sequence[str]) -> DataFrame:
    """(horizon_order, horizon_label) in the configured order."""
    return spark.range(1).select(_horizon_axis(horizons).alias("_h")).select("_h.*")


def _present(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k in df.columns]


# --- metric tables ----------------------------------------------------------


def metric_by_model(metrics: DataFrame, metric: str, horizons: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean metric, models as rows and the configured horizons as columns."""
    return metrics.groupBy(*keys, "model").pivot("horizon_label", list(horizons)).agg(F.avg(ref(metric)))


def metric_by_horizon(
    metrics: DataFrame, metric: str, horizons: Sequence[str], models: Sequence[str]
) -> DataFrame:
    """Mean metric, every configured horizon as a row and models as columns."""
    pivoted = metrics.groupBy("horizon_label").pivot("model", list(models)).agg(F.avg(ref(metric)))
    return ordered_horizons(metrics.sparkSession, horizons).join(pivoted, "horizon_label", "left")


def error_by_horizon(metrics: DataFrame, metric: str = "mae", keys: Sequence[str] = ()) -> DataFrame:
    return (
        metrics.groupBy(*keys, "horizon_steps").agg(F.avg(ref(metric)).alias(metric)).orderBy(*keys, "horizon_steps")
    )


def error_growth(metrics: DataFrame, horizons: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """MAE of each model along the configured horizons; models without any MAE are left out."""
    mae = (
        metrics.where(F.col("horizon_label").isin(list(horizons)))
        .groupBy(*keys, "model", "horizon_label")
        .agg(F.max("mae").alias("mae"))
    )
    models = mae.where(F.col("mae").isNotNull()).select(*keys, "model").distinct()
    axis = models.select(*keys, "model", _horizon_axis(horizons).alias("_h")).select(*keys, "model", "_h.*")
    return axis.join(mae, [*keys, "model", "horizon_label"], "left")


def best_per_family(
    metrics: DataFrame,
    horizons: Sequence[str] | None = None,
    families: Sequence[str] = FAMILIES,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Model with the least MAE per horizon and family; ties go to the first name."""
    rows = metrics.where(F.col("model_family").isin(list(families)) & F.col("mae").isNotNull())
    if horizons is not None:
        rows = rows.where(F.col("horizon_label").isin(list(horizons)))
    best = F.min(F.struct("mae", "model")).alias("_b")
    return rows.groupBy(*keys, "horizon_label", "model_family").agg(best).select(
        *keys, "horizon_label", "model_family", "_b.model", "_b.mae"
    )


def skill_heatmap(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean skill per model and horizon, clipped to [-2, 1] for colour, raw in the label."""
    mean = metrics.groupBy(*keys, "model", "horizon_label").agg(F.avg("skill_score_persistence").alias("skill"))
    clipped = F.when(F.col("skill").isNotNull(), F.greatest(F.least(F.col("skill"), F.lit(1.0)), F.lit(-2.0)))
    label = F.when(F.col("skill").isNotNull(), F.format_string("%+.2f", "skill"))
    return mean.select(*keys, "model", "horizon_label", "skill", clipped.alias("clipped"), label.alias("label"))


def _map_literal(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def horizon_label_text(label: Column) -> Column:
    return F.coalesce(F.try_element_at(_map_literal(HORIZON_LABELS), label), label)


def target_labels(metrics: DataFrame) -> DataFrame:
    """One row (target, label, unit); generic unless the metrics hold exactly one target."""
    one = metrics.agg(F.min("target").alias("_lo"), F.max("target").alias("_hi")).select(
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("target")
    )
    known = F.coalesce(F.col("target"), F.lit(""))
    return one.select(
        "target",
        F.coalesce(F.try_element_at(_map_literal(TARGET_LABELS), known), F.lit("Target value")).alias("label"),
        F.try_element_at(_map_literal(TARGET_UNITS), known).alias("unit"),
    )


# --- prediction tables ------------------------------------------------------


def window_filter(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    ts: str = "ts_utc",
    require_rows: bool = False,
) -> DataFrame:
    """Rows with ``start <= ts <= end``; bounds without a zone are UTC.

    ``require_rows`` runs a job and fails when nothing is left.
    """
    out = df
    if start is not None:
        out = out.where(ref(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(ref(ts) <= F.lit(end).cast("timestamp"))
    if require_rows and out.isEmpty():
        raise ValueError("no prediction rows fall inside the requested window")
    return out


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("residual", F.col("y_pred") - F.col("y_true"))


def residual_histogram(predictions: DataFrame, bins: int = 40, keys: Sequence[str] = PREDICTION_KEYS) -> DataFrame:
    """Equal-width bins of pred - true between its ends; the last bin holds the maximum.

    (keys, bin, lo, hi, count), bins without rows left out.
    """
    keys = _present(predictions, keys)
    rows = residuals(predictions).where(F.col("residual").isNotNull())
    ends = rows.groupBy(*keys).agg(F.min("residual").alias("_a"), F.max("residual").alias("_z"))
    # A single value gets a bin range of one around it.
    flat = F.col("_a") == F.col("_z")
    lo, hi = F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")), F.when(flat, F.col("_z") + 0.5).otherwise(F.col("_z"))
    ranges = ends.select(*keys, lo.alias("_lo"), ((hi - lo) / bins).alias("_w"))
    place = F.least(F.floor((F.col("residual") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1).cast("bigint"))
    counted = (
        lookup_join(rows, ranges, keys, ["ts_utc"], how="inner")
        .groupBy(*keys, place.cast("int").alias("bin"), "_lo", "_w")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    left = F.col("_lo") + F.col("bin") * F.col("_w")
    return counted.select(*keys, "bin", left.alias("lo"), (left + F.col("_w")).alias("hi"), "count")


def residual_bias(predictions: DataFrame, keys: Sequence[str] = PREDICTION_KEYS) -> DataFrame:
    return residuals(predictions).groupBy(*_present(predictions, keys)).agg(F.avg("residual").alias("bias"))


def scatter_summary(predictions: DataFrame, keys: Sequence[str] = PREDICTION_KEYS) -> DataFrame:
    """Common axis ends, errors and row count of an observed-against-predicted plot."""
    t, p = F.col("y_true"), F.col("y_pred")
    rows = predictions.where(t.isNotNull() & p.isNotNull())
    return rows.groupBy(*_present(predictions, keys)).agg(
        F.least(F.min(t), F.min(p)).alias("lo"),
        F.greatest(F.max(t), F.max(p)).alias("hi"),
        F.avg(F.abs(t - p)).alias("mae"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def segments(
    df: DataFrame,
    max_gap_seconds: int = 3_600,
    keys: Sequence[str] = PREDICTION_KEYS,
    ts: str = "ts_utc",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Add ``segment_id`` (from 0): a new segment starts after a gap above the limit.

    The row before the first of a bucket is the last of the previous non-empty
    bucket, which the small bucket table tells.
    """
    keys = keys_list(_present(df, keys))
    bucketed = df.withColumn(BUCKET, time_bucket(ref(ts), bucket_seconds))
    ends = bucketed.groupBy(*keys, BUCKET).agg(F.max(ts).alias("_last"))
    previous = ends.select(
        *keys, BUCKET, F.lag("_last").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("_previous")
    )
    spec = Window.partitionBy(*keys, BUCKET).orderBy(ts)
    before = F.coalesce(F.lag(ref(ts)).over(spec), F.col("_previous"))
    marked = (
        bucketed.repartition(*[F.col(k) for k in keys], F.col(BUCKET))
        .join(previous, [*keys, BUCKET])
        .withColumn("_new", F.coalesce(F.unix_micros(ref(ts)) - F.unix_micros(before) > max_gap_seconds * 1_000_000, F.lit(False)))
        .select(*[ref(c) for c in df.columns], "_new")
    )
    return with_running_sum(marked, keys, ts, F.col("_new").cast("int"), "segment_id", bucket_seconds).drop("_new")


def largest_segment(
    df: DataFrame,
    max_gap_seconds: int = 3_600,
    keys: Sequence[str] = PREDICTION_KEYS,
    ts: str = "ts_utc",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """(keys, segment_start, segment_end, rows) of the longest segment, earliest on ties."""
    keys = _present(df, keys)
    stats = (
        segments(df, max_gap_seconds, keys, ts, bucket_seconds)
        .groupBy(*keys, "segment_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("segment_start"), F.max(ts).alias("segment_end"))
    )
    rank = F.struct(F.col("rows"), (-F.unix_micros("segment_start")).alias("early"))
    best = F.max_by(F.struct("segment_start", "segment_end", "rows"), rank).alias("_s")
    return stats.groupBy(*keys).agg(best).select(*keys, "_s.*")


def plot_sample(
    df: DataFrame,
    max_points: int = 1_500,
    start: str | None = None,
    end: str | None = None,
    max_gap_seconds: int = 3_600,
    keys: Sequence[str] = PREDICTION_KEYS,
    ts: str = "ts_utc",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Rows for a time-series plot, with ``sample_label``.

    A given window wins; else the largest segment is taken.  Of more than
    ``max_points`` rows the middle ones are shown.
    """
    keys = _present(df, keys)
    if start is not None or end is not None:
        rows = window_filter(df, start, end, ts)
    else:
        # One row per series, stored so that the steps below do not look for it again.
        span = stage(largest_segment(df, max_gap_seconds, keys, ts, bucket_seconds).drop("rows"), "segment")
        rows = (
            lookup_join(df, span, keys, [ts], how="inner")
            .where(ref(ts).between(F.col("segment_start"), F.col("segment_end")))
            .select(*[ref(c) for c in df.columns])
        )
    n = F.col("n")
    skip = F.greatest(F.floor((n - max_points) / F.lit(2.0)), F.lit(0).cast("bigint"))
    bounds = rank_boundaries(
        rows, keys, ts, {"_from": skip + 1, "_to": F.least(skip + max_points, n)}, bucket_seconds
    ).drop("n")
    first, last = F.date_format("_from", "yyyy-MM-dd"), F.date_format("_to", "yyyy-MM-dd")
    label = F.when(first == last, first).otherwise(F.concat(first, F.lit(" to "), last))
    return (
        lookup_join(rows, bounds, keys, [ts], how="inner")
        .where(ref(ts).between(F.col("_from"), F.col("_to")))
        .select(*[ref(c) for c in df.columns], label.alias("sample_label"))
    )


# Spark limits each partition before the shuffle up to this row number.
_LIMITED_EARLY = 1_000
_DRAW_BUCKETS = 4_096


def _up_to_rank(df: DataFrame, n: int, keys: list[str], order: str, **how) -> DataFrame:
    """Rows of each key whose ``order`` is among the ``n`` smallest."""
    limit = rank_boundaries(df, keys, order, {"_limit": F.least(F.lit(n), F.col("n"))}, **how).drop("n")
    return lookup_join(df, limit, keys, [order], how="inner").where(ref(order) <= F.col("_limit")).drop("_limit")


def first_points(df: DataFrame, n: int = 500, keys: Sequence[str] = PREDICTION_KEYS, ts: str = "ts_utc") -> DataFrame:
    """The first ``n`` rows of each series, numbered in ``point``, for a short line plot."""
    keys = _present(df, keys)
    rows = df if n <= _LIMITED_EARLY else _up_to_rank(df, n, keys, ts)
    spec = Window.partitionBy(*keys).orderBy(ts)
    return rows.withColumn("point", F.row_number().over(spec)).where(F.col("point") <= n)


def seeded_sample(
    df: DataFrame, n: int = 8_000, seed: int = 42, keys: Sequence[str] = PREDICTION_KEYS, ts: str = "ts_utc"
) -> DataFrame:
    """``min(n, rows)`` rows per series, the same ones for the same seed on any partitioning.

    Rows are drawn in the order of a hash of their time, which is spread evenly
    over the draw buckets.
    """
    keys = _present(df, keys)
    drawn = df.withColumn("_draw", F.xxhash64(F.lit(seed), ref(ts)))
    width = float(2**64 // _DRAW_BUCKETS)
    return _up_to_rank(drawn, n, keys, "_draw", bucket_of=lambda draw: F.floor(draw / F.lit(width))).drop("_draw")
