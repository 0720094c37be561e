"""Regular time axis: gap insertion, off-grid report, resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast.functions.names import GAP_COLUMN, ref
from stationcast.operators.buckets import BUCKET_STEPS, keys_list


def _bounds(df: DataFrame, keys: list[str], ts: str, freq_seconds: int) -> DataFrame:
    """First time and number of the last step per key, of its most frequent phase.

    On equal counts the phase seen first is taken.  A stray row, be it the first of
    its station, so does not move the axis away from all others.
    """
    freq = freq_seconds * 1_000_000
    micros = F.unix_micros(F.col(ts))
    phases = df.groupBy(*keys, F.pmod(micros, F.lit(freq)).alias("_phase")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(micros).alias("_lo"), F.max(micros).alias("_hi")
    )
    chosen = F.max_by(F.struct("_lo", "_hi"), F.struct(F.col("_n"), -F.col("_lo"))).alias("_axis")
    last = F.floor((F.col("_axis._hi") - F.col("_axis._lo")) / F.lit(float(freq)))
    return phases.groupBy(*keys).agg(chosen).select(*keys, F.col("_axis._lo").alias("_lo"), last.alias("_last"))


def off_axis_rows(
    df: DataFrame, freq_seconds: int, keys: str | Sequence[str] = "station_id", ts: str = "ts_utc"
) -> DataFrame:
    """The rows that ``insert_gaps`` finds no step for; rows without a time or key are among them."""
    keys = keys_list(keys)
    axis = _bounds(df, keys, ts, freq_seconds).select(*[F.col(k).alias(f"_axis_{k}") for k in keys], "_lo")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_axis_{k}")
    on = F.pmod(F.unix_micros(F.col(ts)) - F.col("_lo"), F.lit(freq_seconds * 1_000_000)) == 0
    return df.join(axis, same, "left").where(~F.coalesce(on, F.lit(False))).select(*df.columns)


def time_axis(
    df: DataFrame,
    freq_seconds: int,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    bucket_steps: int = BUCKET_STEPS,
) -> DataFrame:
    """Every step from the first to the last time of each key's most frequent phase: (keys, ts)."""
    keys = keys_list(keys)
    size = float(bucket_steps)
    buckets = _bounds(df, keys, ts, freq_seconds).select(
        *keys,
        "_lo",
        "_last",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / F.lit(size)))).alias("_b"),
    )
    # One long series becomes many short stretches before it is written out.  The
    # number is given, since Spark would else merge partitions by their size here,
    # which is thousands of times smaller than what they unfold to.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = buckets.repartition(parts, *[F.col(k) for k in keys], F.col("_b"))
    start = F.col("_b") * bucket_steps
    stop = F.least(start + (bucket_steps - 1), F.col("_last"))
    return spread.select(*keys, "_lo", F.explode(F.sequence(start, stop)).alias("_s")).select(
        *keys, F.timestamp_micros(F.col("_lo") + F.col("_s") * (freq_seconds * 1_000_000)).alias(ts)
    )


def _unfolded(plain: DataFrame, freq_seconds: int, keys: list[str], ts: str, bucket_steps: int) -> DataFrame:
    """The whole axis with the rows on it, and ``gap``.

    Only the rows and one mark per bucket of the axis are shuffled: each of them unfolds to
    the steps up to the next one after that, so the axis itself is neither moved nor sorted.
    """
    freq = freq_seconds * 1_000_000
    size = F.lit(float(bucket_steps))
    axis = _bounds(plain, keys, ts, freq_seconds)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_axis_{k}")
    away = F.unix_micros(F.col(ts)) - F.col("_lo")
    on = F.pmod(away, F.lit(freq)) == 0
    rows = plain.join(axis.withColumnsRenamed({k: f"_axis_{k}" for k in keys}), same).where(on).withColumn("_s", F.floor(away / F.lit(float(freq))))
    rows = rows.withColumn("_b", F.floor(F.col("_s") / size)).withColumn("_present", F.lit(True)).drop(ts, *[f"_axis_{k}" for k in keys])
    marks = axis.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / size))))
    marks = marks.withColumn("_s", F.col("_b") * bucket_steps).withColumn("_present", F.lit(False))
    # the number is given for the same reason as in ``time_axis``
    parts = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [*[F.col(k) for k in keys], F.col("_b")]
    spread = rows.unionByName(marks, allowMissingColumns=True).repartition(parts, *place)
    end = F.least(F.col("_b") * bucket_steps + (bucket_steps - 1), F.col("_last")) + 1
    following = F.coalesce(F.lead("_s").over(Window.partitionBy(*place).orderBy("_s", "_present")), end)
    # a row stands for its own step even where another row has the same; a mark does not
    stop = F.when(F.col("_present"), F.greatest(F.col("_s"), following - 1)).when(following > F.col("_s"), following - 1)
    stretches = spread.withColumn("_stop", stop).where(F.col("_stop").isNotNull())
    steps = stretches.withColumn("_step", F.explode(F.sequence("_s", "_stop")))
    here = F.col("_present") & (F.col("_step") == F.col("_s"))
    return steps.select(
        *keys,
        F.timestamp_micros(F.col("_lo") + F.col("_step") * freq).alias(ts),
        *[F.when(here, ref(c)).alias(c) for c in plain.columns if c not in {*keys, ts}],
        (~here).alias(GAP_COLUMN),
    )


def insert_gaps(
    df: DataFrame,
    freq_seconds: int,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    bucket_steps: int = BUCKET_STEPS,
    keep_off_axis: bool = False,
) -> DataFrame:
    """Complete the axis; added rows have NULL variables and ``gap = true``.

    ``ts`` is unique per key on input.  Rows off the axis are left out, and are what
    ``off_axis_rows`` returns; with ``keep_off_axis`` they stay, and a column
    ``off_axis`` tells them from the others.
    """
    keys = keys_list(keys)
    plain = df.drop(GAP_COLUMN)
    full = _unfolded(plain, freq_seconds, keys, ts, bucket_steps)
    if not keep_off_axis:
        return full
    stray = off_axis_rows(plain, freq_seconds, keys, ts).withColumn(GAP_COLUMN, F.lit(False))
    return full.withColumn("off_axis", F.lit(False)).unionByName(stray.withColumn("off_axis", F.lit(True)))


def snap_to_axis(
    df: DataFrame, freq_seconds: int, keys: str | Sequence[str] = "station_id", ts: str = "ts_utc"
) -> DataFrame:
    """Rows off the axis take the time of their nearest step, unless another row is nearer to it or on it.

    Of equally near rows the earlier one takes the step.  Rows that find it taken keep
    their time, and so does a row without a time or key; no row is lost.
    """
    keys = keys_list(keys)
    freq = freq_seconds * 1_000_000
    axis = _bounds(df, keys, ts, freq_seconds).select(*[F.col(k).alias(f"_axis_{k}") for k in keys], "_lo")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_axis_{k}")
    micros = F.unix_micros(F.col(ts))
    near = F.col("_lo") + F.floor((micros - F.col("_lo") + F.lit(freq // 2)) / F.lit(float(freq))) * F.lit(freq)
    placed = df.join(axis, same, "left").withColumn("_near", near)
    first = Window.partitionBy(*keys, "_near").orderBy(F.abs(micros - F.col("_near")), ts)
    takes = F.col("_near").isNotNull() & (F.row_number().over(first) == 1)
    moved = placed.withColumn("_takes", takes).withColumn(ts, F.when(F.col("_takes"), F.timestamp_micros("_near")).otherwise(F.col(ts)))
    return moved.select(*[ref(c) for c in df.columns])


def off_grid_report(
    df: DataFrame,
    freq_seconds: int,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
) -> DataFrame:
    """Rows per key, and how many of them do not fall on the axis.

    The axis starts at the first time of the key, so a row is off it when its
    phase within a step differs.  Counting per phase needs no join.
    """
    keys = keys_list(keys)
    phase = F.pmod(F.unix_micros(F.col(ts)), F.lit(freq_seconds * 1_000_000))
    per_phase = df.groupBy(*keys, phase.alias("_phase")).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_first"))
    totals = per_phase.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        F.min_by("_n", "_first").alias("_on"),
    )
    return totals.select(*keys, "rows", (F.col("rows") - F.col("_on")).alias("off_grid_rows"))


# How each canonical variable is combined when steps are merged.
_SUMMED = frozenset({"rain_mm"})
_PEAK = frozenset({"gust_ms"})


def _vector_mean(degrees: Column) -> Column:
    """Mean direction in [0, 360); NULL when the directions cancel out."""
    east, north = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    angle = F.degrees(F.atan2(east, north))
    calm = F.sqrt(east * east + north * north) < 1e-9
    return F.when(~calm, F.when(angle < 0, angle + 360.0).otherwise(angle))


def resample(
    df: DataFrame,
    rule_seconds: int,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    how: Mapping[str, str] | None = None,
) -> DataFrame:
    """Merge steps into longer ones, aligned to the epoch.

    Default: mean of state variables, sum of rain, peak of gusts, OR of flags,
    vector mean of the wind direction.  ``how`` overrides per column with
    ``mean``, ``sum``, ``max``, ``min``, ``first`` or ``last``.
    """
    keys = keys_list(keys)
    chosen = dict(how or {})
    micros = rule_seconds * 1_000_000
    slot = F.timestamp_micros(F.floor(F.unix_micros(F.col(ts)) / F.lit(float(micros))) * micros)

    def merged(field: T.StructField) -> Column | None:
        column, rule = ref(field.name), chosen.get(field.name)
        if rule in ("first", "last"):
            pick = F.min_by if rule == "first" else F.max_by
            return F.when(F.count(column) > 0, pick(column, F.when(column.isNotNull(), ref(ts))))
        if rule is not None:
            return {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[rule](column)
        if isinstance(field.dataType, T.BooleanType):
            # A merged step is a gap only when all its steps are.
            return F.min(column) if field.name == GAP_COLUMN else F.max(column)
        if not isinstance(field.dataType, T.NumericType):
            return None
        if field.name in _SUMMED:
            return F.sum(column)
        if field.name in _PEAK:
            return F.max(column)
        if field.name == "wdir_deg":
            return _vector_mean(column)
        return F.avg(column)

    aggregates = [
        expr.alias(field.name)
        for field in df.schema.fields
        if field.name not in {*keys, ts} and (expr := merged(field)) is not None
    ]
    return df.groupBy(*keys, slot.alias(ts)).agg(*aggregates)
