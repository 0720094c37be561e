"""Synthetic station values along an existing time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_values(i: Column) -> dict[str, Column]:
    """Smooth waves in the step number; what is not listed rests at zero."""
    x = i.cast("double")
    return {
        "temp_c": F.sin(x / 12.0) + 12.0,
        "rh_pct": F.cos(x / 18.0) + 70.0,
        "pres_hpa": F.sin(x / 40.0) + 1015.0,
        "wspd_kmh": F.abs(F.sin(x / 7.0)) + 3.6,
        "gust_kmh": F.abs(F.sin(x / 5.0)) + 7.2,
        "wdir_deg": F.pmod(i * 15, F.lit(360)).cast("double"),
        **{c: F.lit(0.0) for c in ("rain_mm", "rain_rate_mmh", "solar_wm2", "uv_index")},
    }


def synthetic_station(
    spark: SparkSession, rows: int, stations: int = 1, start: str = "2024-01-01 00:00:00", freq_seconds: int = 600
) -> DataFrame:
    """``rows`` steps for each of ``stations`` stations, made in parallel."""
    ids = spark.range(rows * stations)
    i = F.pmod(F.col("id"), F.lit(rows))
    base = F.unix_micros(F.lit(start).cast("timestamp"))
    station = F.format_string("station_%05d", F.floor(F.col("id") / F.lit(float(rows))))
    return ids.select(
        station.alias("station_id"),
        F.timestamp_micros(base + i * (freq_seconds * 1_000_000)).alias("ts_utc"),
        *[v.alias(c) for c, v in synthetic_values(i).items()],
    )
