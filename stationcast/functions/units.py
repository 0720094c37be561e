"""Numeric cleaning and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL_VARIABLES = (
    "temp_c",
    "rh_pct",
    "pres_hpa",
    "wspd_ms",
    "gust_ms",
    "wdir_deg",
    "rain_mm",
    "rain_rate_mmh",
    "solar_wm2",
    "uv_index",
)

# Units that already are the canonical ones, in lower case.
_SAME = {"c", "°c", "%", "hpa", "mbar", "m/s", "deg", "°", "mm", "mm/h", "w/m2", "w/m²", "index", ""}


def clean_numeric(text: Column) -> Column:
    """Text with optional thousands commas to DOUBLE; anything else gives NULL."""
    value = F.regexp_replace(F.trim(text), ",", "").try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def to_canonical(value: Column, unit: str | None) -> Column:
    """Convert a value in ``unit`` to the canonical unit of its variable."""
    key = (unit or "").strip().lower()
    if key in _SAME:
        return value
    if key in ("km/h", "kmh", "kph"):
        return value / F.lit(3.6)
    if key == "mph":
        return value * F.lit(0.44704)
    if key in ("kt", "kn", "knots"):
        return value * F.lit(1852.0) / F.lit(3600.0)
    if key in ("f", "°f"):
        return (value - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)
    if key == "k":
        return value - F.lit(273.15)
    if key == "inhg":
        return value * F.lit(33.8638866667)
    if key in ("in", "in/h"):
        return value * F.lit(25.4)
    if key == "pa":
        return value / F.lit(100.0)
    raise ValueError(f"unknown unit {unit!r}")
