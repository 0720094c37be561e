"""Row-wise quality checks; values are flagged, never changed."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical bounds of each canonical variable.
RANGE_BOUNDS = {
    "temp_c": (-80.0, 60.0),
    "rh_pct": (0.0, 100.0),
    "pres_hpa": (500.0, 1100.0),
    "wspd_ms": (0.0, 75.0),
    "gust_ms": (0.0, 150.0),
    "wdir_deg": (0.0, 360.0),
    "rain_mm": (0.0, 500.0),
    "rain_rate_mmh": (0.0, 2000.0),
    "solar_wm2": (0.0, 1600.0),
    "uv_index": (0.0, 25.0),
}

# Zero is the normal resting value of these; a dry gauge is not a stuck one.
RESTING_AT_ZERO = frozenset({"rain_mm", "rain_rate_mmh", "solar_wm2", "uv_index"})


def flag_name(check: str, column: str) -> str:
    return f"qc_{check}_{column}"


def true_or_false(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def range_flags(present: list[str], bounds: dict[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    limits = RANGE_BOUNDS if bounds is None else bounds
    return {
        flag_name("range", c): true_or_false(~F.col(c).between(F.lit(lo), F.lit(hi)))
        for c, (lo, hi) in limits.items()
        if c in present
    }


def consistency_flag(present: list[str]) -> Column:
    """Gust below wind, dew point above air, or rain in very dry air."""
    rules: list[Column] = []
    have = set(present)
    if {"gust_ms", "wspd_ms"} <= have:
        rules.append(F.col("gust_ms") < F.col("wspd_ms"))
    if {"dew_point_c", "temp_c"} <= have:
        rules.append(F.col("dew_point_c") > F.col("temp_c") + 0.1)
    if {"rain_rate_mmh", "rh_pct"} <= have:
        rules.append((F.col("rain_rate_mmh") > 0) & (F.col("rh_pct") < 10.0))
    return any_of([true_or_false(r) for r in rules])


def any_of(flags: list[Column]) -> Column:
    return reduce(or_, flags) if flags else F.lit(False)
