"""Calendar parts and cyclic encodings, all in UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def calendar_columns(ts: Column, cyclic: bool = True) -> dict[str, Column]:
    """hour, weekday (Monday 0), month, doy, and their sine/cosine pairs."""
    out = {
        "hour": F.hour(ts),
        "weekday": F.weekday(ts),
        "month": F.month(ts),
        "doy": F.dayofyear(ts),
    }
    if cyclic:
        hour_angle = F.hour(ts) * F.lit(TWO_PI) / 24.0
        doy_angle = F.dayofyear(ts) * F.lit(TWO_PI) / 365.25
        out |= {
            "hour_sin": F.sin(hour_angle),
            "hour_cos": F.cos(hour_angle),
            "doy_sin": F.sin(doy_angle),
            "doy_cos": F.cos(doy_angle),
        }
    return out


def wind_direction_columns(direction: Column) -> dict[str, Column]:
    return {"wdir_sin": F.sin(F.radians(direction)), "wdir_cos": F.cos(F.radians(direction))}
