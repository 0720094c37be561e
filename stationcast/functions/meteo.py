"""Derived meteorological variables from published formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dew_point_c(temp: Column, rh: Column) -> Column:
    """Magnus formula over water (17.62, 243.12 °C)."""
    # ln of a non-positive humidity has no value.
    gamma = F.when(rh > 0, F.log(rh / 100.0)) + temp * 17.62 / (temp + 243.12)
    return F.lit(243.12) * gamma / (F.lit(17.62) - gamma)


def vpd_kpa(temp: Column, rh: Column) -> Column:
    """Vapour pressure deficit with the FAO-56 saturation pressure."""
    saturation = F.lit(0.6108) * F.exp(temp * 17.27 / (temp + 237.3))
    return saturation * (F.lit(1.0) - rh / 100.0)


def heat_index_c(temp: Column, rh: Column) -> Column:
    """US weather service heat index: simple form below 80 °F, else the regression."""
    t = temp * 1.8 + 32.0
    simple = (t + 61.0 + (t - 68.0) * 1.2 + rh * 0.094) * 0.5
    # Published regression coefficients.
    full = (
        F.lit(-42.379)
        + t * 2.04901523
        + rh * 10.14333127
        - t * rh * 0.22475541
        - t * t * 0.00683783
        - rh * rh * 0.05481717
        + t * t * rh * 0.00122874
        + t * rh * rh * 0.00085282
        - t * t * rh * rh * 0.00000199
    )
    dry = F.when(
        (rh < 13.0) & t.between(80.0, 112.0),
        (F.lit(13.0) - rh) / 4.0 * F.sqrt((F.lit(17.0) - F.abs(t - 95.0)) / 17.0),
    ).otherwise(0.0)
    humid = F.when((rh > 85.0) & t.between(80.0, 87.0), (rh - 85.0) / 10.0 * (F.lit(87.0) - t) / 5.0).otherwise(0.0)
    index = F.when((simple + t) / 2.0 < 80.0, simple).otherwise(full - dry + humid)
    return (index - 32.0) / 1.8


def wind_chill_c(temp: Column, wind_ms: Column) -> Column:
    """2001 wind chill; air temperature outside its range of validity."""
    kmh = wind_ms * 3.6
    p = F.pow(kmh, F.lit(0.16))
    chill = F.lit(13.12) + temp * 0.6215 - p * 11.37 + temp * p * 0.3965
    return F.when((temp <= 10.0) & (kmh > 4.8), chill).when(wind_ms.isNotNull(), temp)


# metric name -> (output column, inputs, formula)
DERIVED = {
    "dew_point": ("dew_point_c", ("temp_c", "rh_pct"), dew_point_c),
    "vpd": ("vpd_kpa", ("temp_c", "rh_pct"), vpd_kpa),
    "heat_index": ("heat_index_c", ("temp_c", "rh_pct"), heat_index_c),
    "wind_chill": ("wind_chill_c", ("temp_c", "wspd_ms"), wind_chill_c),
}


def derived_columns(present: list[str], metrics: list[str]) -> dict[str, Column]:
    """Expressions of the wanted metrics whose inputs are present."""
    out: dict[str, Column] = {}
    for metric in metrics:
        if metric not in DERIVED:
            raise ValueError(f"unknown derived metric {metric!r}")
        name, inputs, formula = DERIVED[metric]
        if all(c in present for c in inputs):
            out[name] = formula(*[F.col(c) for c in inputs])
    return out
