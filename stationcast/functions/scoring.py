"""Aggregate expressions for forecast errors and the skill score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAPE_EPSILON = 1e-6
# Binary places of the parts a value is cut into, highest first: 30 bits each below the first.
_PLACES = (60, 30, 0, -30, -60, -90, -120)
_EXACT_BELOW = 2.0**90


def is_finite(value: Column) -> Column:
    number = value.cast("double")
    infinite = F.abs(number) == F.lit(float("inf"))
    return F.coalesce(~F.isnan(number) & ~infinite, F.lit(False))


def finite_pair(y_true: Column, y_pred: Column) -> Column:
    return is_finite(y_true) & is_finite(y_pred)


def stable_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows or on partitions.

    A value is cut into whole numbers of fixed binary places; these add up exactly, so
    only the last step, from at most seven totals to one double, rounds. Exact for sizes
    below 2^90 and places down to 2^-120 and up to 2^33 rows; larger values, infinities and
    NaN are added the usual way. NULL without any value.
    """
    number = value.cast("double")
    size = F.abs(number)
    usable = is_finite(number) & (size < F.lit(_EXACT_BELOW))
    sign = F.when(number < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")

    def part(k: int) -> Column:
        scaled = size * F.lit(2.0 ** -_PLACES[k])
        digit = F.floor(scaled if k == 0 else scaled % F.lit(2.0**30))
        return F.sum(F.when(usable, sign * digit)).cast("double") * F.lit(2.0 ** _PLACES[k])

    total = part(0)
    for k in range(1, len(_PLACES)):
        total = total + part(k)
    others = F.sum(F.when(number.isNotNull() & ~usable, number))
    return F.when(others.isNull(), total).when(total.isNull(), others).otherwise(total + others)


def stable_mean(value: Column) -> Column:
    return stable_sum(value) / F.nullif(F.count(value), F.lit(0))


def mae(y_true: Column, y_pred: Column) -> Column:
    return stable_mean(F.when(finite_pair(y_true, y_pred), F.abs(y_true - y_pred)))


def rmse(y_true: Column, y_pred: Column) -> Column:
    error = y_true - y_pred
    return F.sqrt(stable_mean(F.when(finite_pair(y_true, y_pred), error * error)))


def mape(y_true: Column, y_pred: Column, epsilon: float = MAPE_EPSILON) -> Column:
    """Percentage error over rows whose truth is not near zero; NULL when none is."""
    usable = finite_pair(y_true, y_pred) & (F.abs(y_true) > F.lit(float(epsilon)))
    return stable_mean(F.when(usable, F.abs((y_true - y_pred) / y_true))) * 100.0


def skill(model_rmse: Column, anchor_rmse: Column) -> Column:
    """1 - rmse²/anchor²; NULL for a missing, infinite or non-positive anchor."""
    usable = is_finite(anchor_rmse) & (anchor_rmse > 0)
    return F.when(usable, F.lit(1.0) - (model_rmse * model_rmse) / (anchor_rmse * anchor_rmse))
