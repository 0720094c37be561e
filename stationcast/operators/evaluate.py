"""Forecast errors, skill scores and the report table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast.functions import scoring
from stationcast.functions.names import ref

SERIES = ("station_id", "target", "horizon_label", "horizon_steps", "model", "model_family")
REPORT_COLUMNS = (
    "model_family",
    "model",
    "horizon_label",
    "horizon_steps",
    "mae",
    "rmse",
    "mape",
    "skill_score_persistence",
    "n_test",
)


def evaluate_predictions(
    predictions: DataFrame,
    keys: Sequence[str] = SERIES,
    epsilon: float = scoring.MAPE_EPSILON,
    strict: bool = True,
) -> DataFrame:
    """mae, rmse, mape and n_test per series, in one pass.

    Errors use pairs whose both values are finite; ``n_test`` counts every row.
    ``strict`` fails on a series without any finite pair, else its errors are NULL.
    """
    present = [k for k in keys if k in predictions.columns]
    t, p = F.col("y_true"), F.col("y_pred")
    usable = F.count(F.when(scoring.finite_pair(t, p), 1))
    mae = scoring.mae(t, p)
    if strict:
        problem = F.raise_error(F.lit("no finite values available for metric calculation")).cast("double")
        mae = F.when(usable == 0, problem).otherwise(mae)
    return predictions.groupBy(*present).agg(
        mae.alias("mae"),
        scoring.rmse(t, p).alias("rmse"),
        scoring.mape(t, p, epsilon).alias("mape"),
        F.count(F.lit(1)).alias("n_test"),
    )


def attach_skill(
    metrics: DataFrame,
    within: Sequence[str] = ("run_id", "station_id", "target"),
    anchor_model: str = "persistence",
) -> DataFrame:
    """Add ``skill_score_persistence`` against the anchor row of the same horizon.

    NULL where a horizon has no usable anchor.  A group holds one row per model.
    """
    if "horizon_label" not in metrics.columns:
        return metrics
    group = [c for c in within if c in metrics.columns] + ["horizon_label"]
    spec = Window.partitionBy(*group)
    anchor = F.max(F.when(F.col("model") == anchor_model, F.col("rmse"))).over(spec)
    return metrics.withColumn("skill_score_persistence", scoring.skill(F.col("rmse"), anchor))


def _cell(field: T.StructField) -> Column:
    column = ref(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        text = F.when(column.isNotNull() & ~F.isnan(column), F.format_string("%.4f", column))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(""))


def metrics_report(metrics: DataFrame, columns: Sequence[str] = REPORT_COLUMNS, keys: Sequence[str] = ()) -> DataFrame:
    """Report cells as text, ordered by horizon, family and model."""
    fields = {f.name: f for f in metrics.schema.fields}
    shown = [c for c in [*keys, *columns] if c in fields]
    order = [c for c in (*keys, "horizon_steps", "model_family", "model") if c in fields]
    return metrics.orderBy(*order).select(*[_cell(fields[c]).alias(c) for c in shown])


def report_lines(report: DataFrame) -> DataFrame:
    """The report as Markdown table lines, in the order of ``report``."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c) for c in report.columns]), F.lit(" |"))
    return report.select(cells.alias("line"))


def order_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(*[c for c in ("horizon_steps", "model_family", "model") if c in metrics.columns])


def evaluate_saved(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Report from saved metrics; the skill score is added only when absent."""
    full = metrics if "skill_score_persistence" in metrics.columns else attach_skill(metrics)
    return metrics_report(full, keys=keys)
