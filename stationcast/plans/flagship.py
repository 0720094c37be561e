"""The shortest path from observations to scored forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.operators.baselines import baseline_predictions
from stationcast.operators.evaluate import attach_skill, evaluate_predictions
from stationcast.operators.features import stack_horizons
from stationcast.operators.splits import chronological_split
from stationcast.plans import fixtures as fx
from stationcast.plans.catalog import finish, register
from stationcast.plans.sql import SCORES, query, rounded

_SQL = query(
    f"""SELECT station_id, target, horizon_label, horizon_steps, model, model_family, {rounded('mae')}, {rounded('rmse')},
    {rounded('mape')}, n_test, CASE WHEN rmse > 0 THEN 0e0 END AS skill_score_persistence FROM (
    SELECT station_id, 'temp_c' AS target, horizon_label, horizon_steps, 'persistence' AS model, 'baseline' AS model_family, {SCORES} FROM (
    SELECT *, row_number() OVER (PARTITION BY station_id, horizon_label ORDER BY ts_utc) AS rn,
    count(*) OVER (PARTITION BY station_id, horizon_label) AS n FROM (
    SELECT station_id, ts_utc, temp_c AS y_pred, 'h01' AS horizon_label, 1 AS horizon_steps, y1 AS y_true FROM features UNION ALL
    SELECT station_id, ts_utc, temp_c, 'h06', 6, y6 FROM features) WHERE y_pred IS NOT NULL AND y_true IS NOT NULL)
    WHERE rn > n * 85 // 100 GROUP BY ALL)""",
    ("features",),
)


def persistence_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence errors per station and horizon on the last 15 % of the rows."""
    rows = fx.simple_supervised(spark, sf_dir)
    stacked = stack_horizons(rows, fx.TARGET, fx.HORIZONS, ["station_id", "ts_utc", fx.TARGET])
    split = chronological_split(stacked, keys=["station_id", "horizon_label"], on_empty="keep")
    scored = baseline_predictions(split, fx.TARGET, ["persistence"]).withColumn("target", F.lit(fx.TARGET))
    return finish(attach_skill(evaluate_predictions(scored)))


register("persistence_skill", _SQL)(persistence_skill)
