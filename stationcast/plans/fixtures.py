"""Station data derived from the ``events`` table.

Each event type is a station, observed hourly with natural gaps; ``user_grid``
has one station per user on a ten-minute grid.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.functions.encoding import calendar_columns
from stationcast.functions.names import target_column
from stationcast.operators import linear
from stationcast.operators.evaluate import attach_skill, evaluate_predictions
from stationcast.operators.experiment import ExperimentOptions, baseline_experiment
from stationcast.operators.features import make_supervised
from stationcast.operators.grid import insert_gaps
from stationcast.operators.splits import chronological_split, split_metadata
from stationcast.operators.windows import lag_expressions, lead_expressions, apply_rolling
from stationcast.operators.buckets import Halo, grid_step
from stationcast.session import new_path, prepare_session

HOUR = 3_600
TARGET = "temp_c"
HORIZONS = {"h01": 1, "h06": 6}
LAGS = (1, 3, 6)
WINDOW = 6
VARIABLES = ("temp_c", "rh_pct", "wspd_ms", "gust_ms", "wdir_deg", "rain_mm")
ZONE = "Europe/Athens"
ROSTER = ("persistence", "moving_average", "linear_regression", "ridge")
OPTIONS = ExperimentOptions(
    target=TARGET, freq_seconds=HOUR, horizons=HORIZONS, optional_horizons={}, lags=LAGS, on_empty="keep"
)

# Layout of the derived raw exports: canonical name -> source column and unit.
RAW_MAPPING: Mapping = {
    "ts": {"col": "Date (Europe/Athens)", "timezone": ZONE},
    "fields": {
        "temp_c": {"col": "temp (°C)", "unit": "C"},
        "rh_pct": {"col": "hum (%)", "unit": "%"},
        "wspd_ms": {"col": "wspdavg (km/h)", "unit": "km/h"},
        "gust_ms": {"col": "wspdhi (km/h)", "unit": "km/h"},
        "uv_index": {"col": "uvi", "unit": "index"},
    },
}


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """An interim table, written once per session and source folder.

    Later steps read it several times; without it they would repeat all the work
    before it each time.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = new_path(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def forget_stored() -> None:
    """Build the interim tables anew, so that a timing includes them."""
    _STORED.clear()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_session(spark)
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", k)


def cents(value: Column) -> Column:
    """Values have two decimals; whole cents add up the same in any order."""
    return F.round(value * 100).cast("bigint")


def station_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return (
        events(spark, sf_dir)
        .groupBy(F.col("event_type").alias("station_id"), F.date_trunc("hour", "ts").alias("ts_utc"))
        .agg(
            (F.sum(cents(F.col("value"))) / (n * 1000.0)).alias("temp_c"),
            (F.sum("k") / n).cast("double").alias("rh_pct"),
            (F.min("value") / 10.0).alias("wspd_ms"),
            (F.max("value") / 10.0).alias("gust_ms"),
            F.pmod(F.sum("user_id") * 15, F.lit(360)).cast("double").alias("wdir_deg"),
            (n * 2.0 / 10.0).alias("rain_mm"),
        )
    )


def station_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_gaps(station_obs(spark, sf_dir), HOUR)


def user_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute means per user."""
    slot = F.timestamp_micros(F.floor(F.unix_micros("ts") / F.lit(6e8)) * 600_000_000)
    n = F.count(F.lit(1))
    return (
        events(spark, sf_dir)
        .groupBy(F.col("user_id").cast("string").alias("station_id"), slot.alias("ts_utc"))
        .agg(
            (F.sum(cents(F.col("value"))) / (n * 1000.0)).alias("temp_c"),
            (F.sum("k") / n).cast("double").alias("rh_pct"),
            (F.max("value") / 10.0).alias("gust_ms"),
        )
    )


def user_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_gaps(user_obs(spark, sf_dir), 600)


def _supervised_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete feature rows with a target column per horizon, from one window pass."""
    grid = station_grid(spark, sf_dir)
    halo = Halo("station_id", grid_step(F.col("ts_utc"), HOUR), max(*LAGS, WINDOW), max(HORIZONS.values()))
    rolled = apply_rolling(halo.open(grid), halo.spec, [TARGET], [WINDOW])
    wide = halo.close(
        rolled.withColumns(calendar_columns(F.col("ts_utc"))).select(
            "*",
            *lag_expressions(halo.spec, [TARGET, "rh_pct"], LAGS),
            *lead_expressions(halo.spec, TARGET, list(HORIZONS.values())),
        )
    )
    targets = {target_column(TARGET, h) for h in HORIZONS.values()}
    return wide.dropna("any", subset=[f"`{c}`" for c in wide.columns if c not in targets])


def supervised_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "supervised", _supervised_wide)


def supervised(spark: SparkSession, sf_dir: str, steps: int) -> DataFrame:
    wide = supervised_wide(spark, sf_dir)
    wanted = target_column(TARGET, steps)
    others = [target_column(TARGET, h) for h in HORIZONS.values() if h != steps]
    return wide.drop(*others).dropna("any", subset=[f"`{wanted}`"])


def split_rows(spark: SparkSession, sf_dir: str, steps: int = 1) -> DataFrame:
    return stored(
        spark, sf_dir, f"split-{steps}", lambda *_: chronological_split(supervised(spark, sf_dir, steps), on_empty="keep")
    )


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split rows to fit on: windowed features, or the present values where no row has complete windows."""
    rows = split_rows(spark, sf_dir)
    if not rows.where(F.col("split") == "train").isEmpty():
        return rows
    present = simple_supervised(spark, sf_dir).dropna("any")
    others = [target_column(TARGET, h) for h in HORIZONS.values() if h != 1]
    return stored(spark, sf_dir, "split-present", lambda *_: chronological_split(present.drop(*others), on_empty="keep"))


def simple_supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present and future target only; has rows even where coverage is low."""
    return make_supervised(
        station_grid(spark, sf_dir), TARGET, list(HORIZONS.values()), [], HOUR, lag_columns=[], drop_incomplete=False
    ).where(F.col(TARGET).isNotNull())


def baseline_rows(spark: SparkSession, sf_dir: str, options: ExperimentOptions = OPTIONS) -> DataFrame:
    return baseline_experiment(supervised_wide(spark, sf_dir), options)


def linear_rows(spark: SparkSession, sf_dir: str, steps: int, label: str) -> DataFrame:
    """Least squares on the present value, per station."""
    y = target_column(TARGET, steps)
    rows = split_rows(spark, sf_dir, steps)
    models = linear.fit_ols(rows.where(F.col("split") == "train"), [TARGET], y)
    scored = linear.predict_linear(rows.where(F.col("split") == "test"), models, [TARGET])
    return scored.select(
        "station_id",
        F.lit(label).alias("horizon_label"),
        F.lit(steps).alias("horizon_steps"),
        F.lit("linear_regression").alias("model"),
        F.lit("ml").alias("model_family"),
        "ts_utc",
        F.col(f"`{y}`").alias("y_true"),
        "y_pred",
        F.lit(TARGET).alias("target"),
    )


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines and a linear model on the test rows of both horizons."""
    out = baseline_rows(spark, sf_dir)
    for label, steps in HORIZONS.items():
        out = out.unionByName(linear_rows(spark, sf_dir, steps, label))
    return out


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "predictions", _predictions)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "metrics", lambda *_: attach_skill(evaluate_predictions(predictions(spark, sf_dir)))
    )


def delta_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run that measured the moving average anew, over lags instead of a window."""
    wide = supervised_wide(spark, sf_dir)
    no_windows = wide.drop(*[c for c in wide.columns if "_roll" in c])
    options = ExperimentOptions(
        target=TARGET, freq_seconds=HOUR, horizons=HORIZONS, optional_horizons={}, lags=LAGS,
        baselines=("moving_average",), on_empty="keep",
    )
    scored = evaluate_predictions(baseline_experiment(no_windows, options))
    return attach_skill(scored).withColumn("skill_score_persistence", F.lit(None).cast("double"))


def metadata(spark: SparkSession, sf_dir: str, label: str, steps: int, train: float = 0.70) -> DataFrame:
    y = target_column(TARGET, steps)
    rows = chronological_split(supervised(spark, sf_dir, steps), train=train, on_empty="keep")
    return split_metadata(rows, y, [TARGET]).withColumn("horizon_label", F.lit(label))


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw export rows per station and minute, as text, in local time and local units."""
    minute = F.date_trunc("minute", "ts")
    n = F.count(F.lit(1))
    rows = (
        events(spark, sf_dir)
        .groupBy(F.col("event_type").alias("station"), minute.alias("_m"))
        .agg(
            F.format_number(F.sum(cents(F.col("value"))) / 100.0, 2).alias("temp (°C)"),
            F.sum("k").cast("string").alias("hum (%)"),
            F.min("value").cast("string").alias("wspdavg (km/h)"),
            F.max("value").cast("string").alias("wspdhi (km/h)"),
            n.cast("string").alias("uvi"),
        )
    )
    return rows.select("station", F.date_format("_m", "dd/MM/yyyy HH:mm:ss").alias("Date (Europe/Athens)"), *rows.columns[2:])
