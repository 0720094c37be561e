"""A whole experiment: supervised tables, splits, scalers, models, metrics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast.functions.names import lag_columns_of, ref, rolling_column, rolling_mean_windows, target_column
from stationcast.operators import baselines, linear, trees
from stationcast.operators.evaluate import attach_skill, evaluate_predictions
from stationcast.operators.features import make_supervised, select_feature_columns, stack_horizons
from stationcast.operators.scaling import METHODS, apply_scaler, fit_scaler, fit_target_scaler, scalable_columns
from stationcast.operators.splits import chronological_split, split_boundaries, split_metadata
from stationcast.session import new_path, stage
from stationcast.sources.run_store import begin_run, read_run
from stationcast.sources.tables import write_metrics, write_per_horizon, write_predictions

PER_SERIES_MODELS = ("ridge", "linear_regression")
POOLED_MODELS = ("random_forest", "gradient_boosting")


@dataclass(frozen=True)
class ExperimentOptions:
    """What to forecast and how; times are in grid steps."""

    target: str = "temp_c"
    freq_seconds: int = 600
    horizons: Mapping[str, int] = field(default_factory=lambda: {"h01": 6, "h03": 18, "h06": 36, "h12": 72})
    optional_horizons: Mapping[str, int] = field(default_factory=lambda: {"m10": 1, "h24": 144})
    lags: tuple[int, ...] = (1, 3, 6, 12, 24, 72, 144)
    train: float = 0.70
    validation: float = 0.15
    test: float = 0.15
    scaling: str = "standard"
    baselines: tuple[str, ...] = baselines.BASELINES
    ml: tuple[str, ...] = ("ridge", "random_forest", "gradient_boosting")
    seed: int = 42
    mape_epsilon: float = 1e-6
    keys: tuple[str, ...] = ("station_id",)
    ts: str = "ts_utc"
    on_empty: str = "error"

    def __post_init__(self) -> None:
        if abs(self.train + self.validation + self.test - 1.0) > 1e-6:
            raise ValueError("split fractions must sum to 1")
        if self.scaling not in METHODS:
            raise ValueError(f"unsupported scaler method {self.scaling!r}")
        unknown = set(self.ml) - {*PER_SERIES_MODELS, *POOLED_MODELS}
        if unknown:
            raise ValueError(f"unknown models {sorted(unknown)}")

    def resolved_horizons(self) -> dict[str, int]:
        """Required and optional horizons, nearest first; required ones win on a shared name."""
        merged = {**self.optional_horizons, **self.horizons}
        return dict(sorted(merged.items(), key=lambda item: item[1]))


def supervised_all(prepared: DataFrame, options: ExperimentOptions, lag_columns: list[str] | None = None) -> DataFrame:
    """Rows with complete features, and one target column per horizon."""
    steps = list(options.resolved_horizons().values())
    wide = make_supervised(
        prepared, options.target, steps, options.lags, options.freq_seconds, lag_columns,
        drop_incomplete=False, keys=options.keys, ts=options.ts,
    )
    targets = {target_column(options.target, h) for h in steps}
    return wide.dropna("any", subset=[f"`{c}`" for c in wide.columns if c not in targets])


def _split(df: DataFrame, options: ExperimentOptions, keys: list[str]) -> DataFrame:
    """Rows in the order they had: the boundaries are stored, so that Spark sees how small they are."""
    bounds = stage(split_boundaries(df, options.train, options.validation, keys, options.ts, options.on_empty), "split-bounds")
    return chronological_split(df, keys=keys, ts=options.ts, boundaries=bounds)


def baseline_experiment(supervised: DataFrame, options: ExperimentOptions) -> DataFrame:
    """Baseline test predictions of all horizons in one job, on unscaled values."""
    target = options.target
    keep = [*options.keys, options.ts, target]
    if "moving_average" in options.baselines:
        windows = rolling_mean_windows(supervised.columns, target)
        keep += [rolling_column(target, windows[0], "mean")] if windows else lag_columns_of(supervised.columns, target)
    stacked = stack_horizons(supervised, target, options.resolved_horizons(), keep)
    split = _split(stacked, options, [*options.keys, "horizon_label"])
    predictions = baselines.baseline_predictions(split, target, options.baselines, list(options.keys), options.ts)
    return predictions.withColumn("target", F.lit(target))


def evaluate_run(predictions: DataFrame, options: ExperimentOptions) -> DataFrame:
    keys = [*options.keys, "target", "horizon_label", "horizon_steps", "model", "model_family"]
    metrics = evaluate_predictions(predictions, keys, options.mape_epsilon)
    return attach_skill(metrics, (*options.keys, "target"))


def fit_predict(
    name: str, train: DataFrame, test: DataFrame, features: list[str], label: str, options: ExperimentOptions,
    keep: str | None = None,
) -> DataFrame:
    """Test predictions of one model: linear ones per series, ensembles over all series.

    With ``keep`` the fitted model is stored in that folder: linear ones as a table with
    their feature names, which the predictions then read, ensembles as Spark ML stores them.
    """
    keys = list(options.keys)
    if name in POOLED_MODELS:
        ensemble = trees.fit_model(train, features, label, name, options.seed)
        if keep:
            trees.save_model(ensemble, keep)
        return trees.score(test, ensemble, features)
    if name == "ridge":
        models = linear.fit_ridge_cv(train, features, label, keys, options.ts)
    else:
        models = linear.fit_ols(train, features, label, keys)
    if keep:
        models = models.withColumn("features", F.lit(features))
        models.write.mode("errorifexists").parquet(keep)
        models = train.sparkSession.read.schema(models.schema).parquet(keep)
    return linear.predict_linear(test, models, features, keys, [options.ts])


def run_experiment(prepared: DataFrame, options: ExperimentOptions, output: str | None = None) -> DataFrame:
    """Run all horizons and models; returns the metrics with skill scores.

    Stored under ``output``: predictions and fitted models (by model and horizon), split
    metadata, scalers, metrics.  All of them are published together at the end, so a run
    that fails leaves what was published before (``run_store.read_run``).  A second run
    into one folder replaces what the first wrote of its models and horizons, and its
    metrics take in the predictions that stay.  The supervised table is written once for
    all horizons, and the scaled table of a horizon once for all its models.
    """
    spark = prepared.sparkSession
    output = output or new_path(spark, "experiment")
    run = begin_run(spark, output)
    target, keys = options.target, list(options.keys)
    # rows in a fixed order within each file, so that fits add up alike in every run
    order = [*keys, options.ts]
    supervised = stage(supervised_all(prepared, options).sortWithinPartitions(*order), "supervised")
    predictions_path = run.folder("predictions")
    if options.baselines:
        write_predictions(baseline_experiment(supervised, options), predictions_path)

    horizons = options.resolved_horizons()
    others = {target_column(target, h) for h in horizons.values()}
    for label, steps in horizons.items():
        y = target_column(target, steps)
        rows = supervised.where(ref(y).isNotNull()).drop(*(others - {y}))
        split = _split(rows, options, keys)
        features = select_feature_columns(rows, y, not_features=keys)
        write_per_horizon(split_metadata(split, y, features, keys, options.ts), label, run.folder("split_metadata"), "json")
        scaled_columns = scalable_columns(rows, features)
        scaler = stage(fit_scaler(split, scaled_columns, options.scaling, keys, ts=options.ts), "scaler")
        write_per_horizon(scaler, label, run.folder("scalers"))
        write_per_horizon(fit_target_scaler(split, y, options.scaling, keys, ts=options.ts), label, run.folder("target_scalers"))
        for table in ("split_metadata", "scalers", "target_scalers"):
            run.add(table, horizon_label=label)
        if not options.ml:
            continue
        scaled = apply_scaler(split, scaler, scaled_columns, keys, [options.ts])
        scaled = stage(scaled.sortWithinPartitions("split", *order), "scaled", ["split"])
        train, test = scaled.where(F.col("split") == "train"), scaled.where(F.col("split") == "test")
        for name in options.ml:
            scored = fit_predict(name, train, test, features, y, options, run.folder("models", name, label))
            run.add("models", name, label)
            write_predictions(
                scored.select(
                    *keys,
                    F.lit(target).alias("target"),
                    F.lit(label).alias("horizon_label"),
                    F.lit(steps).alias("horizon_steps"),
                    F.lit(name).alias("model"),
                    F.lit("ml").alias("model_family"),
                    options.ts,
                    ref(y).alias("y_true"),
                    "y_pred",
                ),
                predictions_path,
            )
    if options.baselines or options.ml:
        run.add_written("predictions", spark.read.parquet(predictions_path))
    predictions = read_run(spark, output, "predictions", attempt=run)
    metrics = evaluate_run(predictions, options)
    for kind in ("csv", "json"):
        run.add(f"metrics/{kind}")
    write_metrics(metrics, f"{output}/metrics", f"attempt={run.attempt}")
    run.publish()
    return metrics
