"""Tree ensembles on Spark ML, their storage, and batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast.functions.names import ref

ML_MODELS = ("random_forest", "gradient_boosting", "linear_regression")


def _plain(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the features under plain names, which vector assembly can address."""
    return df.select("*", *[ref(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])


def make_estimator(name: str, seed: int = 42):
    # Ensemble sizes, depths and rates of the model roster.
    if name == "random_forest":
        return RandomForestRegressor(
            numTrees=100, maxDepth=12, minInstancesPerNode=2, featureSubsetStrategy="all", seed=seed
        )
    if name == "gradient_boosting":
        return GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed)
    if name == "linear_regression":
        return LinearRegression(regParam=0.0, solver="normal")
    raise ValueError(f"unknown model {name!r}")


def fit_model(train: DataFrame, features: Sequence[str], label: str, name: str, seed: int = 42) -> PipelineModel:
    """Fit one model over all rows of ``train``; the result predicts into ``y_pred``."""
    estimator = make_estimator(name, seed).setFeaturesCol("_features").setLabelCol("_label").setPredictionCol("y_pred")
    assembler = VectorAssembler(
        inputCols=[f"_x{i}" for i in range(len(features))], outputCol="_features", handleInvalid="error"
    )
    flat = _plain(train, features).withColumn("_label", ref(label).cast("double"))
    needed = flat.select("_label", *[f"_x{i}" for i in range(len(features))])
    return Pipeline(stages=[assembler, estimator]).fit(needed)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(df: DataFrame, model: Model, features: Sequence[str]) -> DataFrame:
    """Add ``y_pred`` to every row of a prepared (and scaled) split."""
    scored = model.transform(_plain(df, features))
    return scored.select(*[ref(c) for c in df.columns], F.col("y_pred"))
