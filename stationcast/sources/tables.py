"""Parquet, prediction, metric and metadata tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_series(df: DataFrame, path: str, keys: Sequence[str] = ("station_id",), ts: str = "ts_utc") -> None:
    """Canonical, prepared or supervised table, in time order within each file.

    Range partitioning on key and time splits a long station over many files and
    lets scans skip files by time.
    """
    keys = list(keys)
    # Folders per station would multiply small files; range order prunes as well.
    df.repartitionByRange(*[F.col(k) for k in keys], F.col(ts)).sortWithinPartitions(*keys, ts).write.mode(
        "overwrite"
    ).parquet(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per model and horizon; what a folder held before is replaced.

    ``df`` holds all stations of its models and horizons.  Other folders stay.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "horizon_label")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def usable_predictions(df: DataFrame) -> DataFrame:
    return df.dropna("any", subset=["y_true", "y_pred"])


def load_predictions(
    spark: SparkSession, path: str, model: str, horizon_label: str, schema: StructType | None = None
) -> DataFrame:
    """Predictions of one model and horizon without incomplete rows; no rows when absent.

    A ``schema`` is needed only where the table may hold no file at all.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(path).where((F.col("model") == model) & (F.col("horizon_label") == horizon_label))
    return usable_predictions(rows)


def write_metrics(metrics: DataFrame, path: str, part: str = "") -> None:
    """The same rows as CSV and as JSON, where missing values are explicit nulls.

    ``part`` names a folder below ``csv`` and ``json``, for runs that keep theirs apart.
    """
    clean = metrics.select(
        *[
            F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in metrics.dtypes
        ]
    )
    clean.write.mode("overwrite").option("header", True).csv(f"{path}/csv/{part}")
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/json/{part}")


def read_metrics(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Metrics written by ``write_metrics``; metrics tables are small, so types may be inferred."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(f"{path}/csv")


def write_per_horizon(df: DataFrame, label: str, path: str, fmt: str = "parquet") -> None:
    """Rows of one horizon in its folder; what the folder held before is replaced, other horizons stay."""
    rows = df.withColumn("horizon_label", F.lit(label))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("horizon_label").format(fmt).save(path)


def write_split_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").partitionBy("horizon_label").option("ignoreNullFields", False).json(path)
