"""Fixed-length sequence windows over supervised rows, written out or indexed in a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.functions.names import ref
from stationcast.operators.buckets import BUCKET_SECONDS, Halo, keys_list, with_position
from stationcast.session import stage

#: Rows of a chunk of the store; longer where windows are long, so that the rows held twice stay few.
CHUNK_ROWS = 4_096
_CHUNK_REACHES = 16


def sequence_windows(
    df: DataFrame,
    features: Sequence[str],
    target_column: str,
    length: int,
    keys: str | Sequence[str] = ("station_id", "split"),
    ts: str = "ts_utc",
    bucket_seconds: int = BUCKET_SECONDS,
    bucket_steps: int | None = None,
) -> DataFrame:
    """(keys, ts, sequence, label): the last ``length`` rows up to each row.

    Windows count rows, not time, and never cross a key; keep the split among
    the keys.  The first ``length - 1`` rows of a key end no window.  Rows are
    numbered across buckets first, because after dropping incomplete rows
    positions are no longer time steps.
    """
    if length < 1:
        raise ValueError("sequence length must be positive")
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"sequence features missing: {absent}")
    keys = keys_list(keys)
    narrow = df.select(
        *keys,
        ref(ts).alias(ts),
        F.array(*[ref(c).cast("double") for c in features]).alias("_x"),
        ref(target_column).cast("double").alias("label"),
    )
    numbered = with_position(narrow, keys, ts, "_pos", bucket_seconds)
    halo = Halo(keys, F.col("_pos"), length - 1, 0, bucket_steps)
    windowed = halo.open(numbered).withColumn(
        "sequence", F.collect_list("_x").over(halo.spec.rowsBetween(-(length - 1), 0))
    )
    return halo.close(windowed).where(F.col("_pos") >= length).select(*keys, ts, "sequence", "label")


def sequence_targets(
    df: DataFrame,
    target_column: str,
    length: int,
    keys: str | Sequence[str] = ("station_id", "split"),
    ts: str = "ts_utc",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """(keys, ts, label) of the rows that end a sequence of ``length``."""
    if length < 1:
        raise ValueError("sequence length must be positive")
    keys = keys_list(keys)
    narrow = df.select(*keys, ref(ts).alias(ts), ref(target_column).cast("double").alias("label"))
    numbered = with_position(narrow, keys, ts, "_pos", bucket_seconds)
    return numbered.where(F.col("_pos") >= length).select(*keys, ts, "label")


# --- the store ----------------------------------------------------------------


def write_sequence_store(
    df: DataFrame,
    features: Sequence[str],
    target_column: str,
    length: int,
    path: str,
    keys: str | Sequence[str] = ("station_id", "split"),
    ts: str = "ts_utc",
    chunk_rows: int | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
) -> None:
    """Store the windows of ``sequence_windows`` without writing each of them out.

    ``path/chunks`` holds the feature values of each key once, in blocks of ``chunk_rows``
    rows led by the ``length - 1`` rows before them, so that every window lies in one block.
    ``path/index`` has a row per window: its key, time and label, its block and the place in
    it. Written out, windows are ``length`` times the features; the store is about as large as
    they are. ``path/layout`` names the columns. A store that is there already is replaced.
    """
    if length < 1:
        raise ValueError("sequence length must be positive")
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"sequence features missing: {absent}")
    keys = keys_list(keys)
    rows = int(chunk_rows or max(CHUNK_ROWS, _CHUNK_REACHES * length))
    if rows < length:
        raise ValueError("a chunk must hold a whole sequence")
    narrow = df.select(
        *keys,
        ref(ts).alias(ts),
        F.array(*[ref(c).cast("double") for c in features]).alias("_x"),
        ref(target_column).cast("double").alias("label"),
    )
    numbered = stage(with_position(narrow, keys, ts, "_pos", bucket_seconds).withColumn("_pos", F.col("_pos") - 1), "numbered")
    chunk = F.floor(F.col("_pos") / F.lit(float(rows)))
    # a row near the end of a chunk also leads the next one
    last = F.floor((F.col("_pos") + (length - 1)) / F.lit(float(rows)))
    dealt = numbered.select(*keys, "_pos", "_x", F.explode(F.sequence(chunk, last)).alias("chunk"))
    # bounded by the rows of a chunk and its lead
    blocks = dealt.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("_pos", "_x"))).alias("_r"))
    whole = F.col("chunk") * rows < F.col("_r")[F.size("_r") - 1]["_pos"] + 1  # else it has a lead and no row of its own
    chunks = blocks.where(whole).select(*keys, "chunk", F.flatten(F.transform("_r", lambda r: r["_x"])).alias("values"))
    first = F.greatest(F.lit(0), F.col("_pos") - F.pmod(F.col("_pos"), F.lit(rows)) - (length - 1))
    index = numbered.where(F.col("_pos") >= length - 1).select(
        *keys, ts, "label", chunk.alias("chunk"), (F.col("_pos") - (length - 1) - first).cast("int").alias("offset")
    )
    spark = df.sparkSession
    layout = spark.range(1).select(
        F.array(*[F.lit(c) for c in features]).alias("features"),
        F.lit(int(length)).alias("length"),
        F.array(*[F.lit(k) for k in keys]).alias("keys"),
        F.lit(ts).alias("ts"),
    )
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    index.write.mode("overwrite").parquet(f"{path}/index")
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def read_sequence_store(spark: SparkSession, path: str, windows: Column | None = None) -> DataFrame:
    """(keys, ts, sequence, label) of a stored table of windows, or of those for which ``windows`` holds.

    Windows are cut from their blocks as they are read, by a join that moves each block and
    each index row once; a condition on key, time or label reaches the index first.
    """
    layout = spark.read.parquet(f"{path}/layout").first()
    keys, ts, width, length = list(layout["keys"]), layout["ts"], len(layout["features"]), layout["length"]
    index = spark.read.parquet(f"{path}/index")
    if windows is not None:
        index = index.where(windows)
    joined = index.join(spark.read.parquet(f"{path}/chunks"), [*keys, "chunk"])
    step = F.sequence(F.lit(0), F.lit(length - 1))
    sequence = F.transform(step, lambda i: F.slice("values", (F.col("offset") + i) * width + 1, F.lit(width)))
    return joined.select(*keys, ts, sequence.alias("sequence"), "label")
