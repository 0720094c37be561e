"""Order-dependent work on series of any length.

A window partitioned by station alone puts a whole station into one task.  The
helpers here cut each series into time buckets of bounded size, so one station
holding a third of all rows spreads over as many tasks as it has buckets:

* ``Halo``             windows with a bounded reach (lags, leads, rolling frames)
* ``bucket_offsets``   exclusive running totals over buckets
* ``with_running_sum`` / ``with_position``  running totals and row numbers
* ``rank_boundaries``  timestamps at given ranks, without numbering every row
* ``lookup_join``      salted join with a small per-key table
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stationcast.functions.names import ref

# Rows per bucket on a grid, 25 days of ten-minute steps.  With its halo a bucket stays
# under the 4,096 rows that a Spark window keeps in memory as plain rows.
BUCKET_STEPS = 3_600
BUCKET_SECONDS = 30 * 86_400
SALTS = 32
_CHUNK = 4_096  # buckets per chunk in the two-level running total

BUCKET = "_bucket"


def keys_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def time_bucket(ts: Column, seconds: int = BUCKET_SECONDS) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(float(seconds * 1_000_000)))


def grid_step(ts: Column, freq_seconds: int) -> Column:
    """Integer time step; consecutive along a regular grid of that frequency."""
    return F.floor(F.unix_micros(ts) / F.lit(float(freq_seconds * 1_000_000)))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` with a table of few rows per key.

    The table is repeated ``salts`` times and ``rows`` are salted by
    ``spread_on``, so a hot key is split even when the table is too large for
    Spark to broadcast; when it is small enough Spark broadcasts it by itself.
    """
    keys = list(keys)
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*[ref(c) for c in spread_on]), F.lit(salts)))
    salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted_rows.join(salted_table, [*keys, "_salt"], how).drop("_salt")


class Halo:
    """Windows with bounded reach over a regular grid, bucket by bucket.

    ``open`` copies each row into the buckets whose rows may look at it; any
    expression over ``spec`` that reaches at most ``lookback`` rows back and
    ``lookahead`` rows forward is then exact for the rows of the bucket itself,
    which ``close`` keeps.  Valid on a series with one row per step.
    """

    def __init__(
        self,
        keys: str | Sequence[str],
        step: Column,
        lookback: int = 0,
        lookahead: int = 0,
        bucket_steps: int | None = None,
    ):
        self.keys = keys_list(keys)
        self.step = step
        self.lookback = int(lookback)
        self.lookahead = int(lookahead)
        # Keep the copied share small: a bucket is at least eight reaches long.
        self.bucket_steps = int(bucket_steps or max(BUCKET_STEPS, 8 * (self.lookback + self.lookahead)))
        self.place = [*self.keys, BUCKET]
        self.spec: WindowSpec = Window.partitionBy(*self.place).orderBy("_step")

    def open(self, df: DataFrame) -> DataFrame:
        size = F.lit(float(self.bucket_steps))
        stepped = df.withColumn("_step", self.step)
        first = F.floor((F.col("_step") - self.lookahead) / size)
        last = F.floor((F.col("_step") + self.lookback) / size)
        spread = stepped.withColumn(BUCKET, F.explode(F.sequence(first, last)))
        # Named here so that a partitioning by station alone, left over from an
        # earlier join, is never taken as good enough for these windows.
        # The number is given: rows added for gaps compress to almost nothing, and Spark
        # would merge partitions by those bytes into tasks whose sorts spill.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return spread.repartition(parts, *[F.col(k) for k in self.keys], F.col(BUCKET))

    def close(self, df: DataFrame) -> DataFrame:
        home = F.floor(F.col("_step") / F.lit(float(self.bucket_steps)))
        return df.where(F.col(BUCKET) == home).drop(BUCKET, "_step")


def bucket_offsets(
    buckets: DataFrame,
    keys: Sequence[str],
    bucket: str,
    totals: Sequence[str],
) -> DataFrame:
    """Add ``<total>_before``: the sum over all earlier buckets of the same key.

    Input: one row per key and bucket.  Two levels (chunks, then buckets within
    a chunk) keep each window small however long the series is.
    """
    keys = list(keys)
    chunked = buckets.withColumn("_chunk", F.floor(F.col(bucket) / F.lit(float(_CHUNK))))
    chunk_spec = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        chunked.groupBy(*keys, "_chunk")
        .agg(*[F.sum(t).alias(f"_c_{t}") for t in totals])
        .select(*keys, "_chunk", *[F.coalesce(F.sum(f"_c_{t}").over(chunk_spec), F.lit(0)).alias(f"_b_{t}") for t in totals])
    )
    inner = Window.partitionBy(*keys, "_chunk").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.join(chunks, [*keys, "_chunk"])
        .select(
            "*",
            *[(F.col(f"_b_{t}") + F.coalesce(F.sum(t).over(inner), F.lit(0))).alias(f"{t}_before") for t in totals],
        )
        .drop("_chunk", *[f"_b_{t}" for t in totals])
    )


def with_running_sum(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    value: Column,
    name: str,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Inclusive running sum of an integer ``value`` along ``ts`` per key."""
    keys = keys_list(keys)
    spec = Window.partitionBy(*keys, BUCKET).orderBy(ts)
    local = df.withColumn(BUCKET, time_bucket(F.col(ts), bucket_seconds)).withColumn("_value", value.cast("bigint"))
    totals = local.groupBy(*keys, BUCKET).agg(F.sum("_value").alias("_total"))
    offsets = bucket_offsets(totals, keys, BUCKET, ["_total"]).drop("_total")
    running = local.repartition(*[F.col(k) for k in keys], F.col(BUCKET)).withColumn(
        "_running", F.sum("_value").over(spec.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        running.join(offsets, [*keys, BUCKET])
        .withColumn(name, F.col("_running") + F.col("_total_before"))
        .select(*[ref(c) for c in df.columns], name)
    )


def with_position(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    name: str = "position",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """1-based row number along ``ts`` per key (``ts`` unique within a key)."""
    return with_running_sum(df, keys, ts, F.lit(1), name, bucket_seconds)


def rank_boundaries(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    ranks: Mapping[str, Column],
    bucket_seconds: int = BUCKET_SECONDS,
    bucket_of: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Per key: row count ``n`` and the ``ts`` found at each wanted rank.

    ``ranks`` maps an output name to a 1-based rank written in terms of ``n``; a
    rank outside 1..n gives NULL.  Only bucket counts and the few buckets that
    hold a wanted rank are looked at, so the series itself is never shuffled or
    numbered: callers compare ``ts`` with the boundaries.  ``bucket_of`` replaces
    time buckets when ``ts`` is another orderable value.
    """
    keys = keys_list(keys)
    bucket = time_bucket(F.col("_ts"), bucket_seconds) if bucket_of is None else bucket_of(F.col("_ts"))
    narrow = df.select(*[F.col(k) for k in keys], F.col(ts).alias("_ts")).withColumn(BUCKET, bucket)
    counts = narrow.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    located = bucket_offsets(counts, keys, BUCKET, ["_n"])
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    wanted = sizes.select(
        *keys,
        "n",
        F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])).alias("_w"),
    )
    hits = (
        located.join(wanted, keys)
        .where((F.col("_w.rank") > F.col("_n_before")) & (F.col("_w.rank") <= F.col("_n_before") + F.col("_n")))
        .groupBy(*keys, BUCKET)
        .agg(F.collect_list(F.struct("_w.name", (F.col("_w.rank") - F.col("_n_before")).alias("rank"))).alias("_wanted"))
    )
    spec = Window.partitionBy(*keys, BUCKET).orderBy("_ts")
    found = (
        narrow.join(hits, [*keys, BUCKET])
        .select(*keys, "_ts", F.row_number().over(spec).alias("_rn"), "_wanted")
        .select(*keys, "_ts", "_rn", F.explode("_wanted").alias("_w"))
        .where(F.col("_w.rank") == F.col("_rn"))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("_w.name") == name, F.col("_ts"))).alias(name) for name in ranks])
    )
    return sizes.join(found, keys, "left")
