"""All registered queries with their SQL counterparts.

Each query runs over whole tables.  Doubles are rounded to six places and times
leave as zone-less timestamps, so both engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.functions import encoding, meteo, quality, timeparse, units
from stationcast.functions.names import target_column
from stationcast.operators import (
    baselines,
    compare,
    evaluate,
    experiment,
    features,
    grid,
    linear,
    model_store,
    prepare,
    runs,
    scaling,
    sequences,
    splits,
    trees,
    windows,
)
from stationcast.plans import fixtures as fx
from stationcast.plans.sql import CALENDAR, FEATURES, INTEGERS, SCORES, lags, query, rolled, rounded
from stationcast.session import new_path, stage
from stationcast.sources import run_store, station_csv, synthetic, tables

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

# Means of two-decimal values often lie half-way between two roundings, where the
# last bit decides.  Both sides are moved off the half by this much first.
NUDGE = 3.7e-9

VARIABLES = ("temp_c", "rh_pct", "wspd_ms", "gust_ms", "wdir_deg", "rain_mm")
LINE = "(PARTITION BY station_id ORDER BY ts_utc)"
METRIC_VALUES = ("mae", "rmse", "mape", "skill_score_persistence")
METRIC_KEYS = "station_id, target, horizon_label, horizon_steps, model, model_family, n_test"


def finish(df: DataFrame) -> DataFrame:
    def clean(name: str, kind: str):
        column = F.col(f"`{name}`")
        if kind == "double":
            return (F.round(column + F.lit(NUDGE), 6) + F.lit(0.0)).alias(name)
        if kind == "timestamp":
            return column.cast("timestamp_ntz").alias(name)
        return column

    return df.select(*[clean(c, t) for c, t in df.dtypes])


def register(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = lambda spark, sf_dir: finish(run(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def pick(exact: str, doubles: tuple[str, ...] | list[str], source: str) -> str:
    parts = [exact] if exact else []
    parts += [rounded(f'"{c}"') for c in doubles]
    return f"SELECT {', '.join(parts)} FROM {source}"


GRID = ("grid",)
GRID_COLUMNS = pick("station_id, ts_utc, gap", VARIABLES, "grid")


# --- sources and row-wise cleaning ------------------------------------------


@register(
    "clean_numeric",
    """SELECT event_id, CAST(round(value * 100) AS BIGINT) * 1e1 AS grouped, round(value + 3.7e-9, 6) + 0.0 AS plain,
    CAST(NULL AS DOUBLE) AS broken FROM events""",
)
def clean_numeric(spark, sf_dir):
    ev = fx.events(spark, sf_dir)
    return ev.select(
        "event_id",
        units.clean_numeric(F.format_number(F.col("value") * 1000.0, 1)).alias("grouped"),
        units.clean_numeric(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("plain"),
        units.clean_numeric(F.concat(F.col("value").cast("string"), F.lit(" n/a"))).alias("broken"),
    )


@register(
    "detect_delimiter",
    query(
        """SELECT doc_id, CASE WHEN greatest(c, s, t, p) = 0 OR c = greatest(c, s, t, p) THEN ','
        WHEN s = greatest(c, s, t, p) THEN ';' WHEN t = greatest(c, s, t, p) THEN chr(9) ELSE '|' END AS delimiter FROM (
        SELECT doc_id, length(head) - length(replace(head, ',', '')) AS c, length(head) - length(replace(head, ';', '')) AS s,
        length(head) - length(replace(head, chr(9), '')) AS t, length(head) - length(replace(head, '|', '')) AS p FROM (
        SELECT doc_id, coalesce(array_to_string(list_filter(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: length(trim(x)) > 0)[1:10], chr(10)), '') AS head
        FROM documents))""",
        (),
    ),
)
def detect_delimiter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", station_csv.detect_delimiter(F.col("text")).alias("delimiter"))


_UNITS = "list_transform(string_split(text[1:256], ''), lambda x: unicode(x))"


@register(
    "sniff_encoding",
    f"""SELECT doc_id, 'UTF-8' AS written_as, false AS utf16le FROM documents
    UNION ALL SELECT doc_id, 'UTF-16LE', length(text) >= 2
    AND len(list_filter({_UNITS}, lambda u: u < 256)) > greatest(4, 4 * len(list_filter({_UNITS}, lambda u: u % 256 = 0)))
    FROM documents""",
)
def sniff_encoding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forms = F.array(
        *[F.struct(F.lit(e).alias("written_as"), F.encode("text", e).alias("content")) for e in ("UTF-8", "UTF-16LE")]
    )
    return docs.select("doc_id", F.explode(forms).alias("_f")).select(
        "doc_id", "_f.written_as", station_csv.looks_utf16le(F.col("_f.content")).alias("utf16le")
    )


_READ_SQL = query(
    f"""SELECT event_type AS station_id, date_trunc('minute', ts) - INTERVAL 2 HOUR AS ts_utc,
    round(sum(CAST(round(value * 100) AS BIGINT)) / 1e2 + 3.7e-9, 6) + 0.0 AS temp_c, CAST(sum(k) AS DOUBLE) AS rh_pct,
    round(min(value) / 3.6e0 + 3.7e-9, 6) + 0.0 AS wspd_ms, round(max(value) / 3.6e0 + 3.7e-9, 6) + 0.0 AS gust_ms,
    CAST(count(*) AS DOUBLE) AS uv_index FROM ev GROUP BY ALL""",
    ("ev",),
)


def _read_back(spark, sf_dir, encoding_name):
    """Write raw exports into the shared folder, each row twice, and ingest them."""
    text = fx.raw_text(spark, sf_dir)
    path = new_path(spark, "raw")
    text.unionByName(text).write.partitionBy("station").option("header", True).option("sep", ";").option(
        "encoding", encoding_name
    ).csv(path)
    series = station_csv.read_station_csv(spark, path, fx.RAW_MAPPING, recursive=True)
    return series.withColumn("station_id", F.regexp_replace("station_id", "^station=", ""))


@register("read_station_csv", _READ_SQL)
def read_station_csv(spark, sf_dir):
    return _read_back(spark, sf_dir, "UTF-8")


@register("read_station_csv_utf16le", _READ_SQL)
def read_station_csv_utf16le(spark, sf_dir):
    return _read_back(spark, sf_dir, "UTF-16LE")


@register(
    "ingest_report",
    query(
        """SELECT event_type AS station_id, 2 * count(*) + count(*) FILTER (n = 1) AS rows_read, count(*) AS rows_kept,
    count(*) AS duplicate_rows, count(*) FILTER (n = 1) AS unreadable_time
    FROM (SELECT event_type, date_trunc('minute', ts) AS m, count(*) AS n FROM ev GROUP BY ALL) GROUP BY 1""",
        ("ev",),
    ),
)
def ingest_report(spark, sf_dir):
    """Exports that hold every row twice, and rows of one reading once more without a time."""
    text = fx.raw_text(spark, sf_dir)
    timeless = text.where(F.col("uvi") == "1").withColumn("Date (Europe/Athens)", F.lit("unknown"))
    path = new_path(spark, "raw")
    text.unionByName(text).unionByName(timeless).write.partitionBy("station").option("header", True).option("sep", ";").csv(path)
    rows = station_csv.station_rows(spark, path, fx.RAW_MAPPING, recursive=True, unreadable=True)
    counts = ("rows_read", "rows_kept", "duplicate_rows", "unreadable_time")
    station = F.regexp_replace("station_id", "^station=", "").alias("station_id")
    return station_csv.ingest_report(rows).groupBy(station).agg(*[F.sum(c).alias(c) for c in counts])


_MAP_SQL = """SELECT event_type AS station_id, date_trunc('minute', ts) AS minute,
    round(sum(CAST(round(value * 100) AS BIGINT)) / 1e2 + 3.7e-9, 6) + 0.0 AS temp_c, CAST(sum(k) AS DOUBLE) AS rh_pct,
    round(min(value){0} + 3.7e-9, 6) + 0.0 AS wspd_ms, round(max(value){0} + 3.7e-9, 6) + 0.0 AS gust_ms,
    CAST(count(*) AS DOUBLE) AS uv_index FROM ev GROUP BY ALL"""


def _mapped(spark, sf_dir):
    named = fx.raw_text(spark, sf_dir).withColumnRenamed("station", "station_id")
    return station_csv.map_schema(named, fx.RAW_MAPPING, keep=["station_id"])


def _minute(df):
    return df.withColumn("minute", timeparse.parse_wall_clock(F.col("_wall_clock"))).drop("_wall_clock")


@register("map_schema", query(_MAP_SQL.format(""), ("ev",)))
def map_schema(spark, sf_dir):
    return _minute(_mapped(spark, sf_dir))


@register("normalize_units", query(_MAP_SQL.format(" / 3.6e0"), ("ev",)))
def normalize_units(spark, sf_dir):
    return _minute(station_csv.normalize_units(_mapped(spark, sf_dir), fx.RAW_MAPPING))


@register(
    "parse_ts",
    """SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('minute', ts) AS iso_minute,
    date_trunc('second', ts) AS day_first, date_trunc('minute', ts) AS day_first_minute,
    CAST(NULL AS TIMESTAMP) AS junk FROM events""",
)
def parse_ts(spark, sf_dir):
    texts = {
        "iso": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "iso_minute": F.date_format("ts", "yyyy-MM-dd HH:mm"),
        "day_first": F.date_format("ts", "dd/MM/yyyy HH:mm:ss"),
        "day_first_minute": F.date_format("ts", "d/M/yyyy HH:mm"),
        "junk": F.concat(F.lit("on "), F.date_format("ts", "yyyy.MM.dd")),
    }
    return fx.events(spark, sf_dir).select(
        "event_id", *[timeparse.parse_wall_clock(t).alias(n) for n, t in texts.items()]
    )


@register(
    "local_to_utc",
    """SELECT event_id, moved_days, CASE
    WHEN local_ts < TIMESTAMP '2024-03-31 03:00:00' THEN local_ts - INTERVAL 2 HOUR
    WHEN local_ts < TIMESTAMP '2024-03-31 04:00:00' THEN TIMESTAMP '2024-03-31 01:00:00'
    WHEN local_ts < TIMESTAMP '2024-10-27 03:00:00' THEN local_ts - INTERVAL 3 HOUR
    ELSE local_ts - INTERVAL 2 HOUR END AS ts_utc
    FROM (SELECT event_id, 75 AS moved_days, ts + INTERVAL 75 DAY AS local_ts FROM events
    UNION ALL SELECT event_id, 285, ts + INTERVAL 285 DAY FROM events)""",
)
def local_to_utc(spark, sf_dir):
    """Event times moved onto the spring and the autumn change of the clocks."""
    days = F.explode(F.array(F.lit(75), F.lit(285))).alias("moved_days")
    moved = fx.events(spark, sf_dir).select("event_id", "ts", days)
    local = F.timestamp_micros(F.unix_micros("ts") + F.col("moved_days").cast("bigint") * 86_400_000_000)
    return moved.select("event_id", "moved_days", timeparse.local_to_utc(local, fx.ZONE).alias("ts_utc"))


def _copies(spark, sf_dir):
    ev = fx.events(spark, sf_dir)
    return ev.select(
        F.col("event_type").alias("station_id"),
        F.date_trunc("hour", "ts").alias("ts_utc"),
        F.concat(F.lit("file_"), F.pmod("user_id", F.lit(7)).cast("string")).alias("_file"),
        F.lit(0).alias("_block"),
        F.col("event_id").alias("_line"),
        "value",
        "user_id",
    )


@register(
    "dedup_keep_first",
    """SELECT event_type AS station_id, date_trunc('hour', ts) AS ts_utc, value, user_id FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY user_id % 7, event_id) = 1""",
)
def dedup_keep_first(spark, sf_dir):
    return station_csv.keep_first(_copies(spark, sf_dir))


@register(
    "dedup_report",
    """SELECT station_id, CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
    count(*) FILTER (n > 1) AS duplicate_timestamp_count, 'keep_first' AS duplicate_policy, any_value(f) AS files_read
    FROM (SELECT event_type AS station_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL)
    JOIN (SELECT event_type AS station_id, count(DISTINCT user_id % 7) AS f FROM events GROUP BY ALL) USING (station_id)
    GROUP BY station_id""",
)
def dedup_report(spark, sf_dir):
    return station_csv.dedup_report(_copies(spark, sf_dir))


@register("roundtrip_parquet", query(pick("station_id, ts_utc", VARIABLES, "obs"), ("obs",)))
def roundtrip_parquet(spark, sf_dir):
    path = new_path(spark, "series")
    tables.write_series(fx.station_obs(spark, sf_dir), path)
    return tables.read_series(spark, path)


@register(
    "synthetic_station",
    query(
        """SELECT station_id, ts_utc, round(12 + sin(i / 12e0) + 3.7e-9, 6) + 0.0 AS temp_c, round(70 + cos(i / 18e0) + 3.7e-9, 6) + 0.0 AS rh_pct,
        round(1015 + sin(i / 40e0) + 3.7e-9, 6) + 0.0 AS pres_hpa, round(3.6e0 + abs(sin(i / 7e0)) + 3.7e-9, 6) + 0.0 AS wspd_kmh,
        round(7.2e0 + abs(sin(i / 5e0)) + 3.7e-9, 6) + 0.0 AS gust_kmh, CAST(i * 15 % 360 AS DOUBLE) AS wdir_deg,
        0e0 AS rain_mm, 0e0 AS rain_rate_mmh, 0e0 AS solar_wm2, 0e0 AS uv_index
        FROM (SELECT *, date_diff('hour', TIMESTAMP '2024-01-01', ts_utc) AS i FROM axis)""",
        ("axis",),
    ),
)
def synthetic_station(spark, sf_dir):
    """Synthetic values on the time axes of the stations."""
    axis = grid.time_axis(fx.station_obs(spark, sf_dir), fx.HOUR)
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    i = F.floor((F.unix_seconds("ts_utc") - start) / F.lit(float(fx.HOUR)))
    return axis.select("station_id", "ts_utc", *[v.alias(c) for c, v in synthetic.synthetic_values(i).items()])


# --- grid and preparation ---------------------------------------------------


@register("insert_gaps", query(GRID_COLUMNS, GRID))
def insert_gaps(spark, sf_dir):
    return fx.station_grid(spark, sf_dir)


@register(
    "insert_gaps_off_axis",
    """WITH o AS (SELECT event_type AS station_id, count(*) AS n,
    date_trunc('hour', ts) + CASE WHEN count(*) % 7 = 0 THEN INTERVAL 3 MINUTE ELSE INTERVAL 0 MINUTE END AS ts_utc
    FROM events GROUP BY event_type, date_trunc('hour', ts)),
    phases AS (SELECT station_id, epoch_us(ts_utc) % 3600000000 AS phase, count(*) AS c, min(ts_utc) AS lo, max(ts_utc) AS hi FROM o GROUP BY 1, 2),
    best AS (SELECT * FROM phases QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY c DESC, lo) = 1),
    axis AS (SELECT station_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts_utc FROM best)
    SELECT a.station_id, a.ts_utc, CAST(o.n AS DOUBLE) AS n, o.n IS NULL AS gap, false AS off_axis
    FROM axis a LEFT JOIN o ON o.station_id = a.station_id AND o.ts_utc = a.ts_utc
    UNION ALL SELECT o.station_id, o.ts_utc, o.n, false, true FROM o JOIN best b ON o.station_id = b.station_id
    WHERE epoch_us(o.ts_utc) % 3600000000 <> b.phase""",
)
def insert_gaps_off_axis(spark, sf_dir):
    """Hourly counts; those of a multiple of seven stand three minutes late."""
    hour, n = F.date_trunc("hour", "ts").alias("hour"), F.count(F.lit(1)).cast("double").alias("n")
    counts = fx.events(spark, sf_dir).groupBy(F.col("event_type").alias("station_id"), hour).agg(n)
    late = F.when(F.col("n") % 7 == 0, 180_000_000).otherwise(0)
    rows = counts.select("station_id", F.timestamp_micros(F.unix_micros("hour") + late).alias("ts_utc"), "n")
    return grid.insert_gaps(rows, fx.HOUR, keep_off_axis=True)


@register(
    "off_grid_report",
    """SELECT event_type AS station_id, count(*) AS rows,
    count(*) FILTER (epoch_us(ts) % 3600000000 <> first_phase) AS off_grid_rows
    FROM events JOIN (SELECT event_type, epoch_us(min(ts)) % 3600000000 AS first_phase FROM events GROUP BY 1) USING (event_type)
    GROUP BY ALL""",
)
def off_grid_report(spark, sf_dir):
    rows = fx.events(spark, sf_dir).select(F.col("event_type").alias("station_id"), F.col("ts").alias("ts_utc"))
    return grid.off_grid_report(rows, fx.HOUR)


@register(
    "resample",
    query(
        """SELECT station_id, ts_utc, round(temp_c + 3.7e-9, 6) + 0.0 AS temp_c, round(rh_pct + 3.7e-9, 6) + 0.0 AS rh_pct,
        round(wspd_ms + 3.7e-9, 6) + 0.0 AS wspd_ms, round(gust_ms + 3.7e-9, 6) + 0.0 AS gust_ms, round(rain_mm + 3.7e-9, 6) + 0.0 AS rain_mm,
        round(CASE WHEN sqrt(e * e + n * n) >= 1e-9 THEN CASE WHEN degrees(atan2(e, n)) < 0 THEN degrees(atan2(e, n)) + 360
        ELSE degrees(atan2(e, n)) END END + 3.7e-9, 6) + 0.0 AS wdir_deg, gap FROM (
        SELECT station_id, time_bucket(INTERVAL 6 HOUR, ts_utc, TIMESTAMP '1970-01-01') AS ts_utc, avg(temp_c) AS temp_c,
        avg(rh_pct) AS rh_pct, avg(wspd_ms) AS wspd_ms, max(gust_ms) AS gust_ms, sum(rain_mm) AS rain_mm,
        avg(sin(radians(wdir_deg))) AS e, avg(cos(radians(wdir_deg))) AS n, bool_and(gap) AS gap
        FROM grid GROUP BY 1, 2)""",
        GRID,
    ),
)
def resample(spark, sf_dir):
    return grid.resample(fx.station_grid(spark, sf_dir), 6 * fx.HOUR)


BOUNDS = {c: quality.RANGE_BOUNDS[c] for c in VARIABLES}


@register(
    "qc_range",
    query(
        "SELECT station_id, ts_utc, "
        + ", ".join(f"coalesce({c} < {lo} OR {c} > {hi}, false) AS qc_range_{c}" for c, (lo, hi) in BOUNDS.items())
        + " FROM grid",
        GRID,
    ),
)
def qc_range(spark, sf_dir):
    flags = quality.range_flags(list(VARIABLES))
    return fx.station_grid(spark, sf_dir).select("station_id", "ts_utc", *[f.alias(n) for n, f in flags.items()])


def _spike_sql(c: str) -> str:
    over = "(PARTITION BY station_id ORDER BY ts_utc ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    sd = f"stddev_samp({c}) OVER {over}"
    return (
        f"coalesce(count({c}) OVER {over} >= 6 AND {sd} > 0 AND abs({c} - avg({c}) OVER {over}) > 4 * {sd}, false)"
        f" AS qc_spike_{c}"
    )


SPIKED = ("temp_c", "rh_pct", "gust_ms")


@register("qc_spike", query(f"SELECT station_id, ts_utc, {', '.join(map(_spike_sql, SPIKED))} FROM grid", GRID))
def qc_spike(spark, sf_dir):
    out = windows.qc_spike(fx.station_grid(spark, sf_dir), SPIKED, fx.HOUR)
    return out.select("station_id", "ts_utc", *[f"qc_spike_{c}" for c in SPIKED])


def _flat_sql(c: str, rows: int, zero_rests: bool) -> str:
    over = f"(PARTITION BY station_id ORDER BY ts_utc ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    extra = f" AND max({c}) OVER {over} > 0" if zero_rests else ""
    return (
        f"coalesce(count({c}) OVER {over} = {rows} AND max({c}) OVER {over} - min({c}) OVER {over} <= 0{extra}, false)"
        f" AS qc_flatline_{c}"
    )


@register(
    "qc_flatline",
    query(f"SELECT station_id, ts_utc, {_flat_sql('rain_mm', 2, True)}, {_flat_sql('rh_pct', 2, False)} FROM grid", GRID),
)
def qc_flatline(spark, sf_dir):
    out = windows.qc_flatline(fx.station_grid(spark, sf_dir), ["rain_mm", "rh_pct"], fx.HOUR, rows=2)
    return out.select("station_id", "ts_utc", "qc_flatline_rain_mm", "qc_flatline_rh_pct")


_G = "(CASE WHEN rh_pct > 0 THEN ln(rh_pct / 100) END + 17.62e0 * temp_c / (243.12e0 + temp_c))"
DEW_SQL = f"243.12e0 * {_G} / (17.62e0 - {_G})"
VPD_SQL = "0.6108e0 * exp(17.27e0 * temp_c / (temp_c + 237.3e0)) * (1 - rh_pct / 100)"
_F = "(temp_c * 1.8e0 + 32)"
_SIMPLE = f"(0.5e0 * ({_F} + 61.0e0 + ({_F} - 68.0e0) * 1.2e0 + rh_pct * 0.094e0))"
_FULL = f"""(-42.379e0 + 2.04901523e0 * {_F} + 10.14333127e0 * rh_pct - 0.22475541e0 * {_F} * rh_pct
    - 0.00683783e0 * {_F} * {_F} - 0.05481717e0 * rh_pct * rh_pct + 0.00122874e0 * {_F} * {_F} * rh_pct
    + 0.00085282e0 * {_F} * rh_pct * rh_pct - 0.00000199e0 * {_F} * {_F} * rh_pct * rh_pct)"""
HEAT_SQL = f"""((CASE WHEN temp_c IS NULL OR rh_pct IS NULL THEN NULL WHEN ({_SIMPLE} + {_F}) / 2 < 80 THEN {_SIMPLE} ELSE {_FULL}
    - CASE WHEN rh_pct < 13 AND {_F} BETWEEN 80 AND 112 THEN (13 - rh_pct) / 4 * sqrt((17 - abs({_F} - 95)) / 17) ELSE 0 END
    + CASE WHEN rh_pct > 85 AND {_F} BETWEEN 80 AND 87 THEN (rh_pct - 85) / 10 * (87 - {_F}) / 5 ELSE 0 END END) - 32) / 1.8e0"""
_P = "pow(wspd_ms * 3.6e0, 0.16e0)"
CHILL_SQL = f"""CASE WHEN temp_c <= 10 AND wspd_ms * 3.6e0 > 4.8e0
    THEN 13.12e0 + 0.6215e0 * temp_c - 11.37e0 * {_P} + 0.3965e0 * temp_c * {_P} WHEN wspd_ms IS NOT NULL THEN temp_c END"""


def _derived(name: str, sql: str):
    column = meteo.DERIVED[name][0]
    text = query(f"SELECT station_id, ts_utc, round({sql} + 3.7e-9, 6) + 0.0 AS {column} FROM grid", GRID)

    @register(f"derive_{name}", text)
    def run(spark, sf_dir):
        expr = meteo.derived_columns(list(VARIABLES), [name])
        return fx.station_grid(spark, sf_dir).select("station_id", "ts_utc", *[e.alias(c) for c, e in expr.items()])


for _name, _sql in (("dew_point", DEW_SQL), ("vpd", VPD_SQL), ("heat_index", HEAT_SQL), ("wind_chill", CHILL_SQL)):
    _derived(_name, _sql)

CONSISTENT_SQL = f"(coalesce(gust_ms < wspd_ms, false) OR coalesce({DEW_SQL} > temp_c + 0.1e0, false))"


@register("qc_consistency", query(f"SELECT station_id, ts_utc, {CONSISTENT_SQL} AS qc_consistency FROM grid", GRID))
def qc_consistency(spark, sf_dir):
    rows = fx.station_grid(spark, sf_dir).withColumns(meteo.derived_columns(list(VARIABLES), ["dew_point"]))
    return rows.select("station_id", "ts_utc", quality.consistency_flag(rows.columns).alias("qc_consistency"))


_RANGE_ANY = " OR ".join(f"coalesce({c} < {lo} OR {c} > {hi}, false)" for c, (lo, hi) in BOUNDS.items())

# Every fourth hour lies above the range; every fifth has less gust than wind.
_OVER = {c: f"CASE WHEN hour(ts_utc) % 4 = 0 THEN {hi} + 1e0 ELSE {c} END" for c, (_, hi) in BOUNDS.items()}
_MARKED = ", ".join(f"{s} AS {c}" for c, s in _OVER.items() if c != "gust_ms")


@register(
    "qc_mixed",
    query(
        f""", marked AS (SELECT station_id, ts_utc, {_MARKED},
    CASE WHEN hour(ts_utc) % 5 = 0 THEN wspd_ms - 0.5e0 ELSE {_OVER["gust_ms"]} END AS gust_ms FROM grid)
    SELECT station_id, ts_utc, """
        + ", ".join(f"coalesce({c} < {lo} OR {c} > {hi}, false) AS qc_range_{c}" for c, (lo, hi) in BOUNDS.items())
        + f", {CONSISTENT_SQL} AS qc_consistency, ({_RANGE_ANY} OR {CONSISTENT_SQL}) AS qc_any FROM marked",
        GRID,
    ).replace("\n, marked", ", marked"),
)
def qc_mixed(spark, sf_dir):
    """Flags on values of which some are out of range or contradict each other, and some are not."""
    hour = F.hour("ts_utc")
    rows = fx.station_grid(spark, sf_dir)
    over = {c: F.when(hour % 4 == 0, F.lit(hi + 1.0)).otherwise(F.col(c)) for c, (_, hi) in BOUNDS.items()}
    over["gust_ms"] = F.when(hour % 5 == 0, F.col("wspd_ms") - 0.5).otherwise(over["gust_ms"])
    marked = rows.withColumns(over).withColumns(quality.range_flags(list(VARIABLES)))
    marked = marked.withColumns(meteo.derived_columns(list(VARIABLES), ["dew_point"]))
    marked = marked.withColumn("qc_consistency", quality.consistency_flag(marked.columns))
    flags = [c for c in marked.columns if c.startswith("qc_")]
    return marked.select("station_id", "ts_utc", *flags, quality.any_of([F.col(c) for c in flags]).alias("qc_any"))



@register(
    "qc_any",
    query(f"SELECT station_id, ts_utc, {_RANGE_ANY} OR {CONSISTENT_SQL} AS qc_any FROM grid", GRID),
)
def qc_any(spark, sf_dir):
    rows = fx.station_grid(spark, sf_dir).withColumns(meteo.derived_columns(list(VARIABLES), ["dew_point"]))
    flags = [*quality.range_flags(list(VARIABLES)).values(), quality.consistency_flag(rows.columns)]
    return rows.select("station_id", "ts_utc", quality.any_of(flags).alias("qc_any"))


CYCLIC = ("hour_sin", "hour_cos", "doy_sin", "doy_cos")


@register(
    "calendar_features",
    query(pick("station_id, ts_utc, hour, weekday, month, doy", CYCLIC, f"(SELECT station_id, ts_utc, {CALENDAR} FROM grid)"), GRID),
)
def calendar_features(spark, sf_dir):
    parts = encoding.calendar_columns(F.col("ts_utc"))
    return fx.station_grid(spark, sf_dir).select("station_id", "ts_utc", *[v.alias(c) for c, v in parts.items()])


@register(
    "wind_encoding",
    query(
        """SELECT station_id, ts_utc, wdir_deg, round(sin(radians(wdir_deg)) + 3.7e-9, 6) + 0.0 AS wdir_sin,
        round(cos(radians(wdir_deg)) + 3.7e-9, 6) + 0.0 AS wdir_cos FROM grid""",
        GRID,
    ),
)
def wind_encoding(spark, sf_dir):
    parts = encoding.wind_direction_columns(F.col("wdir_deg"))
    return fx.station_grid(spark, sf_dir).select("station_id", "ts_utc", "wdir_deg", *[v.alias(c) for c, v in parts.items()])


# --- windows ----------------------------------------------------------------

_LAGGED = [f"{c}_lag{n}" for n in (1, 3, 6) for c in ("temp_c", "rh_pct")]


@register(
    "lag_features",
    query(
        pick("station_id, ts_utc", ["temp_c", *_LAGGED], f"(SELECT station_id, ts_utc, temp_c, {lags('temp_c')}, {lags('rh_pct')} FROM grid)"),
        GRID,
    ),
)
def lag_features(spark, sf_dir):
    out = windows.lag_features(fx.station_grid(spark, sf_dir), ["temp_c", "rh_pct"], fx.LAGS, fx.HOUR)
    return out.select("station_id", "ts_utc", "temp_c", *_LAGGED)


@register(
    "horizon_target",
    query(
        f"""SELECT station_id, ts_utc, round(temp_c + 3.7e-9, 6) + 0.0 AS temp_c, round(lead(temp_c, 1) OVER {LINE} + 3.7e-9, 6) + 0.0 AS "temp_c_t+1",
        round(lead(temp_c, 6) OVER {LINE} + 3.7e-9, 6) + 0.0 AS "temp_c_t+6" FROM grid""",
        GRID,
    ),
)
def horizon_target(spark, sf_dir):
    out = windows.horizon_targets(fx.station_grid(spark, sf_dir), "temp_c", [1, 6], fx.HOUR)
    return out.select("station_id", "ts_utc", "temp_c", "`temp_c_t+1`", "`temp_c_t+6`")


ROLLED = ("temp_c", "rain_mm")
ROLL_WINDOWS = (3, 6, 24)
_ROLL_NAMES = [f"{c}_roll{w}_{s}" for c in ROLLED for w in ROLL_WINDOWS for s in windows.STATS]


@register(
    "rolling_features",
    query(
        pick(
            "station_id, ts_utc",
            _ROLL_NAMES,
            "(SELECT station_id, ts_utc, " + ", ".join(rolled(c, w) for c in ROLLED for w in ROLL_WINDOWS) + " FROM grid)",
        ),
        GRID,
    ),
)
def rolling_features(spark, sf_dir):
    out = windows.rolling_features(fx.station_grid(spark, sf_dir), ROLLED, ROLL_WINDOWS, fx.HOUR)
    return out.select("station_id", "ts_utc", *_ROLL_NAMES)


def _any_window(c: str, w: int) -> str:
    over = f"(PARTITION BY station_id ORDER BY ts_utc ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return (
        f"round(avg({c}) OVER {over} + 3.7e-9, 6) + 0.0 AS {c}_roll{w}_mean, "
        f"round(stddev_samp({c}) OVER {over} + 3.7e-9, 6) + 0.0 AS {c}_roll{w}_std"
    )


@register(
    "rolling_partial_windows",
    query("SELECT station_id, ts_utc, " + ", ".join(_any_window("temp_c", w) for w in (4, 12)) + " FROM grid", GRID),
)
def rolling_partial_windows(spark, sf_dir):
    """Statistics of whatever values the window holds."""
    out = windows.rolling_features(
        fx.station_grid(spark, sf_dir), ["temp_c"], [4, 12], fx.HOUR, stats=("mean", "std"), min_periods=1
    )
    return out.select("station_id", "ts_utc", *[f"temp_c_roll{w}_{s}" for w in (4, 12) for s in ("mean", "std")])


_PREPARED_FLAGS = [f"qc_{k}_{c}" for k in ("range", "spike", "flatline") for c in VARIABLES]
_PREPARED_DOUBLES = [
    *VARIABLES, "dew_point_c", "vpd_kpa", "heat_index_c", "wind_chill_c", *CYCLIC, "wdir_sin", "wdir_cos",
    *[f"{c}_roll6_{s}" for c in ("temp_c", "rh_pct", "wspd_ms", "gust_ms", "rain_mm", "wdir_sin", "wdir_cos") for s in windows.STATS],
]
_PREPARED_SQL = query(
    pick(
        "station_id, ts_utc, gap, hour, weekday, month, doy, qc_consistency, qc_any, " + ", ".join(_PREPARED_FLAGS),
        _PREPARED_DOUBLES,
        f"""(SELECT *, {' OR '.join(_PREPARED_FLAGS)} OR qc_consistency AS qc_any, {', '.join(rolled(c, 6) for c in
            ('temp_c', 'rh_pct', 'wspd_ms', 'gust_ms', 'rain_mm', 'wdir_sin', 'wdir_cos'))} FROM (
            SELECT *, {CALENDAR}, sin(radians(wdir_deg)) AS wdir_sin, cos(radians(wdir_deg)) AS wdir_cos,
            {DEW_SQL} AS dew_point_c, {VPD_SQL} AS vpd_kpa, {HEAT_SQL} AS heat_index_c, {CHILL_SQL} AS wind_chill_c,
            {CONSISTENT_SQL} AS qc_consistency,
            {', '.join(f"coalesce({c} < {lo} OR {c} > {hi}, false) AS qc_range_{c}" for c, (lo, hi) in BOUNDS.items())},
            {', '.join(map(_spike_sql, VARIABLES))},
            {', '.join(_flat_sql(c, 18, c in quality.RESTING_AT_ZERO) for c in VARIABLES)} FROM grid))""",
    ),
    GRID,
)


@register("prepared_series", _PREPARED_SQL)
def prepared_series(spark, sf_dir):
    """Everything of the preparation stage in its fixed order."""
    return prepare.prepare_series(fx.station_obs(spark, sf_dir), fx.HOUR, [6]).drop("off_axis")


# --- supervised tables ------------------------------------------------------

_SUP_DOUBLES = [c for c in FEATURES if c not in INTEGERS]


def _supervised_sql(h: int, exact: str, doubles: list[str], source: str | None = None) -> str:
    source = source or f"sup{h}"
    return query(
        pick(exact, doubles, f'(SELECT *, y{h} AS "temp_c_t+{h}" FROM {source})'), (source,)
    )


for _h in (1, 6):

    @register(
        f"supervised_h{_h}",
        _supervised_sql(_h, f"station_id, ts_utc, gap, {', '.join(INTEGERS)}", [*_SUP_DOUBLES, f"temp_c_t+{_h}"]),
    )
    def _supervised(spark, sf_dir, h=_h):
        return fx.supervised(spark, sf_dir, h)


@register("select_features", _supervised_sql(1, f"station_id, ts_utc, {', '.join(INTEGERS)}", _SUP_DOUBLES))
def select_features(spark, sf_dir):
    rows = fx.supervised(spark, sf_dir, 1)
    return rows.select("station_id", "ts_utc", *features.select_feature_columns(rows, target_column("temp_c", 1)))


@register(
    "select_seq_features",
    _supervised_sql(1, f"station_id, ts_utc, {', '.join(INTEGERS)}", [c for c in _SUP_DOUBLES if "_lag" not in c]),
)
def select_seq_features(spark, sf_dir):
    rows = fx.supervised(spark, sf_dir, 1)
    return rows.select("station_id", "ts_utc", *features.select_sequence_columns(rows, target_column("temp_c", 1)))


_MATRIX = ("temp_c", "rh_pct", "temp_c_lag1")


@register(
    "feature_matrix",
    query(
        "SELECT station_id, ts_utc, round(temp_c + 3.7e-9, 6) + 0.0 AS f0, round(rh_pct + 3.7e-9, 6) + 0.0 AS f1, round(temp_c_lag1 + 3.7e-9, 6) + 0.0 AS f2, round(y1 + 3.7e-9, 6) + 0.0 AS label FROM sup1",
        ("sup1",),
    ),
)
def feature_matrix(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = features.feature_matrix(
        fx.supervised(spark, sf_dir, 1), _MATRIX, target_column("temp_c", 1), keep=["station_id", "ts_utc"]
    )
    parts = rows.withColumn("_a", vector_to_array("features"))
    return parts.select("station_id", "ts_utc", *[F.col("_a")[i].alias(f"f{i}") for i in range(3)], "label")


@register("chrono_split", query("SELECT station_id, ts_utc, split FROM split1", ("split1",)))
def chrono_split(spark, sf_dir):
    return fx.split_rows(spark, sf_dir, 1).select("station_id", "ts_utc", "split")


def _folds_sql(source: str, extra: str = "") -> str:
    return f"""SELECT station_id, ts_utc{extra},
        CASE WHEN n > k THEN CAST((CASE WHEN rn <= n - k * size THEN 0 ELSE (rn - (n - k * size) - 1) // size + 1 END) AS INTEGER)
        ELSE 0 END AS fold_block, CASE WHEN n > k THEN CAST(k AS INTEGER) END AS n_folds FROM (
        SELECT *, n // (k + 1) AS size FROM (SELECT *, least(5, greatest(2, n - 1)) AS k FROM (
        SELECT station_id, ts_utc{extra}, row_number() OVER {LINE} AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM {source})))"""


@register("ts_folds", query(_folds_sql("sup1"), ("sup1",)))
def ts_folds(spark, sf_dir):
    rows = splits.time_series_folds(fx.supervised(spark, sf_dir, 1))
    return rows.select("station_id", "ts_utc", "fold_block", "n_folds")


_META = """station_id, horizon_label, target_column, train_start, train_end, validation_start, validation_end, test_start, test_end,
    n_train, n_validation, n_test"""


@register("split_metadata", query(f"SELECT {_META}, 'temp_c' AS features FROM meta_base1", ("meta_base1",)))
def split_metadata(spark, sf_dir):
    rows = fx.metadata(spark, sf_dir, "h01", 1)
    return rows.withColumn("features", F.array_join("feature_columns", ",")).drop("feature_columns")


@register("split_metadata_roundtrip", query(f"SELECT {_META} FROM meta_base6", ("meta_base6",)))
def split_metadata_roundtrip(spark, sf_dir):
    path = new_path(spark, "split-metadata")
    rows = fx.metadata(spark, sf_dir, "h06", 6)
    tables.write_split_metadata(rows, path)
    return spark.read.schema(rows.schema).json(path).drop("feature_columns")


# --- scalers ----------------------------------------------------------------

SCALED = ("temp_c", "rh_pct", "rain_mm")
_NONE = "CAST(NULL AS DOUBLE)"


def _one(width: str) -> str:
    return f"CASE WHEN {width} = 0 THEN 1e0 ELSE {width} END"


def _parameters(method: str, c: str) -> str:
    value = {
        "standard": (f"avg({c})", _one(f"stddev_pop({c})"), _NONE, _NONE, _NONE),
        "minmax": (_NONE, _one(f"(max({c}) - min({c}))"), f"min({c})", _NONE, _NONE),
        "robust": (
            _NONE, _NONE, _NONE, f"median({c})", _one(f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
        ),
    }[method]
    return ", ".join(f"{v} AS {n}" for v, n in zip(value, scaling.PARAMETERS, strict=True))


def _params_sql(method: str, columns=SCALED, source: str = "split1", names=None) -> str:
    names = names or columns
    return " UNION ALL ".join(
        f"""SELECT station_id, '{n}' AS "column", '{method}' AS "method", {_parameters(method, c)}
        FROM {source} WHERE split = 'train' GROUP BY 1"""
        for c, n in zip(columns, names, strict=True)
    )


_CENTRE = {"standard": ("mean", "scale"), "minmax": ("min", "scale"), "robust": ("median", "iqr")}

for _method in scaling.METHODS:

    @register(
        f"fit_scaler_{_method}",
        query(pick('station_id, "column", "method"', scaling.PARAMETERS, f"({_params_sql(_method)})"), ("split1",)),
    )
    def _fit(spark, sf_dir, method=_method):
        return scaling.fit_scaler(fx.split_rows(spark, sf_dir, 1), SCALED, method)

    @register(
        f"scale_{_method}",
        query(
            "SELECT s.station_id, ts_utc, split, "
            + ", ".join(
                f'round((s.{c} - p{i}."{_CENTRE[_method][0]}") / p{i}."{_CENTRE[_method][1]}" + 3.7e-9, 6) + 0.0 AS {c}'
                for i, c in enumerate(SCALED)
            )
            + " FROM split1 s"
            + "".join(
                f" JOIN ({_params_sql(_method, (c,))}) p{i} ON p{i}.station_id = s.station_id" for i, c in enumerate(SCALED)
            ),
            ("split1",),
        ),
    )
    def _scale(spark, sf_dir, method=_method):
        rows = fx.split_rows(spark, sf_dir, 1)
        params = scaling.fit_scaler(rows, SCALED, method)
        return scaling.apply_scaler(rows, params, SCALED).select("station_id", "ts_utc", "split", *SCALED)

    @register(f"inverse_scale_{_method}", query(pick("station_id, ts_utc", ("temp_c",), "split1"), ("split1",)))
    def _inverse(spark, sf_dir, method=_method):
        rows = fx.split_rows(spark, sf_dir, 1)
        params = scaling.fit_scaler(rows, ["temp_c"], method)
        scaled = scaling.apply_scaler(rows, params, ["temp_c"])
        return scaling.inverse_scale(scaled, params, "temp_c").select("station_id", "ts_utc", "temp_c")


@register(
    "scale_target",
    query(
        pick('station_id, "column", "method"', scaling.PARAMETERS, f"({_params_sql('standard', ('y1',), names=('temp_c_t+1',))})"),
        ("split1",),
    ),
)
def scale_target(spark, sf_dir):
    return scaling.fit_target_scaler(fx.split_rows(spark, sf_dir, 1), target_column("temp_c", 1))


# --- sequences --------------------------------------------------------------

_SEQ = 3


_SEQUENCE_SQL = query(
        f"""SELECT station_id, ts_utc, split, """
        + ", ".join(
            f"round(lag({c}, {_SEQ - 1 - i}) OVER w + 3.7e-9, 6) + 0.0 AS s{i}_{c}" for i in range(_SEQ) for c in ("temp_c", "rh_pct")
        )
        + """, round(y1 + 3.7e-9, 6) + 0.0 AS label FROM split1
        WINDOW w AS (PARTITION BY station_id, split ORDER BY ts_utc)
        QUALIFY row_number() OVER w >= """
        + str(_SEQ),
        ("split1",),
    )


@register("sequence_windows", _SEQUENCE_SQL)
def sequence_windows(spark, sf_dir):
    rows = sequences.sequence_windows(fx.split_rows(spark, sf_dir, 1), ["temp_c", "rh_pct"], target_column("temp_c", 1), _SEQ)
    steps = [F.col("sequence")[i][j].alias(f"s{i}_{c}") for i in range(_SEQ) for j, c in enumerate(("temp_c", "rh_pct"))]
    return rows.select("station_id", "ts_utc", "split", *steps, "label")


@register("sequence_store", _SEQUENCE_SQL)
def sequence_store(spark, sf_dir):
    """The same windows, cut from a store that holds every row about once."""
    path = new_path(spark, "sequence-store")
    names = ["temp_c", "rh_pct"]
    sequences.write_sequence_store(fx.split_rows(spark, sf_dir, 1), names, target_column("temp_c", 1), _SEQ, path, chunk_rows=64)
    rows = sequences.read_sequence_store(spark, path)
    steps = [F.col("sequence")[i][j].alias(f"s{i}_{c}") for i in range(_SEQ) for j, c in enumerate(names)]
    return rows.select("station_id", "ts_utc", "split", *steps, "label")


@register(
    "sequence_targets",
    query(
        """SELECT station_id, ts_utc, split, round(y1 + 3.7e-9, 6) + 0.0 AS label FROM split1
        QUALIFY row_number() OVER (PARTITION BY station_id, split ORDER BY ts_utc) >= 12""",
        ("split1",),
    ),
)
def sequence_targets(spark, sf_dir):
    return sequences.sequence_targets(fx.split_rows(spark, sf_dir, 1), target_column("temp_c", 1), 12)


# --- baselines --------------------------------------------------------------

_PREDICTED = "station_id, horizon_label, horizon_steps, model, model_family, ts_utc"


def _baseline(name: str):
    @register(
        f"baseline_{name}",
        query(
            f"SELECT {_PREDICTED}, {rounded('y_true')}, {rounded('y_pred')} FROM base_predictions WHERE model = '{name}'",
            ("base_predictions",),
        ),
    )
    def run(spark, sf_dir):
        options = experiment.ExperimentOptions(
            target="temp_c", freq_seconds=fx.HOUR, horizons=fx.HORIZONS, optional_horizons={}, lags=fx.LAGS,
            baselines=(name,), on_empty="keep",
        )
        return fx.baseline_rows(spark, sf_dir, options).drop("target")


for _name in ("persistence", "moving_average"):
    _baseline(_name)
_baseline("climatology")


@register(
    "baseline_lag_average",
    query(
        f"SELECT station_id, ts_utc, round((coalesce(temp_c_lag1, 0) + coalesce(temp_c_lag3, 0) + coalesce(temp_c_lag6, 0)) / "
        f"nullif(CAST(temp_c_lag1 IS NOT NULL AS INTEGER) + CAST(temp_c_lag3 IS NOT NULL AS INTEGER) + CAST(temp_c_lag6 IS NOT NULL AS INTEGER), 0) + 3.7e-9, 6) + 0.0 AS y_pred "
        f"FROM (SELECT station_id, ts_utc, {lags('temp_c')} FROM grid)",
        GRID,
    ),
)
def baseline_lag_average(spark, sf_dir):
    """Moving average without a rolling column: the mean of the nearest lags known."""
    rows = windows.lag_features(fx.station_grid(spark, sf_dir), ["temp_c"], fx.LAGS, fx.HOUR)
    return rows.select("station_id", "ts_utc", baselines.moving_average(rows.columns, "temp_c").alias("y_pred"))


@register(
    "climatology_fit",
    query(pick("station_id, month, hour", ("mean", "global_mean"), "clim1"), ("clim1",)),
)
def climatology_fit(spark, sf_dir):
    return baselines.fit_climatology(fx.split_rows(spark, sf_dir, 1), "temp_c")


@register(
    "climatology",
    query(
        """SELECT s.station_id, ts_utc, round(coalesce(c.mean, g.global_mean) + 3.7e-9, 6) + 0.0 AS y_pred FROM split1 s
        LEFT JOIN clim1 c ON c.station_id = s.station_id AND c.month = s.month AND c.hour = s.hour
        LEFT JOIN clim_all1 g ON g.station_id = s.station_id""",
        ("split1", "clim1", "clim_all1"),
    ),
)
def climatology(spark, sf_dir):
    rows = fx.split_rows(spark, sf_dir, 1)
    out = baselines.climatology(rows, baselines.fit_climatology(rows, "temp_c"))
    return out.select("station_id", "ts_utc", "y_pred")


# --- metrics ----------------------------------------------------------------


@register("eval_metrics", query(pick(METRIC_KEYS, METRIC_VALUES[:3], "scores"), ("scores",)))
def eval_metrics(spark, sf_dir):
    return evaluate.evaluate_predictions(fx.predictions(spark, sf_dir))


@register("skill_score", query(pick(METRIC_KEYS, METRIC_VALUES, "metrics"), ("metrics",)))
def skill_score(spark, sf_dir):
    return fx.metrics(spark, sf_dir)


@register(
    "experiment_metrics",
    query(
        pick(METRIC_KEYS, METRIC_VALUES, "metrics WHERE model_family = 'baseline'"),
        ("metrics",),
    ),
)
def experiment_metrics(spark, sf_dir):
    """The baseline part of an experiment, all horizons in one job."""
    return experiment.evaluate_run(fx.baseline_rows(spark, sf_dir), fx.OPTIONS)


_REPORT = """coalesce(format('{{:.4f}}', {0}), '') AS {0}"""
_REPORT_SQL = query(
    "SELECT station_id, model_family, model, horizon_label, CAST(horizon_steps AS VARCHAR) AS horizon_steps, "
    + ", ".join(_REPORT.format(c) for c in METRIC_VALUES)
    + ", CAST(n_test AS VARCHAR) AS n_test FROM metrics",
    ("metrics",),
)


@register("metrics_report", _REPORT_SQL)
def metrics_report(spark, sf_dir):
    return evaluate.metrics_report(fx.metrics(spark, sf_dir), keys=["station_id"])


@register("evaluate_saved", _REPORT_SQL)
def evaluate_saved(spark, sf_dir):
    """Report from stored metrics that lack the skill score."""
    path = new_path(spark, "metrics")
    scores = evaluate.evaluate_predictions(fx.predictions(spark, sf_dir))
    tables.write_metrics(scores, path)
    return evaluate.evaluate_saved(tables.read_metrics(spark, path, scores.schema), keys=["station_id"])


@register("metrics_roundtrip", query(pick(METRIC_KEYS, METRIC_VALUES, "metrics"), ("metrics",)))
def metrics_roundtrip(spark, sf_dir):
    path = new_path(spark, "metrics")
    rows = fx.metrics(spark, sf_dir)
    tables.write_metrics(rows, path)
    return spark.read.schema(rows.schema).json(f"{path}/json")


@register(
    "load_predictions",
    query(
        f"SELECT {_PREDICTED}, {rounded('y_true')}, {rounded('y_pred')} FROM predictions WHERE model = 'climatology' AND horizon_label = 'h06'",
        ("predictions",),
    ),
)
def load_predictions(spark, sf_dir):
    path = new_path(spark, "predictions")
    rows = fx.predictions(spark, sf_dir).drop("target")
    tables.write_predictions(rows, path)
    return tables.load_predictions(spark, path, "climatology", "h06", rows.schema)


@register(
    "published_run",
    query(
        f"""SELECT {_PREDICTED}, {rounded('y_true')}, {rounded('y_pred')} FROM (SELECT * EXCLUDE (y_pred),
        CASE WHEN model = 'climatology' THEN y_true ELSE y_pred END AS y_pred FROM predictions)""",
        ("predictions",),
    ),
)
def published_run(spark, sf_dir):
    """Two published runs, the second of one model alone, and a third that never came to its end."""
    path = new_path(spark, "runs")
    rows = fx.predictions(spark, sf_dir).drop("target")
    run_store.publish_table(spark, path, "predictions", rows)
    later = rows.where("model = 'climatology'").withColumn("y_pred", F.col("y_true"))
    run_store.publish_table(spark, path, "predictions", later)
    broken = run_store.begin_run(spark, path)
    tables.write_predictions(rows.withColumn("y_pred", F.lit(0.0)), broken.folder("predictions"))
    return run_store.read_run(spark, path, "predictions", schema=rows.schema).select(*rows.columns)


# --- comparison tables ------------------------------------------------------

H = tuple(fx.HORIZONS)


@register(
    "metric_pivot",
    query(
        "SELECT station_id, model, "
        + ", ".join(f"round(avg(mae) FILTER (horizon_label = '{h}') + 3.7e-9, 6) + 0.0 AS {h}" for h in H)
        + " FROM metrics GROUP BY 1, 2",
        ("metrics",),
    ),
)
def metric_pivot(spark, sf_dir):
    return compare.metric_by_model(fx.metrics(spark, sf_dir), "mae", H, keys=["station_id"])


_MODELS = ("persistence", "moving_average", "climatology", "linear_regression")
_AXIS = ("h01", "h03", "h06")


@register(
    "metric_by_horizon",
    query(
        "SELECT CAST(horizon_order AS INTEGER) AS horizon_order, a.horizon_label, "
        + ", ".join(f"round(avg(rmse) FILTER (model = '{m}') + 3.7e-9, 6) + 0.0 AS {m}" for m in _MODELS)
        + " FROM (VALUES (0, 'h01'), (1, 'h03'), (2, 'h06')) a(horizon_order, horizon_label)"
        " LEFT JOIN metrics m ON m.horizon_label = a.horizon_label GROUP BY ALL",
        ("metrics",),
    ),
)
def metric_by_horizon(spark, sf_dir):
    return compare.metric_by_horizon(fx.metrics(spark, sf_dir), "rmse", _AXIS, _MODELS)


@register(
    "error_by_horizon",
    query("SELECT station_id, horizon_steps, round(avg(mae) + 3.7e-9, 6) + 0.0 AS mae FROM metrics GROUP BY 1, 2", ("metrics",)),
)
def error_by_horizon(spark, sf_dir):
    return compare.error_by_horizon(fx.metrics(spark, sf_dir), keys=["station_id"])


@register(
    "error_growth",
    query(
        """SELECT s.station_id, s.model, CAST(horizon_order AS INTEGER) AS horizon_order, a.horizon_label, round(mae + 3.7e-9, 6) + 0.0 AS mae
        FROM (SELECT DISTINCT station_id, model FROM metrics WHERE mae IS NOT NULL) s,
        (VALUES (0, 'h01'), (1, 'h03'), (2, 'h06')) a(horizon_order, horizon_label)
        LEFT JOIN metrics m ON m.station_id = s.station_id AND m.model = s.model AND m.horizon_label = a.horizon_label""",
        ("metrics",),
    ),
)
def error_growth(spark, sf_dir):
    return compare.error_growth(fx.metrics(spark, sf_dir), _AXIS, keys=["station_id"])


@register(
    "best_per_family",
    query(
        """SELECT station_id, horizon_label, model_family, model, round(mae + 3.7e-9, 6) + 0.0 AS mae FROM metrics
        QUALIFY row_number() OVER (PARTITION BY station_id, horizon_label, model_family ORDER BY mae, model) = 1""",
        ("metrics",),
    ),
)
def best_per_family(spark, sf_dir):
    return compare.best_per_family(fx.metrics(spark, sf_dir), H, keys=["station_id"])


@register(
    "skill_heatmap",
    query(
        """SELECT station_id, model, horizon_label, round(s + 3.7e-9, 6) + 0.0 AS skill, round(greatest(least(s, 1), -2) + 3.7e-9, 6) + 0.0 AS clipped,
        format('{:+.2f}', s) AS label FROM (
        SELECT station_id, model, horizon_label, avg(skill_score_persistence) AS s FROM metrics GROUP BY ALL)""",
        ("metrics",),
    ),
)
def skill_heatmap(spark, sf_dir):
    return compare.skill_heatmap(fx.metrics(spark, sf_dir), keys=["station_id"])


@register(
    "target_labels",
    query(
        """SELECT any_value(target) AS target, CASE WHEN count(*) > 0 THEN 'Temperature' ELSE 'Target value' END AS label,
        CASE WHEN count(*) > 0 THEN 'deg C' END AS unit FROM metrics""",
        ("metrics",),
    ),
)
def target_labels(spark, sf_dir):
    return compare.target_labels(fx.metrics(spark, sf_dir))


@register(
    "horizon_labels",
    query(
        """SELECT DISTINCT horizon_label, CASE horizon_label WHEN 'h01' THEN '1 h' WHEN 'h06' THEN '6 h' END AS text FROM metrics""",
        ("metrics",),
    ),
)
def horizon_labels(spark, sf_dir):
    labels = fx.metrics(spark, sf_dir).select("horizon_label").distinct()
    return labels.select("horizon_label", compare.horizon_label_text(F.col("horizon_label")).alias("text"))


_SERIES = "station_id, model, horizon_label"


@register(
    "window_filter",
    query(
        f"""SELECT {_PREDICTED}, {rounded('y_true')}, {rounded('y_pred')} FROM predictions
        WHERE ts_utc BETWEEN TIMESTAMP '2024-01-27' AND TIMESTAMP '2024-01-28 23:59:59'""",
        ("predictions",),
    ),
)
def window_filter(spark, sf_dir):
    return compare.window_filter(fx.predictions(spark, sf_dir).drop("target"), "2024-01-27", "2024-01-28 23:59:59")


_BINS = 40


@register(
    "residual_hist",
    query(
        f"""SELECT {_SERIES}, bin, round(lo + bin * w + 3.7e-9, 6) + 0.0 AS lo, round(lo + bin * w + w + 3.7e-9, 6) + 0.0 AS hi, count(*) AS count FROM (
        SELECT *, CAST(least(floor((r - lo) / w), {_BINS - 1}) AS INTEGER) AS bin FROM (SELECT *, (hi - lo) / {_BINS} AS w FROM (
        SELECT *, CASE WHEN a = z THEN a - 0.5e0 ELSE a END AS lo, CASE WHEN a = z THEN z + 0.5e0 ELSE z END AS hi FROM (
        SELECT {_SERIES}, y_pred - y_true AS r, min(y_pred - y_true) OVER s AS a, max(y_pred - y_true) OVER s AS z
        FROM predictions WINDOW s AS (PARTITION BY {_SERIES})))))
        GROUP BY ALL""",
        ("predictions",),
    ),
)
def residual_hist(spark, sf_dir):
    return compare.residual_histogram(fx.predictions(spark, sf_dir), _BINS)


@register(
    "residual_bias",
    query(f"SELECT {_SERIES}, round(avg(y_pred - y_true) + 3.7e-9, 6) + 0.0 AS bias FROM predictions GROUP BY ALL", ("predictions",)),
)
def residual_bias(spark, sf_dir):
    return compare.residual_bias(fx.predictions(spark, sf_dir))


@register(
    "scatter_summary",
    query(
        f"""SELECT {_SERIES}, round(least(min(y_true), min(y_pred)) + 3.7e-9, 6) + 0.0 AS lo, round(greatest(max(y_true), max(y_pred)) + 3.7e-9, 6) + 0.0 AS hi,
        round(avg(abs(y_true - y_pred)) + 3.7e-9, 6) + 0.0 AS mae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))) + 3.7e-9, 6) + 0.0 AS rmse,
        count(*) AS n FROM predictions GROUP BY ALL""",
        ("predictions",),
    ),
)
def scatter_summary(spark, sf_dir):
    return compare.scatter_summary(fx.predictions(spark, sf_dir))


_SEGMENTS = f"""SELECT *, sum(CASE WHEN ts_utc - before > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER s AS segment FROM (
    SELECT *, lag(ts_utc) OVER s AS before FROM predictions WINDOW s AS (PARTITION BY {_SERIES} ORDER BY ts_utc))
    WINDOW s AS (PARTITION BY {_SERIES} ORDER BY ts_utc)"""


@register(
    "segments",
    query(f"SELECT {_SERIES}, ts_utc, CAST(segment AS BIGINT) AS segment_id FROM ({_SEGMENTS})", ("predictions",)),
)
def segments(spark, sf_dir):
    out = compare.segments(fx.predictions(spark, sf_dir), fx.HOUR)
    return out.select("station_id", "model", "horizon_label", "ts_utc", "segment_id")


_LARGEST = f"""SELECT {_SERIES}, min(ts_utc) AS segment_start, max(ts_utc) AS segment_end, count(*) AS rows
    FROM ({_SEGMENTS}) GROUP BY {_SERIES}, segment
    QUALIFY row_number() OVER (PARTITION BY {_SERIES} ORDER BY count(*) DESC, min(ts_utc)) = 1"""


@register("largest_segment", query(_LARGEST, ("predictions",)))
def largest_segment(spark, sf_dir):
    return compare.largest_segment(fx.predictions(spark, sf_dir), fx.HOUR)


@register(
    "plot_sample",
    query(
        f"""SELECT {_PREDICTED}, {rounded('y_true')}, {rounded('y_pred')},
        CASE WHEN strftime(a, '%Y-%m-%d') = strftime(z, '%Y-%m-%d') THEN strftime(a, '%Y-%m-%d')
        ELSE strftime(a, '%Y-%m-%d') || ' to ' || strftime(z, '%Y-%m-%d') END AS sample_label FROM (
        SELECT *, min(ts_utc) OVER (PARTITION BY {_SERIES}) AS a, max(ts_utc) OVER (PARTITION BY {_SERIES}) AS z FROM (
        SELECT p.*, row_number() OVER (PARTITION BY {_SERIES} ORDER BY ts_utc) AS rn, g.rows AS n
        FROM predictions p JOIN ({_LARGEST}) g USING ({_SERIES}) WHERE ts_utc BETWEEN segment_start AND segment_end)
        WHERE rn > greatest((n - 7) // 2, 0) AND rn <= greatest((n - 7) // 2, 0) + 7)""",
        ("predictions",),
    ),
)
def plot_sample(spark, sf_dir):
    return compare.plot_sample(fx.predictions(spark, sf_dir).drop("target"), max_points=7, max_gap_seconds=fx.HOUR)


@register(
    "first_points",
    query(
        f"""SELECT {_PREDICTED}, {rounded('y_true')}, {rounded('y_pred')},
        CAST(row_number() OVER (PARTITION BY {_SERIES} ORDER BY ts_utc) AS INTEGER) AS point FROM predictions
        QUALIFY row_number() OVER (PARTITION BY {_SERIES} ORDER BY ts_utc) <= 10""",
        ("predictions",),
    ),
)
def first_points(spark, sf_dir):
    return compare.first_points(fx.predictions(spark, sf_dir).drop("target"), 10)


@register("seeded_sample")
def seeded_sample(spark, sf_dir):
    """A sample drawn by a Spark hash, so no SQL of another engine can repeat it."""
    return compare.seeded_sample(fx.predictions(spark, sf_dir), 20)


# --- runs -------------------------------------------------------------------


@register(
    "merge_metrics",
    query(
        pick(
            METRIC_KEYS,
            METRIC_VALUES,
            f"""(SELECT {METRIC_KEYS}, {', '.join(METRIC_VALUES)} FROM delta UNION ALL
            SELECT {METRIC_KEYS}, {', '.join(METRIC_VALUES)} FROM metrics WHERE model IN ('persistence', 'moving_average', 'linear_regression', 'ridge')
            AND model NOT IN (SELECT model FROM delta))""",
        ),
        ("metrics", "delta"),
    ),
)
def merge_metrics(spark, sf_dir):
    return runs.merge_metrics(fx.metrics(spark, sf_dir), fx.delta_metrics(spark, sf_dir), fx.ROSTER)


def _artifacts(spark, sf_dir):
    return fx.predictions(spark, sf_dir).select("model", "horizon_label"), fx.delta_metrics(spark, sf_dir).select(
        "model", "horizon_label"
    )


@register(
    "provenance",
    query(
        """SELECT r.model, h.horizon_label, CASE WHEN EXISTS (SELECT 1 FROM delta d WHERE d.model = r.model AND d.horizon_label = h.horizon_label)
        THEN 'delta' WHEN EXISTS (SELECT 1 FROM predictions b WHERE b.model = r.model AND b.horizon_label = h.horizon_label)
        THEN 'baseline' ELSE 'missing' END AS source
        FROM (VALUES ('persistence'), ('moving_average'), ('linear_regression'), ('ridge')) r(model),
        horizons h""",
        ("predictions", "delta", "horizons"),
    ),
)
def provenance(spark, sf_dir):
    base, delta = _artifacts(spark, sf_dir)
    return runs.artifact_provenance(fx.ROSTER, runs.discover_horizons(base, delta), base, delta)


def _catalogue(spark, sf_dir):
    """(run_id, kind, item): what each run left behind."""
    ev = fx.events(spark, sf_dir)
    kinds = {"click": "supervised", "view": "scalers", "purchase": "predictions", "signup": "models", "error": "reports"}
    kind = F.coalesce(*[F.when(F.col("event_type") == e, k) for e, k in kinds.items()])
    return ev.select(F.col("user_id").alias("run_id"), kind.alias("kind"), F.col("event_id").alias("item"))


_KIND = """CASE event_type WHEN 'click' THEN 'supervised' WHEN 'view' THEN 'scalers' WHEN 'purchase' THEN 'predictions'
    WHEN 'signup' THEN 'models' ELSE 'reports' END"""


@register("run_inventory", f"SELECT user_id AS run_id, {_KIND} AS kind, count(*) AS items FROM events GROUP BY ALL")
def run_inventory(spark, sf_dir):
    return runs.run_inventory(_catalogue(spark, sf_dir))


@register(
    "shared_provenance",
    f"""SELECT category, CASE WHEN category IN (SELECT {_KIND} FROM events WHERE user_id % 2 = 1 AND event_type <> 'view') THEN 'delta'
    WHEN category IN (SELECT {_KIND} FROM events) THEN 'baseline' ELSE 'missing' END AS source
    FROM (VALUES ('configs'), ('scalers'), ('interim'), ('split_metadata'), ('supervised')) c(category)""",
)
def shared_provenance(spark, sf_dir):
    items = _catalogue(spark, sf_dir)
    delta = items.where((F.pmod("run_id", F.lit(2)) == 1) & (F.col("kind") != "scalers"))
    return runs.shared_provenance(items, delta)


def _both_metadata(spark, sf_dir, train=0.70):
    first, second = (fx.metadata(spark, sf_dir, label, h, train) for label, h in fx.HORIZONS.items())
    return first.unionByName(second)


_VERIFY = " UNION ALL ".join(
    f"""SELECT b.station_id, b.horizon_label, '{f}' AS field, CAST(b.{f} AS VARCHAR) AS baseline, CAST(d.{f} AS VARCHAR) AS delta
    FROM meta_base{h} b JOIN meta_late{h} d USING (station_id) WHERE b.{f} IS DISTINCT FROM d.{f}"""
    for h in (1, 6)
    for f in runs.VERIFIED_FIELDS
)


@register("verify_splits", query(_VERIFY, tuple(f"meta_{n}{h}" for n in ("base", "late") for h in (1, 6))))
def verify_splits(spark, sf_dir):
    return runs.verify_splits(
        _both_metadata(spark, sf_dir), _both_metadata(spark, sf_dir, train=0.60), keys=["station_id", "horizon_label"]
    )


@register(
    "split_digest",
    query(
        """SELECT station_id, split, count(*) AS n_rows,
        CAST(sum(CAST('0x' || substr(m, 1, 15) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(m, 16, 15) AS BIGINT)) AS VARCHAR) AS digest
        FROM (SELECT station_id, split, md5(station_id || chr(31) || CAST(epoch_us(ts_utc) AS VARCHAR)) AS m FROM split1) GROUP BY ALL""",
        ("split1",),
    ),
)
def split_digest(spark, sf_dir):
    return runs.split_digest(fx.split_rows(spark, sf_dir, 1))


@register(
    "discover_horizons",
    query(
        """SELECT CAST(row_number() OVER (ORDER BY place, horizon_label) - 1 AS INTEGER) AS horizon_order, horizon_label
        FROM horizons""",
        ("horizons",),
    ),
)
def discover_horizons(spark, sf_dir):
    return runs.discover_horizons(*_artifacts(spark, sf_dir))


# --- models -----------------------------------------------------------------


@register(
    "ols_1d",
    query("SELECT station_id, round(intercept + 3.7e-9, 6) + 0.0 AS y_offset, round(slope + 3.7e-9, 6) + 0.0 AS slope, n FROM ols1", ("ols1",)),
)
def ols_1d(spark, sf_dir):
    rows = fx.split_rows(spark, sf_dir, 1).where(F.col("split") == "train")
    models = linear.fit_ols(rows, ["temp_c"], target_column("temp_c", 1))
    return models.select("station_id", "y_offset", F.col("coefficients")[0].alias("slope"), "n")


@register(
    "stored_model_scoring",
    query(
        " UNION ALL ".join(
            f"""SELECT t.station_id, '{label}' AS horizon_label, {h} AS horizon_steps, ts_utc, 'linear_regression' AS model,
            round(intercept + slope * temp_c + 3.7e-9, 6) + 0.0 AS y_pred FROM split{h} t JOIN ols{h} m ON m.station_id = t.station_id
            WHERE split = 'test'"""
            for h, label in ((1, "h01"), (6, "h06"))
        ),
        ("split1", "split6", "ols1", "ols6"),
    ),
)
def stored_model_scoring(spark, sf_dir):
    """All horizons in one fit; the models are stored, read again and joined to the test rows."""
    parts = []
    for h, label in ((1, "h01"), (6, "h06")):
        y = F.col(f"`{target_column('temp_c', h)}`")
        one = fx.split_rows(spark, sf_dir, h).select("station_id", "ts_utc", "temp_c", "split", y.alias("y_true"))
        parts.append(one.withColumn("horizon_label", F.lit(label)).withColumn("horizon_steps", F.lit(h)))
    stacked = parts[0].unionByName(parts[1])
    path = new_path(spark, "models")
    model_store.save_models(model_store.fit_horizons(stacked, ["temp_c"], "linear_regression"), path, "run-1")
    scored = model_store.score_horizons(stacked.where(F.col("split") == "test"), model_store.load_models(spark, path))
    return scored.select("station_id", "horizon_label", "horizon_steps", "ts_utc", "model", "y_pred")


_RIDGE_SQL = query(
    """, blocks AS (SELECT station_id, n_folds, fold_block, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx,
    sum(x * y) AS xy, sum(y * y) AS yy FROM folded GROUP BY ALL),
    folds AS (SELECT station_id, n_folds, fold_block, n, sx, sy, xx, xy, yy, sum(n) OVER w AS tn, sum(sx) OVER w AS tsx, sum(sy) OVER w AS tsy,
    sum(xx) OVER w AS txx, sum(xy) OVER w AS txy FROM blocks
    WINDOW w AS (PARTITION BY station_id ORDER BY fold_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    tried AS (SELECT station_id, n_folds, alpha, avg(sqrt((yy - 2 * c * sy + n * c * c - 2 * w * (xy - c * sx) + w * w * xx) / n)) AS score FROM (
    SELECT *, tsy / tn AS c, (txy - tsy / tn * tsx) / (txx + alpha) AS w FROM folds, (VALUES (0.1e0), (1e0), (10e0), (100e0)) a(alpha)
    WHERE fold_block > 0) GROUP BY ALL),
    chosen AS (SELECT station_id, CASE WHEN n_folds IS NULL THEN 100e0 ELSE alpha END AS alpha FROM (
    SELECT b.station_id, b.n_folds, t.alpha, row_number() OVER (PARTITION BY b.station_id ORDER BY score, t.alpha) AS rn
    FROM (SELECT DISTINCT station_id, n_folds FROM folded) b LEFT JOIN tried t USING (station_id)) WHERE rn = 1)
    SELECT station_id, round(any_value(alpha) + 3.7e-9, 6) + 0.0 AS alpha, round(avg(y) + 3.7e-9, 6) + 0.0 AS y_offset,
    round((sum(x * y) - avg(y) * sum(x)) / (sum(x * x) + any_value(alpha)) + 3.7e-9, 6) + 0.0 AS weight, count(*) AS n
    FROM folded JOIN chosen USING (station_id) GROUP BY 1""",
    ("split1",),
).replace(
    "\n, blocks",
    ", train1 AS (SELECT station_id, ts_utc, temp_c AS x, y1 AS y FROM split1 WHERE split = 'train'), folded AS ("
    + _folds_sql("train1", ", x, y")
    + "), blocks",
)


@register("ridge_1d", _RIDGE_SQL)
def ridge_1d(spark, sf_dir):
    """Ridge with chronological validation on one feature, which SQL can follow."""
    rows = fx.split_rows(spark, sf_dir, 1).where(F.col("split") == "train")
    models = linear.fit_ridge_cv(rows, ["temp_c"], target_column("temp_c", 1))
    return models.select("station_id", "alpha", "y_offset", F.col("coefficients")[0].alias("weight"), "n")


def _scaled(spark, sf_dir):
    rows = fx.model_rows(spark, sf_dir)
    names = features.select_feature_columns(rows, target_column("temp_c", 1))
    params = scaling.fit_scaler(rows, names)
    scaled = stage(scaling.apply_scaler(rows, params, names), "scaled", ["split"])
    return scaled.where(F.col("split") == "train"), scaled.where(F.col("split") == "test"), names


def _scored(name: str):
    def run(spark, sf_dir):
        train, test, names = _scaled(spark, sf_dir)
        y = target_column("temp_c", 1)
        out = experiment.fit_predict(name, train, test, names, y, fx.OPTIONS)
        return out.select("station_id", "ts_utc", F.col(f"`{y}`").alias("y_true"), "y_pred")

    return run


register("ridge_cv")(_scored("ridge"))
register("linear_regression")(_scored("linear_regression"))
register("random_forest")(_scored("random_forest"))
register("gradient_boosting")(_scored("gradient_boosting"))


@register("batch_scoring")
def batch_scoring(spark, sf_dir):
    """A scaler and a model, stored and loaded again, applied to the test rows; both are fitted on the train rows."""
    rows = fx.model_rows(spark, sf_dir)
    y = target_column("temp_c", 1)
    names = features.select_feature_columns(rows, y)
    folder = new_path(spark, "model")
    scaling.fit_scaler(rows, names).write.parquet(f"{folder}/scaler")
    params = spark.read.parquet(f"{folder}/scaler")
    train = scaling.apply_scaler(rows.where(F.col("split") == "train"), params, names)
    trees.save_model(trees.fit_model(train, names, y, "linear_regression"), f"{folder}/model")
    test = scaling.apply_scaler(rows.where(F.col("split") == "test"), params, names)
    return trees.score(test, trees.load_model(f"{folder}/model"), names).select("station_id", "ts_utc", "y_pred")


# --- many stations ----------------------------------------------------------

_USER_SQL = """WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    obs AS (SELECT CAST(user_id AS VARCHAR) AS station_id, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts_utc,
    sum(CAST(round(value * 100) AS BIGINT)) / (count(*) * 1e3) AS temp_c, sum(k) * 1e0 / count(*) AS rh_pct, max(value) / 1e1 AS gust_ms
    FROM ev GROUP BY 1, 2),
    axis AS (SELECT station_id, unnest(generate_series(min(ts_utc), max(ts_utc), INTERVAL 10 MINUTE)) AS ts_utc FROM obs GROUP BY station_id),
    grid AS (SELECT a.station_id, a.ts_utc, temp_c, rh_pct, gust_ms FROM axis a LEFT JOIN obs o ON o.station_id = a.station_id AND o.ts_utc = a.ts_utc)"""


@register(
    "user_grid_coverage",
    _USER_SQL
    + """ SELECT station_id, count(*) AS steps, count(temp_c) AS observed, round(avg(temp_c) + 3.7e-9, 6) + 0.0 AS temp_c FROM grid GROUP BY 1""",
)
def user_grid_coverage(spark, sf_dir):
    rows = fx.user_grid(spark, sf_dir)
    return rows.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("steps"), F.count("temp_c").alias("observed"), F.avg("temp_c").alias("temp_c")
    )


def _user_roll(w: int) -> str:
    return f"(PARTITION BY station_id ORDER BY ts_utc ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


@register(
    "user_grid_rolling",
    _USER_SQL
    + f""", rolled AS (SELECT station_id, avg(temp_c) OVER {_user_roll(36)} AS m36, max(temp_c) OVER {_user_roll(144)} AS x144,
    stddev_samp(temp_c) OVER {_user_roll(144)} AS s144 FROM grid)
    SELECT station_id, count(m36) AS n36, round(avg(m36) + 3.7e-9, 6) + 0.0 AS mean36, round(max(x144) + 3.7e-9, 6) + 0.0 AS max144,
    round(avg(s144) + 3.7e-9, 6) + 0.0 AS std144 FROM rolled GROUP BY 1""",
)
def user_grid_rolling(spark, sf_dir):
    """Day-long rolling statistics of every user's ten-minute grid, summed up per user."""
    out = windows.rolling_features(fx.user_grid(spark, sf_dir), ["temp_c"], [6, 18, 36, 144], 600, min_periods=1)
    return out.groupBy("station_id").agg(
        F.count("temp_c_roll36_mean").alias("n36"),
        F.avg("temp_c_roll36_mean").alias("mean36"),
        F.max("temp_c_roll144_max").alias("max144"),
        F.avg("temp_c_roll144_std").alias("std144"),
    )


@register(
    "rolling_any_window",
    _USER_SQL
    + f""", rolled AS (SELECT station_id, avg(temp_c) OVER {_user_roll(1009)} AS m, min(temp_c) OVER {_user_roll(1009)} AS lo,
    max(temp_c) OVER {_user_roll(1009)} AS hi, stddev_samp(temp_c) OVER {_user_roll(1009)} AS s, max(temp_c) OVER {_user_roll(101)} AS x FROM grid)
    SELECT station_id, count(m) AS n, round(avg(m) + 3.7e-9, 6) + 0.0 AS mean, round(avg(lo) + 3.7e-9, 6) + 0.0 AS low,
    round(avg(hi) + 3.7e-9, 6) + 0.0 AS high, round(avg(s) + 3.7e-9, 6) + 0.0 AS std, round(avg(x) + 3.7e-9, 6) + 0.0 AS high101
    FROM rolled GROUP BY 1""",
)
def rolling_any_window(spark, sf_dir):
    """A week of ten-minute steps and one more, and another prime: neither is put together from a shorter window."""
    rows = fx.user_grid(spark, sf_dir).select("station_id", "ts_utc", "temp_c")
    out = windows.rolling_features(rows, ["temp_c"], [101, 1009], 600, min_periods=1)
    return out.groupBy("station_id").agg(
        F.count("temp_c_roll1009_mean").alias("n"),
        F.avg("temp_c_roll1009_mean").alias("mean"),
        F.avg("temp_c_roll1009_min").alias("low"),
        F.avg("temp_c_roll1009_max").alias("high"),
        F.avg("temp_c_roll1009_std").alias("std"),
        F.avg("temp_c_roll101_max").alias("high101"),
    )


@register(
    "gram_tiles",
    """WITH z AS (SELECT l_returnflag, [l_quantity, l_discount, l_tax, l_linenumber, l_quantity * l_discount, 1.0]::DOUBLE[] AS v FROM lineitem)
    SELECT l_returnflag, (a.i)::INTEGER AS i, (b.j)::INTEGER AS j, count(*) AS n, round(avg(v[a.i + 1] * v[b.j + 1]) + 3.7e-9, 6) + 0.0 AS mean
    FROM z, range(6) a(i), range(6) b(j) WHERE b.j >= a.i GROUP BY ALL""",
)
def gram_tiles(spark, sf_dir):
    """Mean products of all pairs of features, label and one, added up in tiles of four by four."""
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", *names, (F.col("l_quantity") * F.col("l_discount")).alias("y"))
    gram = linear.gram_statistics(rows, names, "y", ["l_returnflag"], tile=4)
    entries = gram.select("l_returnflag", F.col("row").alias("i"), F.posexplode("values").alias("_at", "sum"), "col")
    upper = entries.select("l_returnflag", "i", (F.col("col") + F.col("_at")).alias("j"), "sum").where("j >= i")
    rows_of = upper.where("i = 5 and j = 5").select("l_returnflag", F.round("sum").cast("bigint").alias("n"))
    return upper.join(rows_of, "l_returnflag").select("l_returnflag", "i", "j", "n", (F.col("sum") / F.col("n")).alias("mean"))
