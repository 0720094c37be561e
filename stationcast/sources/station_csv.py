"""Raw station exports: sniff, read, map, clean, convert, deduplicate."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast.functions.timeparse import with_utc
from stationcast.functions.units import clean_numeric, to_canonical
from stationcast.operators.grid import off_axis_rows

CSV_GLOB = "*.[cC][sS][vV]"
# Bytes looked at for the encoding, candidates for the delimiter.
SNIFF_BYTES = 512
DELIMITERS = (",", ";", "\t", "|")
HEAD_BYTES = 8_192
HEAD_LINES = 10
ORDER = ("_file", "_block", "_line")


# --- sniffing ---------------------------------------------------------------


def looks_utf16le(head: Column) -> Column:
    """UTF-16LE without a byte-order mark, by where the zero bytes of the start sit."""
    sample = F.substring(head, 1, SNIFF_BYTES)
    # Hex text: a byte is two digits, so a 16-bit unit is four.
    text = F.hex(sample)
    marked = text.startswith("FFFE") | text.startswith("FEFF")

    def zeros(first: int) -> Column:
        # Units are cut into a list; the last one may be half.
        units = F.regexp_extract_all(text, F.lit(r"([0-9A-F]{2})([0-9A-F]{2})?"), F.lit(first))
        return F.size(F.filter(units, lambda u: u == "00"))

    even, odd = zeros(1), zeros(2)
    return (~marked) & (F.length(sample) >= 4) & (odd > F.greatest(F.lit(4), even * 4))


def detect_delimiter(text: Column) -> Column:
    """Most frequent candidate in the first ten non-blank lines; comma when none occurs."""
    lines = F.slice(F.filter(F.split(text, r"\r\n|\r|\n"), lambda s: F.length(F.trim(s)) > 0), 1, 10)
    joined = F.array_join(lines, "\n")
    # On equal counts the earlier candidate wins, as the larger negative index.
    counts = [
        F.struct((F.length(joined) - F.length(F.replace(joined, F.lit(d)))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d"))
        for i, d in enumerate(DELIMITERS)
    ]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def _read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in batches:
        heads = []
        for path in pdf["path"]:
            # Spark writes local files as file:/x; a URI needs file:///x.
            system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
            with system.open_input_stream(inner) as stream:
                head = stream.read(HEAD_BYTES)
                # long lines: on until the header and the lines to sniff are there
                while head.count(b"\n") < HEAD_LINES and (more := stream.read(len(head))):
                    head += more
                heads.append(head)
        yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "head": heads})


def file_manifest(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """(path, length, encoding, delimiter, header) of every CSV file of a directory.

    Files are listed without being read; tasks then fetch the first bytes of each.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", CSV_GLOB)
        .option("recursiveFileLookup", recursive)
        .load(directory)
        .select("path", "length")
    )
    heads = listing.mapInPandas(_read_heads, "path string, length bigint, head binary")
    mark = F.hex(F.substring("head", 1, 3))
    encoding = (
        F.when(looks_utf16le(F.col("head")), "UTF-16LE")
        .when(mark.startswith("FFFE"), "UTF-16LE")
        .when(mark.startswith("FEFF"), "UTF-16BE")
        .otherwise("UTF-8")
    )
    even = F.col("head").substr(F.lit(1), (F.length("head") / 2).cast("int") * 2)
    text = (
        F.when(F.col("encoding") == "UTF-8", F.try_validate_utf8(F.regexp_replace(F.col("head").cast("string"), "[^\n]*$", "")))
        .when(F.col("encoding") == "UTF-16LE", F.decode(even, "UTF-16LE"))
        .otherwise(F.decode(even, "UTF-16BE"))
    )
    whole = F.coalesce(text, F.col("head").cast("string"))
    return (
        heads.withColumn("encoding", encoding)
        .withColumn("_text", F.regexp_replace(whole, "^﻿", ""))
        .select(
            "path",
            "length",
            "encoding",
            detect_delimiter(F.col("_text")).alias("delimiter"),
            F.regexp_extract("_text", r"^([^\r\n]*)", 1).alias("header"),
        )
    )


# --- reading ----------------------------------------------------------------


def _header_names(header: str, delimiter: str) -> list[str]:
    """Column names of a header line, quoted cells whole; nameless and repeated ones get a position name."""
    names: list[str] = []
    for i, raw in enumerate(next(csv.reader([header], delimiter=delimiter, skipinitialspace=True), [])):
        name = raw.strip().strip('"').strip()
        names.append(name if name and name not in names else f"_c{i}")
    return names


def _read_format(spark: SparkSession, paths: Sequence[str], encoding: str, delimiter: str, header: str) -> DataFrame:
    names = _header_names(header, delimiter)
    reader = (
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        .option("header", True)
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
    )
    if encoding != "UTF-8":
        # Without a line separator Spark cuts lines at the single byte 0x0A.  A byte-order
        # mark belongs to the header line, which is not read as data.
        reader = reader.option("lineSep", "\n")
    raw = reader.csv(list(paths))
    return raw.select(
        *[F.regexp_replace(F.col("`" + n.replace("`", "``") + "`"), "\r$", "").alias(n) for n in names],
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_path").alias("_file"),  # equal names in two folders are two files
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def read_raw_directory(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """Text columns of all CSV files, with ``_path`` and the reading order.

    Files of one layout are read together; only the list of layouts and their
    paths, which Spark's own file listing holds as well, comes to the driver.
    """
    layouts = (
        file_manifest(spark, directory, recursive)
        .where(F.col("length") > 0)
        .groupBy("encoding", "delimiter", "header")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
        .orderBy("encoding", "delimiter", "header")
        .collect()
    )
    if not layouts:
        raise ValueError(f"no station CSV files found in {directory}")
    out: DataFrame | None = None
    for row in layouts:
        part = _read_format(spark, row["paths"], row["encoding"], row["delimiter"], row["header"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# --- mapping ----------------------------------------------------------------


def mapping_with_timezone(mapping: Mapping, timezone: str | None) -> dict:
    """The mapping with the configured zone where it names none itself."""
    ts = dict(mapping.get("ts") or {})
    if timezone and not ts.get("timezone"):
        ts["timezone"] = timezone
    return {**mapping, "ts": ts}


def map_schema(raw: DataFrame, mapping: Mapping, keep: Sequence[str] = ()) -> DataFrame:
    """Source columns to canonical names and numbers in source units; absent ones are left out.

    The time column becomes ``_wall_clock``.
    """
    present = set(raw.columns)
    ts_source = mapping["ts"]["col"]
    if ts_source not in present:
        raise ValueError(f"time column {ts_source!r} is not in the file")

    def source(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    fields = {c: spec["col"] for c, spec in mapping["fields"].items() if spec.get("col") in present}
    return raw.select(
        *[F.col(c) for c in keep if c in present],
        source(ts_source).alias("_wall_clock"),
        *[clean_numeric(source(s)).alias(c) for c, s in fields.items()],
    )


def normalize_units(df: DataFrame, mapping: Mapping) -> DataFrame:
    units = {c: spec.get("unit") for c, spec in mapping["fields"].items() if c in df.columns}
    return df.withColumns({c: to_canonical(F.col(c), u) for c, u in units.items()})


def canonical_rows(
    raw: DataFrame, mapping: Mapping, timezone: str | None = None, keep: Sequence[str] = (), unreadable: bool = False
) -> DataFrame:
    """Mapped, unit-normalised rows with ``ts_utc``.

    Rows without a readable time are left out, and counted by ``ingest_report``; with
    ``unreadable`` they stay, with NULL.
    """
    zoned = mapping_with_timezone(mapping, timezone)
    mapped = normalize_units(map_schema(raw, zoned, keep), zoned)
    zone = zoned["ts"].get("timezone") or "UTC"
    return with_utc(mapped, "_wall_clock", zone, "ts_utc", unreadable).drop("_wall_clock")


# --- duplicates -------------------------------------------------------------


def keep_first(df: DataFrame, order: Sequence[str] = ORDER, keys: Sequence[str] = ("station_id",), ts: str = "ts_utc") -> DataFrame:
    """The first row in ``order`` of each (key, ts).

    A minimum rather than a row number: each task already reduces its copies to
    one, so a time that occurs in very many rows is never gathered.
    """
    group = [*keys, ts]
    payload = [c for c in df.columns if c not in {*group, *order}]
    first = F.min_by(F.struct(*payload), F.struct(*order)).alias("_row")
    return df.groupBy(*group).agg(first).select(*group, "_row.*")


def dedup_report(
    df: DataFrame, keys: Sequence[str] = ("station_id",), ts: str = "ts_utc", files: str | None = "_file"
) -> DataFrame:
    """Files read, rows before and after, excess rows and repeated times per key.

    Counts are first reduced per (key, ts); files are counted on their own.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    report = counts.groupBy(*keys).agg(
        F.sum("_n").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.count_if(F.col("_n") > 1).alias("duplicate_timestamp_count"),
        F.lit("keep_first").alias("duplicate_policy"),
    )
    if files is None or files not in df.columns:
        return report
    read = df.select(*keys, files).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("files_read"))
    return report.join(read, keys)


def read_station_csv(
    spark: SparkSession,
    directory: str,
    mapping: Mapping,
    timezone: str | None = None,
    station_id: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Canonical series (station_id, ts_utc, variables...) of a directory of exports.

    With ``station_id=None`` the folder of each file names its station.
    """
    rows = station_rows(spark, directory, mapping, timezone, station_id, recursive)
    return keep_first(rows)


def station_rows(
    spark: SparkSession,
    directory: str,
    mapping: Mapping,
    timezone: str | None = None,
    station_id: str | None = None,
    recursive: bool = False,
    unreadable: bool = False,
) -> DataFrame:
    """Canonical rows before duplicates are dropped, with their reading order."""
    raw = read_raw_directory(spark, directory, recursive)
    station = F.lit(station_id) if station_id else F.element_at(F.split("_path", "/"), -2)
    named = raw.withColumn("station_id", station)
    return canonical_rows(named, mapping, timezone, ["station_id", *ORDER], unreadable)


def ingest_report(
    rows: DataFrame, order: Sequence[str] = ORDER, ts: str = "ts_utc", freq_seconds: int | None = None
) -> DataFrame:
    """Per station and file: rows read = kept + duplicate + without a readable time.

    ``rows`` come from ``station_rows(..., unreadable=True)``.  A duplicate is counted
    where it stands; the copy kept is the first in ``order``, as in ``keep_first``.
    With ``freq_seconds`` a column ``off_axis`` counts the kept rows that are not on the
    station's time axis.
    """
    file = order[0]
    read = rows.groupBy("station_id", file).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col(ts).isNull()).alias("unreadable_time")
    )
    winners = rows.groupBy("station_id", ts).agg(F.min(F.struct(*order)).alias("_first"))
    kept = winners.groupBy("station_id", F.col(f"_first.{file}").alias(file)).agg(F.count(ts).alias("rows_kept"))
    joined = read.join(kept, ["station_id", file], "left").withColumn("rows_kept", F.coalesce("rows_kept", F.lit(0).cast("bigint")))
    counts = []
    if freq_seconds is not None:
        stray = off_axis_rows(winners.where(F.col(ts).isNotNull()), freq_seconds, "station_id", ts)
        strays = stray.groupBy("station_id", F.col(f"_first.{file}").alias(file)).agg(F.count(F.lit(1)).alias("off_axis"))
        joined = joined.join(strays, ["station_id", file], "left")
        counts = [F.coalesce("off_axis", F.lit(0).cast("bigint")).alias("off_axis")]
    return joined.select(
        "station_id",
        F.col(file).alias("file"),
        "rows_read",
        "rows_kept",
        (F.col("rows_read") - F.col("rows_kept") - F.col("unreadable_time")).alias("duplicate_rows"),
        "unreadable_time",
        *counts,
    )
