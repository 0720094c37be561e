"""Timestamp parsing and local-to-UTC conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted dates, and times of 24 and of twelve hours, once the separators are made equal.
YEAR_FIRST, DAY_FIRST = "yyyy-M-d", "d-M-yyyy"
HOURS_24, HOURS_12 = "[ H:m[:s[.SSSSSS]]]", " h:m[:s[.SSSSSS]] a"

_WITH_ZONE = r"(?i)^(.*:[0-9.]+)\s*(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})$"
_DAY = 86_400_000_000


def parse_wall_clock(text: Column) -> Column:
    """Wall-clock text to a timestamp without zone shift; bad text gives NULL.

    Dates have slashes, dashes or dots and begin with the year (four digits) or the
    day; times have 24 hours, or twelve with AM or PM, and up to six digits of a
    second.  The rule works value by value, so no sample of the file has to be
    looked at first.
    """
    spaced = F.regexp_replace(F.upper(F.trim(text)), r"(?<=[0-9])[T\s]+(?=[0-9])", " ")
    plain = F.regexp_replace(F.regexp_replace(spaced, r"\s*([AP])\.?M\.?$", " $1M"), r"^([0-9]+)[-/.]([0-9]+)[-/.]", "$1-$2-")

    def parsed(date: str) -> Column:
        return F.when(plain.endswith("M"), F.try_to_timestamp(plain, F.lit(date + HOURS_12))).otherwise(
            F.try_to_timestamp(plain, F.lit(date + HOURS_24))
        )

    return F.when(plain.rlike("^[0-9]{4}-"), parsed(YEAR_FIRST)).otherwise(parsed(DAY_FIRST))


def with_utc(df: DataFrame, text: str, tz: str, name: str = "ts_utc", unreadable: bool = True) -> DataFrame:
    """``df`` with the UTC instant of a time text: local time of ``tz``, unless it ends in Z, UTC, GMT or an offset.

    Rows without a readable time get NULL, or are left out.  The parts are columns of
    their own on the way, so that each is evaluated once; for the same reason the
    filter looks at the parsed time, since Spark copies what a filter looks at.
    """
    clean = F.trim(F.col(text))
    parts = df.withColumns(
        {"_wall": parse_wall_clock(F.regexp_replace(clean, _WITH_ZONE, "$1")), "_mark": F.upper(F.regexp_extract(clean, _WITH_ZONE, 2))}
    )
    if not unreadable:
        parts = parts.where(F.col("_wall").isNotNull())
    offset = F.replace(F.col("_mark"), F.lit(":"), F.lit(""))
    hours, minutes = F.substring(offset, 2, 2).try_cast("bigint"), F.substring(offset, 4, 2).try_cast("bigint")
    ahead = F.coalesce(hours * 60 + minutes, F.lit(0)) * F.when(offset.startswith("-"), -60_000_000).otherwise(60_000_000)
    instant = F.timestamp_micros(F.unix_micros("_wall") - ahead)
    utc = F.when(F.col("_mark") != "", instant).otherwise(local_to_utc(F.col("_wall"), tz))
    return parts.withColumn(name, utc).drop("_wall", "_mark")


def local_to_utc(local: Column, tz: str) -> Column:
    """UTC instant of a local wall-clock time.

    A time skipped in spring moves to the instant of the change; a time that
    occurs twice in autumn means the later (standard) one.  How far the clock is set
    back is what the zone's offset loses within the next day.
    """
    utc = F.to_utc_timestamp(local, tz)
    lost = F.unix_seconds(F.from_utc_timestamp(utc, tz)) - F.unix_seconds(local)
    moved = F.timestamp_micros(F.unix_micros(utc) - F.pmod(F.unix_micros(local), lost * 1_000_000))
    next_day = F.timestamp_micros(F.unix_micros(utc) + _DAY)
    kept = F.unix_micros(F.from_utc_timestamp(next_day, tz)) - F.unix_micros(F.from_utc_timestamp(utc, tz))
    later = F.timestamp_micros(F.unix_micros(utc) + (_DAY - kept))
    twice = (kept < _DAY) & (F.from_utc_timestamp(later, tz) == local)
    return F.when(lost > 0, moved).when(twice, later).otherwise(utc)
