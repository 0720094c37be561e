from __future__ import annotations

import math
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stationcast.session import local_session  # noqa: E402

START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def station_rows(n: int = 220) -> list[tuple]:
    rows = []
    for i in range(n):
        ts = START + timedelta(minutes=10 * i)
        hour = ts.hour
        sun = math.sin((hour - 6) / 12 * math.pi)
        rows.append(
            (
                "s1", ts, 12 + math.sin(i / 12), 70 + math.cos(i / 18), 1015 + math.sin(i / 40), 2 + abs(math.sin(i / 7)),
                3 + abs(math.sin(i / 5)), float(15 * i % 360), 0.0, 0.0, max(0.0, 500 * sun), max(0.0, 5 * sun),
            )
        )
    return rows


STATION_SCHEMA = (
    "station_id string, ts_utc timestamp, temp_c double, rh_pct double, pres_hpa double, wspd_ms double, gust_ms double,"
    " wdir_deg double, rain_mm double, rain_rate_mmh double, solar_wm2 double, uv_index double"
)


@pytest.fixture(scope="session")
def station(spark):
    return spark.createDataFrame(station_rows(), STATION_SCHEMA).cache()


def series(spark, values, station="s1", minutes=10, column="temp_c", start=START):
    rows = [(station, start + timedelta(minutes=minutes * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"station_id string, ts_utc timestamp, {column} double")
