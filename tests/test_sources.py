from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stationcast.functions.timeparse import local_to_utc, parse_wall_clock
from stationcast.functions.units import clean_numeric, to_canonical
from stationcast.sources import run_store, station_csv, tables
from stationcast.sources.synthetic import synthetic_station
from stationcast.sources.tables import write_metrics, write_per_horizon, write_predictions

TZ = "Europe/Athens"
LONG_NAMES = {
    "temp_c": ("Temperature (°C)", "C"),
    "rh_pct": ("Humidity (%)", "%"),
    "wspd_ms": ("Wind Speed (km/h)", "km/h"),
    "gust_ms": ("Wind Gust (km/h)", "km/h"),
    "solar_wm2": ("Solar Radiation (W/m²)", "W/m2"),
}
SHORT_NAMES = {
    "temp_c": ("temp (°C)", "C"),
    "rh_pct": ("hum (%)", "%"),
    "wspd_ms": ("wspdavg (km/h)", "km/h"),
    "gust_ms": ("wspdhi (km/h)", "km/h"),
    "uv_index": ("uvi", "index"),
}


def mapping(names):
    return {"ts": {"col": "Date (Europe/Athens)"}, "fields": {k: {"col": c, "unit": u} for k, (c, u) in names.items()}}


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("ts_utc").select("ts_utc", *columns).collect()]


def test_two_semicolon_files(spark, tmp_path):
    header = "Date (Europe/Athens);Temperature (°C);Humidity (%);Wind Speed (km/h);Wind Gust (km/h);Solar Radiation (W/m²)\n"
    (tmp_path / "b.CSV").write_text(header + "2024-01-01 00:20;10.2;80;7.2;9;0\n2024-01-01 00:30;10.3;80;3.6;9;0\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text(header + '2024-01-01 00:00;"1,010.5";80;3.6;9;0\n2024-01-01 00:10;x;80;3.6;9;0\n', encoding="utf-8")
    (tmp_path / "notes.txt").write_text("not a station file")
    out = station_csv.read_station_csv(spark, str(tmp_path), mapping(LONG_NAMES), TZ, station_id="s1")
    got = rows(out, "temp_c", "wspd_ms")
    assert [g[0] for g in got] == [datetime(2023, 12, 31, 22, m) for m in (0, 10, 20, 30)]
    assert got[0][1:] == (1010.5, 1.0) and got[1][1] is None and got[2][2] == pytest.approx(2.0)
    assert set(out.columns) == {"station_id", "ts_utc", *LONG_NAMES}


@pytest.mark.parametrize(
    ("local", "expected"),
    [
        (
            ["2024-03-31 02:50", "2024-03-31 03:00", "2024-03-31 03:10", "2024-03-31 04:00"],
            [(datetime(2024, 3, 31, 0, 50), 10.0), (datetime(2024, 3, 31, 1, 0), 10.1)],
        ),
        (
            ["2024-10-27 02:50", "2024-10-27 03:00", "2024-10-27 03:10", "2024-10-27 04:00"],
            [
                (datetime(2024, 10, 26, 23, 50), 10.0),
                (datetime(2024, 10, 27, 1, 0), 10.1),
                (datetime(2024, 10, 27, 1, 10), 10.2),
                (datetime(2024, 10, 27, 2, 0), 10.3),
            ],
        ),
    ],
)
def test_clock_changes(spark, tmp_path, local, expected):
    body = "".join(f"{t};{10 + i / 10}\n" for i, t in enumerate(local))
    (tmp_path / "dst.csv").write_text("Date (Europe/Athens);Temperature (°C)\n" + body, encoding="utf-8")
    out = station_csv.read_station_csv(spark, str(tmp_path), mapping(LONG_NAMES), TZ, station_id="s1")
    assert rows(out, "temp_c") == expected


def test_half_hour_setback(spark):
    local = spark.createDataFrame([("2024-04-07 01:45:00",)], "t string")
    got = local.select(local_to_utc(parse_wall_clock(F.col("t")), "Australia/Lord_Howe").alias("u")).first()["u"]
    assert got == datetime(2024, 4, 6, 15, 15)  # the later, standard reading


def test_utf16le_day_first_with_surplus_field(spark, tmp_path):
    text = (
        "Date (Europe/Athens);temp (°C);hum (%);wspdavg (km/h);wspdhi (km/h);uvi;\r\n"
        "01/03/2023 00:00:00;12.0;80;3.6;7.2;0;\r\n"
        "01/03/2023 00:05:00;;;;;;;\r\n"
        "01/03/2023 00:10:00;12.5;81;7.2;10.8;0;\r\n"
    )
    (tmp_path / "w.csv").write_bytes(text.encode("utf-16le"))
    manifest = station_csv.file_manifest(spark, str(tmp_path)).first()
    assert (manifest["encoding"], manifest["delimiter"]) == ("UTF-16LE", ";")
    out = station_csv.read_station_csv(spark, str(tmp_path), mapping(SHORT_NAMES), TZ, station_id="s1")
    got = rows(out, "temp_c", "wspd_ms", "gust_ms", "uv_index")
    assert got[0] == (datetime(2023, 2, 28, 22, 0), 12.0, 1.0, 2.0, 0.0)
    assert got[1][1:] == (None, None, None, None)
    assert got[2][1:3] == (12.5, 2.0) and got[2][3] == pytest.approx(3.0)


def test_mixed_layouts_and_folder_names(spark, tmp_path):
    for name in ("north", "south"):
        (tmp_path / name).mkdir()
    (tmp_path / "north" / "x.csv").write_text("Date (Europe/Athens),temp (°C)\n2024-01-01 00:00,1\n", encoding="utf-8")
    (tmp_path / "south" / "x.csv").write_bytes("Date (Europe/Athens)\ttemp (°C)\n2024-01-01 00:00\t2\n".encode("utf-16"))
    out = station_csv.read_station_csv(spark, str(tmp_path), mapping(SHORT_NAMES), TZ, recursive=True)
    assert sorted((r["station_id"], r["temp_c"]) for r in out.collect()) == [("north", 1.0), ("south", 2.0)]


def test_no_files_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no station CSV"):
        station_csv.read_raw_directory(spark, str(tmp_path))


def test_missing_time_column_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="time column"):
        station_csv.read_station_csv(spark, str(tmp_path), mapping(SHORT_NAMES), TZ)


@pytest.mark.parametrize(
    ("text", "expected"),
    [("a;b;c\n1;2;3", ";"), ("a,b\n\n1,2", ","), ("a\tb", "\t"), ("a|b|c", "|"), ("plain", ","), ("a,b;c", ",")],
)
def test_delimiters(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(station_csv.detect_delimiter(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("abcdefgh".encode("utf-16le"), True),
        ("abcdefgh".encode("utf-16"), False),
        (b"abcdefgh", False),
        (b"a\0", False),
        (b"a\0b\0c\0d\0", False),
        (b"a\0b\0c\0d\0e\0", True),
    ],
)
def test_utf16_sniff(spark, content, expected):
    df = spark.createDataFrame([(bytearray(content),)], "b binary")
    assert df.select(station_csv.looks_utf16le(F.col("b"))).first()[0] is expected


def test_numbers_and_units(spark):
    df = spark.createDataFrame([("1,234.5",), ("NaN",), ("",), ("n/a",)], "t string")
    assert [r[0] for r in df.select(clean_numeric(F.col("t"))).collect()] == [1234.5, None, None, None]
    one = spark.range(1)
    value = lambda v, u: one.select(to_canonical(F.lit(v), u)).first()[0]
    assert value(212.0, "F") == pytest.approx(100.0)
    assert value(36.0, "km/h") == pytest.approx(10.0)
    assert value(1013.0, "hpa") == 1013.0
    with pytest.raises(ValueError, match="unknown unit"):
        to_canonical(F.lit(1.0), "furlong")


def test_keep_first_and_report(spark):
    data = [("s", datetime(2024, 1, 1), f, 0, i, float(i)) for i, f in enumerate(["b", "a", "a"])]
    data.append(("s", datetime(2024, 1, 2), "b", 0, 9, 9.0))
    df = spark.createDataFrame(data, "station_id string, ts_utc timestamp, _file string, _block int, _line int, v double")
    assert rows(station_csv.keep_first(df), "v") == [(datetime(2024, 1, 1), 1.0), (datetime(2024, 1, 2), 9.0)]
    report = station_csv.dedup_report(df).first().asDict()
    assert report == {
        "station_id": "s", "rows_before": 4, "rows_after": 2, "duplicate_rows": 2, "duplicate_timestamp_count": 1,
        "duplicate_policy": "keep_first", "files_read": 2,
    }


def test_tables_round_trip(spark, tmp_path):
    station = synthetic_station(spark, 50, stations=2)
    tables.write_series(station, str(tmp_path / "s"))
    assert tables.read_series(spark, str(tmp_path / "s")).exceptAll(station).isEmpty()
    data = [("m", "h01", datetime(2024, 1, 1), 1.0, None), ("m", "h01", datetime(2024, 1, 2), 1.0, 2.0), ("n", "h01", datetime(2024, 1, 2), 1.0, 2.0)]
    preds = spark.createDataFrame(data, "model string, horizon_label string, ts_utc timestamp, y_true double, y_pred double")
    tables.write_predictions(preds, str(tmp_path / "p"))
    assert tables.load_predictions(spark, str(tmp_path / "p"), "m", "h01").count() == 1
    assert tables.load_predictions(spark, str(tmp_path / "p"), "other", "h01").isEmpty()
    metrics = spark.createDataFrame([("m", 1.5, float("nan"))], "model string, mae double, mape double")
    tables.write_metrics(metrics, str(tmp_path / "m"))
    assert '"mape":null' in "".join(p.read_text() for p in (tmp_path / "m" / "json").glob("*.json"))
    assert tables.read_metrics(spark, str(tmp_path / "m")).first()["mae"] == 1.5


def test_header_longer_than_the_first_read(spark, tmp_path):
    from stationcast.sources.station_csv import HEAD_BYTES, file_manifest

    long = ";".join(["Date (UTC)", *[f"column {i} of a wide export" for i in range(HEAD_BYTES // 10)]])
    (tmp_path / "wide.csv").write_text(f"{long}\n2024-01-01 00:00;1\n2024-01-01 00:10;2\n")
    row = file_manifest(spark, str(tmp_path)).first()
    assert row["delimiter"] == ";" and "column 818 of a wide export" in str(row["header"])


def test_many_time_layouts(spark):
    from stationcast.functions.timeparse import with_utc

    texts = {
        "2024-01-03 12:30:00.250": datetime(2024, 1, 3, 10, 30, 0, 250_000),
        "2024-01-03T12:30:00Z": datetime(2024, 1, 3, 12, 30),
        "2024-01-03 12:30+05:30": datetime(2024, 1, 3, 7, 0),
        "2024/01/03 12:30": datetime(2024, 1, 3, 10, 30),
        "3/1/2024 12:30:00 PM": datetime(2024, 1, 3, 10, 30),
        "03-01-2024 9:05 am": datetime(2024, 1, 3, 7, 5),
        "03.01.2024": datetime(2024, 1, 2, 22, 0),
        "2024-01-03": datetime(2024, 1, 2, 22, 0),
        "2024-13-01 00:00": None,
        "yesterday": None,
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["u"] for r in with_utc(df, "t", TZ, "u").collect()}
    assert got == texts


def test_quoted_header_keeps_its_delimiter(spark, tmp_path):
    (tmp_path / "q.csv").write_text('time;"temp;avg";hum\n2024-01-01 00:00;1.5;80\n', encoding="utf-8")
    spec = {"ts": {"col": "time"}, "fields": {"temp_c": {"col": "temp;avg", "unit": "C"}, "rh_pct": {"col": "hum", "unit": "%"}}}
    out = station_csv.read_station_csv(spark, str(tmp_path), spec, station_id="s")
    assert out.select("temp_c", "rh_pct").first()[:] == (1.5, 80.0)


@pytest.mark.parametrize("codec", ["utf-16le", "utf-16be"])
def test_utf16_with_mark(spark, tmp_path, codec):
    body = "".join(f"2024-01-01 00:{m:02d};{m}\r\n" for m in range(60))
    (tmp_path / "m.csv").write_bytes(("\ufeffDate (Europe/Athens);temp (°C)\r\n" + body).encode(codec))
    out = station_csv.read_station_csv(spark, str(tmp_path), mapping(SHORT_NAMES), TZ, station_id="s")
    assert [v for _, v in rows(out, "temp_c")] == [float(m) for m in range(60)]


def test_ingest_report_accounts_for_every_row(spark, tmp_path):
    header = "Date (Europe/Athens);temp (°C)\n"
    for year, body in (("2023", "2024-01-01 00:00;1\nnever;9\n"), ("2024", "2024-01-01 00:00;2\n2024-01-01 00:00;2\n2024-01-01 00:10;3\n" * 50)):
        (tmp_path / year).mkdir()
        (tmp_path / year / "export.csv").write_text(header + body, encoding="utf-8")
    args = (spark, str(tmp_path), mapping(SHORT_NAMES), TZ, "s", True)
    report = {r["file"].split("/")[-2]: r[2:] for r in station_csv.ingest_report(station_csv.station_rows(*args, unreadable=True)).collect()}
    assert report == {"2023": (2, 1, 0, 1), "2024": (150, 1, 149, 0)}
    # of two files of one name the one in the first folder wins, however large the other is
    assert [v for _, v in rows(station_csv.read_station_csv(*args), "temp_c")] == [1.0, 3.0]


def test_ingest_report_counts_rows_off_the_axis(spark, tmp_path):
    body = "2024-01-01 00:00;1\n2024-01-01 00:10;2\n2024-01-01 00:20;3\n2024-01-01 00:33;4\n2024-01-01 00:33;4\nnever;9\n"
    (tmp_path / "a.csv").write_text("Date (Europe/Athens);temp (°C)\n" + body, encoding="utf-8")
    read = station_csv.station_rows(spark, str(tmp_path), mapping(SHORT_NAMES), TZ, "s", unreadable=True)
    assert [tuple(r)[2:] for r in station_csv.ingest_report(read, freq_seconds=600).collect()] == [(6, 4, 1, 1, 1)]


# --- runs that appear whole or not at all -----------------------------------


def test_runs_are_published_whole(spark, tmp_path):
    path = str(tmp_path / "runs")
    make = lambda *rows: spark.createDataFrame(rows, "model string, horizon_label string, y double")

    def seen(**of):
        return {(r["model"], r["horizon_label"], r["y"]) for r in run_store.read_run(spark, path, "predictions", **of).collect()}

    with pytest.raises(LookupError):
        seen()
    run_store.publish_table(spark, path, "predictions", make(("1", "h01", 1.0), ("1", "h06", 2.0), ("m", "h01", 3.0)))
    assert seen() == {("1", "h01", 1.0), ("1", "h06", 2.0), ("m", "h01", 3.0)}
    # written, and even whole, but not published
    broken = run_store.begin_run(spark, path)
    write_predictions(make(("1", "h01", -1.0), ("new", "h01", -1.0)), broken.folder("predictions"))
    broken.add_written("predictions", spark.read.parquet(broken.folder("predictions")))
    assert seen() == {("1", "h01", 1.0), ("1", "h06", 2.0), ("m", "h01", 3.0)}
    assert seen(attempt=broken) == {("1", "h01", -1.0), ("new", "h01", -1.0), ("1", "h06", 2.0), ("m", "h01", 3.0)}
    # only what the later run wrote is replaced
    last = run_store.publish_table(spark, path, "predictions", make(("1", "h06", 7.0)))
    assert seen() == {("1", "h01", 1.0), ("1", "h06", 7.0), ("m", "h01", 3.0)}
    assert seen(model="1", horizon_label="h06") == {("1", "h06", 7.0)}
    assert {r["attempt"] for r in run_store.read_run(spark, path, "predictions", model="1", horizon_label="h06").collect()} == {last}
    with pytest.raises(run_store.RunConflict):
        broken.publish()
    assert seen() == {("1", "h01", 1.0), ("1", "h06", 7.0), ("m", "h01", 3.0)}
    with pytest.raises(LookupError):
        seen(model="new")


def test_tables_of_a_run_are_published_together(spark, tmp_path):
    path = str(tmp_path / "runs")
    schema = "horizon_label string, mae double"
    for value in (1.5, 2.5):
        run = run_store.begin_run(spark, path)
        metrics = spark.createDataFrame([("h01", value), ("h06", None)], schema)
        write_metrics(metrics, f"{path}/metrics", f"attempt={run.attempt}")
        write_per_horizon(metrics.drop("horizon_label").limit(1), "h01", run.folder("scalers"))
        run.add("metrics/csv")
        run.add("metrics/json")
        run.add("scalers", horizon_label="h01")
        if value < 2:
            run.publish()
    # the second attempt wrote all of its tables, but no manifest
    for name in ("metrics/csv", "metrics/json"):
        got = {(r["horizon_label"], r["mae"]) for r in run_store.read_run(spark, path, name, schema=schema).collect()}
        assert got == {("h01", 1.5), ("h06", None)}, name
    assert [r["mae"] for r in run_store.read_run(spark, path, "scalers").collect()] == [1.5]
    assert {r["name"] for r in run_store.current_entries(spark, path).collect()} == {"metrics/csv", "metrics/json", "scalers"}
