from __future__ import annotations

import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import START, series
from pyspark.sql import Window
from pyspark.sql import functions as F

from stationcast.functions.names import rolling_column
from stationcast.operators import windows
from stationcast.operators.buckets import bucket_offsets, rank_boundaries, with_position, with_running_sum
from stationcast.operators.features import make_supervised, select_feature_columns, select_sequence_columns
from stationcast.operators.grid import insert_gaps, off_axis_rows, off_grid_report, resample
from stationcast.operators.prepare import prepare_series


def frame(df, *order):
    return df.orderBy(*(order or ("station_id", "ts_utc"))).toPandas()


def noisy(n, seed=1, holes=0.1):
    rng = random.Random(seed)
    return [None if rng.random() < holes else round(rng.uniform(-5, 5), 2) for _ in range(n)]


def test_gap_insertion_marks_the_missing_row(spark, station):
    rows = frame(insert_gaps(station.where(F.col("ts_utc") != START + timedelta(minutes=50)), 600))
    assert len(rows) == 220 and rows["gap"].sum() == 1 and bool(rows["gap"][5]) and np.isnan(rows["temp_c"][5])


def test_axis_over_many_buckets_and_phases(spark):
    a = series(spark, range(50), "a", start=START + timedelta(minutes=3)).where(F.pmod(F.col("temp_c"), F.lit(7)) < 3)
    b = series(spark, range(3), "b")
    rows = frame(insert_gaps(a.unionByName(b), 600, bucket_steps=4))
    assert rows.groupby("station_id").size().to_dict() == {"a": 50, "b": 3}
    assert (rows["gap"] == rows["temp_c"].isna()).all()
    assert rows[rows.station_id == "a"]["temp_c"].dropna().tolist() == [v for v in range(50) if v % 7 < 3]


def test_a_stray_first_row_does_not_move_the_axis(spark):
    stray = series(spark, [99], start=START - timedelta(minutes=7))
    df = series(spark, range(20)).unionByName(stray)
    assert insert_gaps(df, 600).where("not gap").count() == 20
    kept = insert_gaps(df, 600, keep_off_axis=True)
    assert kept.count() == 21 and kept.where("off_axis").first()["ts_utc"] == START - timedelta(minutes=7)
    assert off_axis_rows(df, 600).count() == 1


def test_off_grid_rows_are_reported_and_left_out(spark):
    extra = series(spark, [99], start=START + timedelta(minutes=5))
    df = series(spark, range(4)).unionByName(extra)
    assert off_grid_report(df, 600).first().asDict() == {"station_id": "s1", "rows": 5, "off_grid_rows": 1}
    assert insert_gaps(df, 600).count() == 4


@pytest.mark.parametrize("bucket", [9, 25, 1000])
def test_lags_leads_and_rolling_equal_pandas(spark, bucket):
    values = noisy(120)
    df = series(spark, values).unionByName(series(spark, noisy(40, 2), "s2"))
    out = windows.lag_features(df, ["temp_c"], [1, 6], 600, bucket_steps=bucket)
    out = windows.horizon_targets(out, "temp_c", [1, 4], 600, bucket_steps=bucket)
    out = windows.rolling_features(out, ["temp_c"], [3, 6, 7, 24], 600, min_periods=2, bucket_steps=bucket)
    got = frame(out.where("station_id = 's1'"))
    s = pd.Series(values, dtype=float)
    for n in (1, 6):
        np.testing.assert_allclose(got[f"temp_c_lag{n}"], s.shift(n))
    for h in (1, 4):
        np.testing.assert_allclose(got[f"temp_c_t+{h}"], s.shift(-h))
    for w in (3, 6, 7, 24):
        rolled = s.shift(1).rolling(w, min_periods=2)
        for stat in windows.STATS:
            np.testing.assert_allclose(got[rolling_column("temp_c", w, stat)], getattr(rolled, stat)(), atol=1e-9)


@pytest.mark.parametrize("bucket", [53, 1000])
def test_long_windows_of_any_length_equal_pandas(spark, bucket):
    """Put together from blocks, whose edges no bucket edge has to meet; rows missing and values far from zero."""
    values = [None if i % 11 == 3 or 60 < i < 130 else v and v + 1e6 for i, v in enumerate(noisy(300))]
    df = series(spark, values).unionByName(series(spark, noisy(20, 2), "s2"))
    lengths = [29, 53, 61]
    out = windows.rolling_features(df, ["temp_c"], [5, *lengths, 2 * 29], 600, min_periods=2, bucket_steps=bucket)
    for station, own in (("s1", values), ("s2", noisy(20, 2))):
        got = frame(out.where(f"station_id = '{station}'"))
        s = pd.Series(own, dtype=float)
        for w in (5, *lengths, 58):
            rolled = s.shift(1).rolling(w, min_periods=2)
            for stat in windows.STATS:
                want = rolled.apply(np.nanstd, kwargs={"ddof": 1}, raw=True) if stat == "std" else getattr(rolled, stat)()
                np.testing.assert_allclose(got[rolling_column("temp_c", w, stat)], want, atol=1e-7)


def test_long_windows_shuffle_once(spark):
    df = series(spark, noisy(50))
    plan = windows.rolling_features(df, ["temp_c"], [29, 31], 600)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_full_window_is_the_default(spark):
    got = frame(windows.rolling_features(series(spark, [1, 2, None, 4, 5, 6, 7]), ["temp_c"], [3], 600, stats=["mean"]))
    assert got["temp_c_roll3_mean"].dropna().tolist() == [5.0]


def test_flat_series_has_no_spread_and_is_flagged(spark):
    df = series(spark, [7.1] * 80)
    got = frame(windows.rolling_features(df, ["temp_c"], [6, 18, 36], 600, stats=["std"]))
    assert got["temp_c_roll36_std"].dropna().abs().max() < 1e-12
    flat = frame(windows.qc_flatline(df, ["temp_c"], 600))["qc_flatline_temp_c"]
    assert not flat[:17].any() and flat[17:].all()


def test_a_dry_gauge_is_not_stuck(spark):
    df = series(spark, [0.0] * 40, column="rain_mm")
    assert not frame(windows.qc_flatline(df, ["rain_mm"], 600))["qc_flatline_rain_mm"].any()


def test_spike(spark):
    values = [10 + 0.1 * (i % 3) for i in range(30)]
    values[20] = 25.0
    flags = frame(windows.qc_spike(series(spark, values), ["temp_c"], 600))["qc_spike_temp_c"]
    assert flags[20] and flags.sum() == 1


def test_positions_and_running_sums_across_buckets(spark):
    rng = random.Random(3)
    minutes = sorted(rng.sample(range(100_000), 300))
    rows = [("k", START + timedelta(minutes=m), rng.randint(0, 5)) for m in minutes]
    df = spark.createDataFrame(rows, "station_id string, ts_utc timestamp, v int").repartition(7)
    got = frame(with_position(df, "station_id", "ts_utc", bucket_seconds=3_600))
    assert got["position"].tolist() == list(range(1, 301))
    summed = frame(with_running_sum(df, "station_id", "ts_utc", F.col("v"), "total", bucket_seconds=86_400))
    assert summed["total"].tolist() == np.cumsum([r[2] for r in rows]).tolist()


def test_offsets_over_several_chunks(spark):
    buckets = spark.range(0, 20_000, 7).select(F.lit("k").alias("k"), F.col("id").alias("b"), F.lit(2).alias("n"))
    got = bucket_offsets(buckets, ["k"], "b", ["n"]).orderBy("b").toPandas()
    assert got["n_before"].tolist() == [2 * i for i in range(len(got))]


def test_rank_boundaries(spark):
    df = series(spark, range(101)).unionByName(series(spark, range(5), "s2"))
    n = F.col("n")
    got = frame(rank_boundaries(df, "station_id", "ts_utc", {"a": F.lit(1), "b": n, "c": F.lit(50)}, 3_600), "station_id")
    assert got["n"].tolist() == [101, 5]
    assert got["b"].tolist() == [START + timedelta(minutes=1000), START + timedelta(minutes=40)]
    assert got["c"][0] == START + timedelta(minutes=490) and pd.isna(got["c"][1])


def test_prepared_columns(station):
    out = prepare_series(station, 600, [6])
    assert {
        "gap", "qc_any", "qc_consistency", "hour_sin", "doy_cos", "wdir_sin", "temp_c_roll6_mean", "wdir_sin_roll6_max",
        "dew_point_c", "vpd_kpa", "heat_index_c", "wind_chill_c", "wdir_deg",
    } <= set(out.columns)
    assert out.count() == 220


def test_prepared_series_keeps_or_snaps_rows_off_the_axis(spark, station):
    """A logger whose phase changes half-way: no row vanishes, and snapping makes one series of both halves."""
    half = START + timedelta(minutes=10 * 120)
    late = F.when(F.col("ts_utc") >= half, F.col("ts_utc") + F.expr("INTERVAL 3 MINUTES")).otherwise(F.col("ts_utc"))
    shifted = station.withColumn("ts_utc", late)
    kept = prepare_series(shifted, 600, [6])
    assert kept.where("off_axis").count() == 100 and kept.where("not off_axis and not gap").count() == 120
    assert kept.where("off_axis and temp_c_roll6_mean is not null").count() == 0
    assert kept.where("off_axis and (gap or temp_c is null or dew_point_c is null)").count() == 0
    on = prepare_series(shifted.where(F.col("ts_utc") < half), 600, [6])
    pd.testing.assert_frame_equal(frame(kept.where("not off_axis")), frame(on))
    assert make_supervised(kept, "temp_c", [1], [1], 600).count() == make_supervised(on, "temp_c", [1], [1], 600).count()
    snapped = prepare_series(shifted, 600, [6], off_axis="snap")
    pd.testing.assert_frame_equal(frame(snapped), frame(prepare_series(station, 600, [6])))


def test_snapping_loses_no_row(spark):
    stray = series(spark, [-1.0, -2.0, -3.0, -4.0], start=START + timedelta(minutes=4)).unionByName(series(spark, [-5.0], start=START + timedelta(minutes=42)))
    df = series(spark, [0.0, 1.0, 2.0, None, 4.0, 5.0, 6.0]).where("temp_c is not null").unionByName(stray)
    df = df.unionByName(df.limit(1).withColumn("ts_utc", F.lit(None).cast("timestamp")))
    out = prepare_series(df, 600, [2], off_axis="snap")
    assert out.where("not gap").count() == 12
    at = {r["ts_utc"]: (r["temp_c"], r["off_axis"]) for r in out.collect()}
    assert at[START + timedelta(minutes=30)] == (-4.0, False)  # the only free step
    assert sum(off for _, off in at.values()) == 5


def test_default_feature_count_is_the_documented_one(station):
    """All ten variables, default lags and windows: 1,632 tabular features."""
    prepared = prepare_series(station, 600, [6, 18, 36, 144])
    lags = (1, 3, 6, 12, 24, 72, 144)
    wide = make_supervised(prepared, "temp_c", [72], lags, 600)
    assert len(select_feature_columns(wide, "temp_c_t+72", not_features=["station_id"])) == 1632


def test_no_feature_sees_the_future(spark, station):
    cut = START + timedelta(minutes=10 * 120)
    masked = station.select(
        "station_id", "ts_utc",
        *[F.when(F.col("ts_utc") <= cut, F.col(c)).alias(c) for c in station.columns if c not in ("station_id", "ts_utc")],
    )
    before = lambda df: frame(
        make_supervised(prepare_series(df, 600, [6, 18]), "temp_c", [], [1, 3], 600, drop_incomplete=False).where(F.col("ts_utc") <= cut)
    )
    pd.testing.assert_frame_equal(before(station), before(masked))


def test_results_do_not_depend_on_partitioning(spark, station):
    def run(partitions, bucket):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            return frame(prepare_series(station.repartition(partitions), 600, [6, 18], bucket_steps=bucket))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    first = run(1, 10_000)
    for partitions, bucket in ((8, 40), (64, 25)):
        pd.testing.assert_frame_equal(first, run(partitions, bucket), check_exact=False, rtol=1e-9, atol=1e-9)


def test_window_over_a_hot_station_is_split(spark):
    df = series(spark, range(500))
    out = windows.lag_features(df, ["temp_c"], [1], 600, bucket_steps=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(station_id" in plan and "_bucket" in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_supervised_alignment_and_feature_rules(spark):
    df = series(spark, range(30)).withColumn("rh_pct", F.col("temp_c") * 2).withColumn("gap", F.lit(False)).withColumn("qc_any", F.lit(False))
    out = make_supervised(df, "temp_c", [1], [1, 3], 600)
    first = frame(out).iloc[0]
    assert (first["temp_c"], first["temp_c_t+1"], first["temp_c_lag3"], first["rh_pct_lag3"]) == (3.0, 4.0, 0.0, 0.0)
    assert out.count() == 26
    features = select_feature_columns(out, "temp_c_t+1")
    assert features == ["temp_c", "rh_pct", "qc_any", "temp_c_lag1", "rh_pct_lag1", "temp_c_lag3", "rh_pct_lag3"]
    assert select_sequence_columns(out, "temp_c_t+1") == ["temp_c", "rh_pct", "qc_any"]
    assert select_sequence_columns(out, "temp_c_t+1", exclude_lags=False) == features
    assert select_sequence_columns(out, "temp_c_t+1", allow_list=["rh_pct", "temp_c"]) == ["rh_pct", "temp_c"]
    with pytest.raises(ValueError, match="missing"):
        select_sequence_columns(out, "temp_c_t+1", allow_list=["nope"])
    with pytest.raises(ValueError, match="no numeric"):
        select_feature_columns(out.select("station_id", "gap", "`temp_c_t+1`"), "temp_c_t+1")
    with pytest.raises(ValueError, match="target"):
        make_supervised(df, "nope", [1], [1], 600)


def test_resample_rules(spark):
    rows = [("s1", START + timedelta(minutes=10 * i), float(i), 1.0, float(i), d, i == 0) for i, d in enumerate([350.0, 10.0, 90.0])]
    df = spark.createDataFrame(rows, "station_id string, ts_utc timestamp, temp_c double, rain_mm double, gust_ms double, wdir_deg double, gap boolean")
    got = frame(resample(df, 1200))
    assert got["temp_c"].tolist() == [0.5, 2.0] and got["rain_mm"].tolist() == [2.0, 1.0] and got["gust_ms"].tolist() == [1.0, 2.0]
    assert min(got["wdir_deg"][0], 360 - got["wdir_deg"][0]) == pytest.approx(0.0, abs=1e-9)
    assert got["gap"].tolist() == [False, False]
    last = frame(resample(df, 1200, how={"temp_c": "last"}))
    assert last["temp_c"].tolist() == [1.0, 2.0]


def test_gaps_are_inserted_where_the_rows_are(spark):
    """The axis is neither shuffled nor sorted, rows that share a time all stay, rows without a key do not match."""
    rows = series(spark, [1, None, None, 4, 4.5, 6], "a").where("temp_c is not null")
    twice = rows.unionByName(rows.where("temp_c = 4")).unionByName(series(spark, [9, 9, 9], None).where("temp_c > 0"))
    gaps = insert_gaps(twice, 600, bucket_steps=2)
    got = frame(gaps.where("station_id is not null"), ["ts_utc", "temp_c"])
    assert got["temp_c"].fillna(-1).tolist() == [1, -1, -1, 4, 4, 4.5, 6] and got["gap"].tolist() == [False, True, True, False, False, False, False]
    assert gaps.where("station_id is null and gap and temp_c is null").count() == 3
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence(_s" in plan and "Exchange" not in plan[: plan.index("Generate explode(sequence(_s")]


def test_long_windows_sort_once_and_equal_plain_means(spark):
    """Series of many lengths and buckets, with infinities and not-a-number in windows; one sort for all windows."""
    parts = [series(spark, noisy(n, n), f"s{n}") for n in (1, 2, 30, 31, 95, 200)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.unionByName(series(spark, [1.0, float("nan"), 3.0, None, float("inf"), *range(60)], "odd"))
    for bucket in (40, 1000):
        rolled = windows.rolling_features(df, ["temp_c"], [29, 31, 62], 600, min_periods=1, bucket_steps=bucket)
        plan = rolled._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort") == 1 and "Window" not in plan
        got = frame(rolled)
        assert len(got) == df.count()
        for name, rows in got.groupby("station_id"):
            values = rows["temp_c"].to_numpy()
            for w in (29, 31, 62):
                for i in range(len(values)):
                    seen = values[max(0, i - w) : i]
                    if name != "odd":
                        seen = seen[~np.isnan(seen)]
                        want = [seen.mean(), seen.min(), seen.max()] if len(seen) else [np.nan] * 3
                        found = [rows[rolling_column("temp_c", w, s)].iloc[i] for s in ("mean", "min", "max")]
                        np.testing.assert_allclose(found, want, atol=1e-9)
        odd = got[got.station_id == "odd"].reset_index()
        assert np.isnan(odd["temp_c_roll29_max"][5]) and odd["temp_c_roll29_min"][5] == 1.0
        assert odd["temp_c_roll29_mean"][34] == np.mean(range(29)) and odd["temp_c_roll29_max"][34] == 28
