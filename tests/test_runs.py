from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from conftest import START
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from stationcast.operators import compare, experiment, runs
from stationcast.operators.experiment import ExperimentOptions, run_experiment
from stationcast.operators.prepare import prepare_series
from stationcast.plans import catalog
from stationcast.sources import run_store

METRICS = "target string, horizon_label string, horizon_steps int, model string, model_family string, mae double, rmse double, mape double, n_test long, skill_score_persistence double"


def row(model, family, horizon, steps, mae):
    return ("temp_c", horizon, steps, model, family, mae, mae * 1.2, mae * 5.0, 20, 0.0)


@pytest.fixture(scope="module")
def pair(spark):
    base = [
        row(m, f, h, s, v)
        for m, f, a, b in (
            ("persistence", "baseline", 0.25, 0.78), ("moving_average", "baseline", 0.6, 1.03),
            ("linear_regression", "ml", 0.4, 0.5), ("random_forest", "ml", 0.26, 0.62), ("svr", "ml", 0.67, 0.7),
            ("lstm", "dl", 0.86, 0.98),
        )
        for h, s, v in (("m10", 1, a), ("h01", 6, b))
    ]
    delta = [row(m, f, h, s, v) for m, f, a, b in (("ridge", "ml", 0.27, 0.70), ("lstm", "dl", 0.55, 0.60)) for h, s, v in (("m10", 1, a), ("h01", 6, b))]
    return spark.createDataFrame(base, METRICS), spark.createDataFrame(delta[:-1], METRICS)


ROSTER = ["persistence", "moving_average", "ridge", "random_forest", "gru", "lstm"]


def test_merge_prefers_delta_and_drops_other_models(pair):
    merged = runs.merge_metrics(*pair, ROSTER).collect()
    got = {(r["model"], r["horizon_label"]): r["mae"] for r in merged}
    assert got[("lstm", "m10")] == 0.55 and ("lstm", "h01") not in got
    assert not {m for m, _ in got} & {"svr", "linear_regression"}
    assert got[("random_forest", "h01")] == 0.62 and got[("ridge", "m10")] == 0.27
    assert [r["horizon_steps"] for r in merged] == sorted(r["horizon_steps"] for r in merged)
    finer = {(r["model"], r["horizon_label"]): r["mae"] for r in runs.merge_metrics(*pair, ROSTER, "model_horizon").collect()}
    assert finer[("lstm", "h01")] == 0.98
    assert runs.merge_metrics(pair[0], None, ROSTER).count() == 8
    assert runs.merge_metrics(None, pair[1], ROSTER).count() == 3
    with pytest.raises(ValueError, match="neither run"):
        runs.merge_metrics(None, None, ROSTER)


def test_provenance_and_horizons(spark, pair):
    base, delta = pair
    horizons = runs.discover_horizons(base, delta)
    assert [r["horizon_label"] for r in horizons.orderBy("horizon_order").collect()] == ["h01", "m10"]
    empty = base.limit(0)
    assert runs.discover_horizons(empty, empty).count() == 6
    got = {(r["model"], r["horizon_label"]): r["source"] for r in runs.artifact_provenance(ROSTER, horizons, base, delta).collect()}
    assert got[("lstm", "m10")] == "delta" and got[("lstm", "h01")] == "baseline" and got[("gru", "m10")] == "missing"
    assert len(got) == 12
    kinds = lambda *k: spark.createDataFrame([("r", x) for x in k], "run_id string, kind string")
    shared = runs.shared_provenance(kinds("configs", "scalers"), kinds("scalers"), ["configs", "scalers", "interim"])
    assert {r["category"]: r["source"] for r in shared.collect()} == {"configs": "baseline", "scalers": "delta", "interim": "missing"}
    assert {(r["kind"], r["items"]) for r in runs.run_inventory(kinds("a", "a", "b")).collect()} == {("a", 2), ("b", 1)}


def test_split_verification(spark):
    schema = "horizon_label string, train_start string, train_end string, test_start string, test_end string, n_train int, n_test int"
    base = spark.createDataFrame([("h01", "a", "b", "c", "d", 1, 2), ("h06", "a", "b", "c", "d", 1, 2)], schema)
    delta = spark.createDataFrame([("h01", "a", "x", "c", None, 1, 2)], schema)
    got = {(r["field"], r["baseline"], r["delta"]) for r in runs.verify_splits(base, delta).collect()}
    assert got == {("train_end", "b", "x"), ("test_end", "d", None)}


def predicted(spark, times, model="m", values=None):
    rows = [("s1", model, "h01", t, float(i), float(values[i] if values is not None else i)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "station_id string, model string, horizon_label string, ts_utc timestamp, y_true double, y_pred double")


def test_sample_is_the_middle_of_the_largest_block(spark):
    early = [datetime(2025, 12, 1) + timedelta(minutes=10 * i) for i in range(4)]
    late = [datetime(2026, 2, 10) + timedelta(minutes=10 * i) for i in range(12)]
    out = compare.plot_sample(predicted(spark, early + late), max_points=6).orderBy("ts_utc").collect()
    assert [r["ts_utc"] for r in out] == late[3:9] and {r["sample_label"] for r in out} == {"2026-02-10"}
    best = compare.largest_segment(predicted(spark, early + late)).first()
    assert (best["segment_start"], best["rows"]) == (late[0], 12)
    tie = compare.largest_segment(predicted(spark, early + late[:4])).first()
    assert tie["segment_start"] == early[0]


def test_segments_across_buckets(spark):
    times, t = [], START
    for i in range(60):
        t += timedelta(minutes=200 if i % 9 == 8 else 30)
        times.append(t)
    got = [r["segment_id"] for r in compare.segments(predicted(spark, times), bucket_seconds=3_600).orderBy("ts_utc").collect()]
    assert got == [(i + 1) // 9 for i in range(60)]


def test_explicit_window(spark):
    df = predicted(spark, [datetime(2026, 2, 15) + timedelta(hours=i) for i in range(72)])
    out = compare.plot_sample(df, start="2026-02-16", end="2026-02-17 23:59:59").orderBy("ts_utc").collect()
    assert out[0]["ts_utc"] == datetime(2026, 2, 16) and out[-1]["ts_utc"] == datetime(2026, 2, 17, 23)
    assert out[0]["sample_label"] == "2026-02-16 to 2026-02-17"
    with pytest.raises(ValueError, match="no prediction rows"):
        compare.window_filter(df, "2026-03-01", "2026-03-02", require_rows=True)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=300)
    df = predicted(spark, [START + timedelta(hours=i) for i in range(300)], values=np.arange(300) + values)
    got = {r["bin"]: r["count"] for r in compare.residual_histogram(df, 40).collect()}
    residual = (np.arange(300) + values) - np.arange(300)
    counts, edges = np.histogram(residual, bins=40)
    assert [got.get(i, 0) for i in range(40)] == counts.tolist()
    flat = compare.residual_histogram(predicted(spark, [START, START + timedelta(hours=1)]), 4).first()
    assert (flat["lo"], flat["hi"], flat["count"]) == (0.0, 0.25, 2)
    assert compare.residual_bias(df).first()["bias"] == pytest.approx(residual.mean())


@pytest.mark.parametrize("n", [50, 1_500, 5_000])
def test_first_points_and_seeded_sample(spark, n):
    df = spark.range(3_000).select(
        F.lit("s1").alias("station_id"), F.lit("m").alias("model"), F.lit("h01").alias("horizon_label"),
        F.timestamp_seconds(F.col("id") * 600).alias("ts_utc"), F.col("id").cast("double").alias("y_true"),
    )
    assert compare.first_points(df, n).agg(F.count("*"), F.max("point"), F.max("y_true")).first()[:] == (min(n, 3000), min(n, 3000), min(n, 3000) - 1.0)
    one = {r["y_true"] for r in compare.seeded_sample(df, n).collect()}
    two = {r["y_true"] for r in compare.seeded_sample(df.repartition(9), n).collect()}
    assert one == two and len(one) == min(n, 3000)
    if n < 3000:
        assert one != {r["y_true"] for r in compare.seeded_sample(df, n, seed=7).collect()}


def test_labels_follow_the_target(spark, pair):
    one = pair[0].withColumn("target", F.lit("rh_pct"))
    assert compare.target_labels(one).first()[:] == ("rh_pct", "Relative humidity", "%RH")
    two = one.unionByName(pair[0])
    assert compare.target_labels(two).first()[:] == (None, "Target value", None)
    assert compare.best_per_family(pair[0], ["m10"]).where("model_family = 'ml'").first()["model"] == "random_forest"


def test_experiment_writes_everything(spark, station, tmp_path):
    options = ExperimentOptions(
        horizons={"m10": 1, "h01": 6}, optional_horizons={}, lags=(1, 3), ml=("ridge", "linear_regression", "random_forest")
    )
    prepared = prepare_series(station, 600, [6], derived_metrics=["dew_point"])
    metrics = run_experiment(prepared, options, str(tmp_path / "run")).collect()
    assert len(metrics) == 12 and all(np.isfinite(r["mae"]) for r in metrics)
    assert {r["skill_score_persistence"] for r in metrics if r["model"] == "persistence"} == {0.0}
    for name in ("predictions", "split_metadata", "scalers", "target_scalers", "metrics/csv", "metrics/json"):
        assert list((Path(tmp_path) / "run" / name).rglob("*part-*")), name
    again = run_experiment(prepared, options, str(tmp_path / "run")).collect()
    assert sorted(map(str, again)) == sorted(map(str, metrics))
    h01 = {r["model"]: r["n_test"] for r in metrics if r["horizon_label"] == "h01"}
    assert len(set(h01.values())) == 1


def test_failed_experiment_leaves_the_one_before(spark, station, tmp_path, monkeypatch):
    options = ExperimentOptions(horizons={"m10": 1}, optional_horizons={}, lags=(1,), baselines=("persistence",), ml=("linear_regression",))
    path = str(tmp_path / "run")
    columns = ["station_id", "ts_utc", "temp_c", "rh_pct"]
    metrics = run_experiment(station.select(*columns), options, path).collect()
    before = sorted(map(str, run_store.read_run(spark, path, "predictions").collect()))
    assert {r["model"] for r in run_store.read_run(spark, path, "metrics/json").collect()} == {"persistence", "linear_regression"}

    # the stored model, applied to the stored scaler's columns, is the one that made the predictions
    model = run_store.read_run(spark, path, "models", model="linear_regression").first()
    assert len(model["features"]) == len(model["coefficients"]) and model["station_id"] == "s1"

    def fails(*_):
        raise OSError("disk is gone")

    monkeypatch.setattr(experiment, "write_metrics", fails)
    with pytest.raises(OSError, match="disk is gone"):
        run_experiment(station.select(*columns).withColumn("temp_c", F.col("temp_c") * 2), options, path)
    assert sorted(map(str, run_store.read_run(spark, path, "predictions").collect())) == before
    got = {(r["model"], r["mae"]) for r in run_store.read_run(spark, path, "metrics/json").collect()}
    assert got == {(r["model"], r["mae"]) for r in metrics}


def test_option_checks():
    with pytest.raises(ValueError, match="sum to 1"):
        ExperimentOptions(train=0.5)
    with pytest.raises(ValueError, match="unknown models"):
        ExperimentOptions(ml=("svr",))
    merged = ExperimentOptions(horizons={"a": 6}, optional_horizons={"a": 9, "b": 1}).resolved_horizons()
    assert list(merged.items()) == [("b", 1), ("a", 6)]


def test_entry_and_registry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and {r["model"] for r in rows} == {"persistence"}
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    # what the library itself registers, whether or not further queries are present
    assert set(catalog.QUERIES) <= set(entry_points.queries()) and len(catalog.QUERIES) >= 90
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {
        "seeded_sample", "ridge_cv", "linear_regression", "random_forest", "gradient_boosting", "batch_scoring",
    }


def test_shared_folder_is_named_or_local(spark):
    from types import SimpleNamespace

    from stationcast.session import shared_dir

    def session(master, named):
        conf = SimpleNamespace(get=lambda key, default=None: named)
        context = SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: conf)
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert shared_dir(session("spark://host:7077", "hdfs://shared/")) == "hdfs://shared"
    assert shared_dir(session("local[2]", None)) == shared_dir(session("local[2]", None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master, None))
