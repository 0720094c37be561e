from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import START, series
from pyspark.sql import functions as F

from stationcast.functions.scoring import skill
from stationcast.operators import baselines, evaluate, linear, scaling, sequences, splits, trees
from stationcast.operators.features import feature_matrix, stack_horizons


def frame(df, *order):
    return df.orderBy(*(order or ("station_id", "ts_utc"))).toPandas()


# --- splits -----------------------------------------------------------------


@pytest.mark.parametrize("bucket", [1_800, 30 * 86_400])
def test_split_is_chronological(spark, bucket):
    df = series(spark, range(100)).unionByName(series(spark, range(40), "s2"))
    got = frame(splits.chronological_split(df, bucket_seconds=bucket))
    one = got[got.station_id == "s1"]["split"].tolist()
    assert one == ["train"] * 70 + ["val"] * 15 + ["test"] * 15
    assert got[got.station_id == "s2"]["split"].value_counts().to_dict() == {"train": 28, "val": 6, "test": 6}


def test_empty_parts(spark):
    tiny = series(spark, range(3))
    with pytest.raises(Exception, match="empty train"):
        splits.chronological_split(tiny).collect()
    kept = splits.chronological_split(tiny, on_empty="keep")
    assert kept.count() == 3
    with pytest.raises(ValueError, match="fractions"):
        splits.split_boundaries(tiny, 0.8, 0.2)


@pytest.mark.parametrize(("n", "folds"), [(47, 5), (12, 5), (6, 5), (3, 5), (2, 5), (20, 3)])
def test_folds_follow_the_expanding_rule(spark, n, folds):
    got = frame(splits.time_series_folds(series(spark, range(n)), folds))
    k = min(max(2, folds), max(2, n - 1))
    if n <= k:
        assert got["n_folds"].isna().all()
        return
    size = n // (k + 1)
    assert set(got["n_folds"]) == {k}
    for fold in range(1, k + 1):
        start = n - (k - fold + 1) * size
        assert np.flatnonzero(got["fold_block"] == fold).tolist() == list(range(start, start + size))


def test_split_metadata(spark):
    df = splits.chronological_split(series(spark, range(20)))
    row = splits.split_metadata(df, "temp_c_t+1", ["temp_c"]).first()
    assert (row["n_train"], row["n_validation"], row["n_test"]) == (14, 3, 3)
    assert row["train_start"] == START and row["test_end"] == START + timedelta(minutes=190)
    assert row["feature_columns"] == ["temp_c"]


# --- scalers ----------------------------------------------------------------


@pytest.mark.parametrize("method", scaling.METHODS)
def test_scaler_uses_train_rows_only_and_inverts(spark, method):
    values = list(np.linspace(-5, 35, 70)) + [500.0] * 30
    df = splits.chronological_split(series(spark, values))
    params = scaling.fit_scaler(df, ["temp_c"], method)
    scaled = scaling.apply_scaler(df, params, ["temp_c"])
    train = frame(scaled.where("split = 'train'"))["temp_c"]
    expected = {
        "standard": (np.mean(values[:70]), np.std(values[:70])),
        "minmax": (-5.0, 40.0),
        "robust": (15.0, np.percentile(values[:70], 75) - np.percentile(values[:70], 25)),
    }[method]
    np.testing.assert_allclose(train, (np.array(values[:70]) - expected[0]) / expected[1], atol=1e-9)
    back = frame(scaling.inverse_scale(scaled, params, "temp_c"))["temp_c"]
    np.testing.assert_allclose(back, values, atol=1e-6)


def test_scaler_errors_and_flat_columns(spark):
    df = series(spark, [3.0] * 5)
    with pytest.raises(ValueError, match="unsupported"):
        scaling.fit_scaler(df, ["temp_c"], "other", split=None)
    params = scaling.fit_scaler(df, ["temp_c"], "standard", split=None)
    assert params.first()["scale"] == 1.0
    with pytest.raises(Exception, match="no parameters"):
        scaling.apply_scaler(df.withColumn("x", F.lit(1.0)), params, ["x"]).collect()
    wrong = params.withColumn("method", F.lit("other"))
    with pytest.raises(Exception, match="unsupported scaler method"):
        scaling.apply_scaler(df, wrong, ["temp_c"]).collect()


def test_quantiles_are_exact_on_skewed_values(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(400, 1.5), rng.lognormal(0, 3, 301), [1e9, -1e9]])
    rng.shuffle(values)
    got = scaling.exact_quantiles(series(spark, values), ["temp_c"], {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    for name, q in (("a", 25), ("b", 50), ("c", 90)):
        assert got[name] == pytest.approx(np.percentile(values, q), rel=1e-12)


def test_quantiles_of_any_doubles_and_keys(spark):
    rng = np.random.default_rng(6)
    columns = {
        "wide": rng.normal(size=600) * 10.0 ** rng.integers(-300, 300, 600),
        "signed": np.concatenate([rng.normal(size=300), np.zeros(150), np.full(150, -0.0)]),
        "near": 101_325 + rng.normal(size=600),  # some thousand values of one leading digit
        "ends": np.concatenate([np.full(200, -np.inf), [5e-324, -5e-324, 1.7e308], np.arange(197.0), np.full(200, np.inf)]),
        "flat": np.full(600, 7.25),
    }
    rows = [
        ("a" if i % 3 else "b", START + timedelta(minutes=i), *[None if i % 7 == 0 and c == "signed" else float(v[i]) for c, v in columns.items()], None)
        for i in range(600)
    ]
    schema = "station_id string, ts_utc timestamp, " + ", ".join(f"{c} double" for c in columns) + ", empty double"
    df = spark.createDataFrame(rows, schema)
    wanted = {"low": 0.0, "a": 0.25, "b": 0.5, "c": 0.75, "high": 1.0}
    got = {(r["station_id"], r["column"]): r for r in scaling.exact_quantiles(df, [*columns, "empty"], wanted).collect()}
    assert set(got) == {(k, c) for k in "ab" for c in columns}  # nothing for a column without values
    for (key, column), r in got.items():
        own = np.sort([row[2 + list(columns).index(column)] for row in rows if row[0] == key and row[2 + list(columns).index(column)] is not None])
        for name, q in wanted.items():
            spot = (len(own) - 1) * q
            low, high = own[int(spot)], own[min(int(spot) + 1, len(own) - 1)]
            expected = low if low == high else low + (high - low) * (spot - int(spot))
            assert r[name] == pytest.approx(expected, rel=1e-12, abs=0, nan_ok=True), (key, column, name)
    assert scaling.exact_quantiles(df.limit(0), ["near"], wanted).collect() == []


def test_quantiles_leave_the_rows_where_they_are(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 3).alias("station_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts_utc"), F.lit(3.5).alias("flat"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("even"),
    )
    out = scaling.exact_quantiles(df, ["flat", "even"], {"a": 0.25, "b": 0.5, "c": 0.75})
    got = out.collect()
    assert len(got) == 6 and {r["b"] for r in got if r["column"] == "flat"} == {3.5}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # of 400,000 values only counts of the wanted digits are moved
    assert plan.count("Exchange") - plan.count("ReusedExchange") <= 5 and "SortMergeJoin" not in plan


# --- sequences --------------------------------------------------------------


@pytest.mark.parametrize("bucket", [6, 1000])
def test_sequences_end_at_their_row(spark, bucket):
    df = series(spark, range(30)).withColumn("temp_c_t+1", F.col("temp_c") + 1).withColumn("split", F.lit("train"))
    holes = df.where(F.col("temp_c") != 11)
    out = frame(sequences.sequence_windows(holes, ["temp_c"], "temp_c_t+1", 5, bucket_seconds=3_600, bucket_steps=bucket))
    left = [v for v in range(30) if v != 11]
    assert len(out) == 25
    for i, row in out.iterrows():
        assert [s[0] for s in row["sequence"]] == left[i : i + 5] and row["label"] == left[i + 4] + 1
    targets = frame(sequences.sequence_targets(holes, "temp_c_t+1", 5))
    assert targets["label"].tolist() == out["label"].tolist()


def test_short_splits_have_no_sequences(spark):
    df = series(spark, range(6)).withColumn("y", F.col("temp_c")).withColumn("split", F.when(F.col("temp_c") < 4, "train").otherwise("test"))
    assert sequences.sequence_windows(df, ["temp_c"], "y", 4).count() == 1
    with pytest.raises(ValueError, match="positive"):
        sequences.sequence_windows(df, ["temp_c"], "y", 0)
    with pytest.raises(ValueError, match="missing"):
        sequences.sequence_windows(df, ["nope"], "y", 2)


# --- baselines and metrics --------------------------------------------------


def test_climatology_mirrors_the_daily_wave(spark):
    wave = [10 + 5 * math.sin(h % 24 / 24 * 2 * math.pi) for h in range(72)]
    df = series(spark, wave[:48] + [0.0] * 24, minutes=60)
    df = df.withColumn("split", F.when(F.col("ts_utc") < START + timedelta(hours=48), "train").otherwise("test"))
    out = frame(baselines.climatology(df, baselines.fit_climatology(df, "temp_c")).where("split = 'test'"))
    np.testing.assert_allclose(out["y_pred"], wave[48:], atol=1e-9)
    short = df.where(F.hour("ts_utc") < 12)
    unseen = baselines.climatology(df, baselines.fit_climatology(short, "temp_c")).where(F.hour("ts_utc") == 20)
    assert unseen.first()["y_pred"] == pytest.approx(np.mean([v for i, v in enumerate(wave[:48]) if i % 24 < 12]))


def test_moving_average_picks_its_columns(spark):
    row = spark.createDataFrame([(1.0, 2.0, 3.0, None, 9.0)], "t_lag1 double, t_lag12 double, t_lag3 double, t_lag6 double, t_roll18_mean double")
    lags = row.drop("t_roll18_mean")
    assert lags.select(baselines.moving_average(lags.columns, "t").alias("p")).first()["p"] == 2.0
    assert row.select(baselines.moving_average(row.columns, "t").alias("p")).first()["p"] == 9.0
    with pytest.raises(ValueError, match="no lag"):
        baselines.moving_average(["t"], "t")
    with pytest.raises(ValueError, match="persistence"):
        baselines.persistence(["x"], "t")


def scored(spark, pairs, **extra):
    rows = [("s1", START + timedelta(hours=i), t, p) for i, (t, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "station_id string, ts_utc timestamp, y_true double, y_pred double")


def test_hand_computed_errors(spark):
    row = evaluate.evaluate_predictions(scored(spark, [(1.0, 1.0), (2.0, 4.0), (3.0, 2.0)])).first()
    assert row["mae"] == 1.0 and row["rmse"] == pytest.approx(math.sqrt(5 / 3)) and row["n_test"] == 3
    near_zero = evaluate.evaluate_predictions(scored(spark, [(0.0, 1.0), (10.0, 8.0)])).first()
    assert near_zero["mape"] == pytest.approx(20.0)
    assert evaluate.evaluate_predictions(scored(spark, [(0.0, 1.0)])).first()["mape"] is None


def test_only_finite_pairs_count(spark):
    pairs = [(1.0, 2.0), (None, 2.0), (1.0, float("nan")), (float("inf"), 1.0)]
    row = evaluate.evaluate_predictions(scored(spark, pairs)).first()
    assert (row["mae"], row["n_test"]) == (1.0, 4)
    bad = scored(spark, pairs[1:])
    with pytest.raises(Exception, match="no finite values"):
        evaluate.evaluate_predictions(bad).collect()
    assert evaluate.evaluate_predictions(bad, strict=False).first()["mae"] is None


def test_skill_anchor_per_horizon(spark):
    rows = [("h01", "persistence", 2.0), ("h01", "m", 1.0), ("h12", "persistence", 4.0), ("h12", "m", 4.0), ("h24", "m", 1.0)]
    df = spark.createDataFrame(rows, "horizon_label string, model string, rmse double")
    got = {(r["horizon_label"], r["model"]): r["skill_score_persistence"] for r in evaluate.attach_skill(df).collect()}
    assert got == {("h01", "persistence"): 0.0, ("h01", "m"): 0.75, ("h12", "persistence"): 0.0, ("h12", "m"): 0.0, ("h24", "m"): None}
    one = spark.range(1)
    for anchor in (0.0, float("nan"), float("inf"), None):
        assert one.select(skill(F.lit(2.0), F.lit(anchor).cast("double"))).first()[0] is None


def test_report_cells(spark):
    rows = [("ml", "b", "h06", 6, 1.23456, None, float("nan"), 5), ("baseline", "a", "h01", 1, 2.0, 3.0, 4.0, 5)]
    df = spark.createDataFrame(rows, "model_family string, model string, horizon_label string, horizon_steps int, mae double, rmse double, mape double, n_test long")
    report = evaluate.metrics_report(df)
    assert [list(r) for r in report.collect()] == [
        ["baseline", "a", "h01", "1", "2.0000", "3.0000", "4.0000", "5"],
        ["ml", "b", "h06", "6", "1.2346", "", "", "5"],
    ]
    assert evaluate.report_lines(report).first()["line"] == "| baseline | a | h01 | 1 | 2.0000 | 3.0000 | 4.0000 | 5 |"
    saved = evaluate.evaluate_saved(df.withColumn("skill_score_persistence", F.lit(0.5)))
    assert saved.first()["skill_score_persistence"] == "0.5000"


# --- linear models and trees ------------------------------------------------


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s, n in (("a", 130), ("b", 61), ("c", 2)):
        x = rng.normal(size=(n, 3))
        y = 2 + x @ [1.0, -0.5, 0.0] + rng.normal(scale=0.3, size=n)
        rows += [(s, START + timedelta(hours=i), *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "station_id string, ts_utc timestamp, x1 double, x2 double, x3 double, `y_t+1` double")
    return df.repartition(5).cache()


def brute_ridge(x, y, alphas=linear.RIDGE_ALPHAS, folds=5):
    def fit(a, xx, yy):
        b = yy.mean()
        return np.linalg.solve(xx.T @ xx + a * np.eye(xx.shape[1]), xx.T @ (yy - b)), b

    n = len(y)
    k = min(max(2, folds), max(2, n - 1))
    alpha, scores = alphas[-1], None
    if n > k:
        size = n // (k + 1)
        scores = []
        for a in alphas:
            errors = []
            for i in range(k):
                start = n - (k - i) * size
                w, b = fit(a, x[:start], y[:start])
                errors.append(np.sqrt(np.mean((y[start : start + size] - x[start : start + size] @ w - b) ** 2)))
            scores.append(np.mean(errors))
        alpha = alphas[int(np.argmin(scores))]
    return alpha, *fit(alpha, x, y), scores


def test_ridge_equals_brute_force_per_station(spark, regression, monkeypatch):
    monkeypatch.setattr(linear, "_HELD_BYTES", 100)  # partial sums are let go after every batch
    names = ["x1", "x2", "x3"]
    models = {r["station_id"]: r for r in linear.fit_ridge_cv(regression, names, "y_t+1").collect()}
    data = frame(regression)
    for s, rows in data.groupby("station_id"):
        alpha, w, b, scores = brute_ridge(rows[names].to_numpy(), rows["y_t+1"].to_numpy())
        m = models[s]
        assert m["alpha"] == alpha and m["n"] == len(rows)
        np.testing.assert_allclose(m["coefficients"], w, atol=1e-9)
        assert m["y_offset"] == pytest.approx(b)
        if scores is not None:
            np.testing.assert_allclose(m["cv_rmse"], scores, atol=1e-9)


def test_ols_equals_least_squares(spark, regression):
    names = ["x1", "x2", "x3"]
    rows = regression.where("station_id <> 'c'")
    models = linear.fit_ols(rows, names, "y_t+1")
    scores = frame(linear.predict_linear(rows, models, names))
    for _, part in scores.groupby("station_id"):
        x = np.column_stack([part[names].to_numpy(), np.ones(len(part))])
        w, *_ = np.linalg.lstsq(x, part["y_t+1"].to_numpy(), rcond=None)
        np.testing.assert_allclose(part["y_pred"], x @ w, atol=1e-8)


def test_linear_models_refuse_missing_values(spark):
    df = series(spark, [1.0, None, 3.0]).withColumn("y", F.lit(1.0))
    with pytest.raises(Exception, match="missing values"):
        linear.fit_ols(df, ["temp_c"], "y").collect()
    with pytest.raises(ValueError, match="alpha"):
        linear.fit_ridge_cv(df, ["temp_c"], "y", alphas=())


def wide_rows(spark, n, width, seed=0):
    """``n`` rows of ``width`` features in one column x, their label y, and both as arrays."""
    rng = np.random.default_rng(seed)
    x = rng.normal(3.0, 1.0, (n, width))
    y = x[:, :5] @ np.arange(1.0, 6.0) + rng.normal(0.0, 0.1, n)
    times = pd.date_range("2024-01-01", periods=n, freq="10min")
    pdf = pd.DataFrame({"station_id": "a", "ts_utc": times, "x": list(x), "y": y})
    return spark.createDataFrame(pdf, "station_id string, ts_utc timestamp, x array<double>, y double"), x, y


def test_gram_of_five_thousand_features(spark):
    width = 5_000
    df, x, y = wide_rows(spark, 30, width)
    gram = linear.gram_statistics(df, ["x"], "y", ["station_id"], n_features=width)
    got = gram.where("row % 1250 = 1 or row = 5000").toPandas()
    z = np.column_stack([x, y, np.ones(len(x))])
    for row, col, values in zip(got["row"], got["col"], got["values"]):
        np.testing.assert_allclose(values, z[:, row] @ z[:, col : col + len(values)], rtol=1e-12)
    # four features, the label and the row of ones, each in the tiles from the diagonal on
    assert sorted(zip(got["row"], got["col"])) == [
        (1, 0), (1, 2048), (1, 4096), (1251, 0), (1251, 2048), (1251, 4096), (2501, 2048), (2501, 4096), (3751, 2048), (3751, 4096), (5000, 4096), (5001, 4096),
    ]


def test_vectors_of_another_length_are_refused(spark):
    df, x, y = wide_rows(spark, 3, 6)
    # the last tile holds the label and the ones alone
    got = linear.gram_statistics(df, ["x"], "y", ["station_id"], tile=3, n_features=6).toPandas()
    z = np.column_stack([x, y, np.ones(3)])
    np.testing.assert_allclose(linear._square(got), z.T @ z, rtol=1e-12)
    with pytest.raises(Exception, match="missing values"):
        linear.gram_statistics(df, ["x"], "y", ["station_id"], tile=3, n_features=7).collect()


def test_ridge_and_ols_are_the_same_in_tiles(spark, monkeypatch):
    df, x, y = wide_rows(spark, 60, 40)
    names = [f"x{i}" for i in range(40)]
    df = df.select("*", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    whole = linear.fit_ridge_cv(df, names, "y").first()
    monkeypatch.setattr(linear, "_TILE", 16)
    tiled = linear.fit_ridge_cv(df, names, "y").first()
    assert tiled["alpha"] == whole["alpha"]
    np.testing.assert_allclose(tiled["coefficients"], whole["coefficients"], atol=1e-9)
    np.testing.assert_allclose(tiled["cv_rmse"], whole["cv_rmse"], rtol=1e-9)
    free = linear.fit_ols(df, names, "y").first()
    want, *_ = np.linalg.lstsq(np.column_stack([x, np.ones(60)]), y, rcond=None)
    np.testing.assert_allclose([*free["coefficients"], free["y_offset"]], want, atol=1e-8)


def test_keys_are_numbered_with_nulls():
    a, b = pa.array(["x", None, "x", "y", None]), pa.array([1, 2, 1, 1, 2])
    codes, keys = linear._key_codes([a, b], 5)
    assert [keys[c] for c in codes] == [("x", 1), (None, 2), ("x", 1), ("y", 1), (None, 2)]
    assert linear._key_codes([], 3)[1] == [()]


def test_forest_fits_saves_and_scores(spark, regression, tmp_path):
    rows = regression.where("station_id = 'a'")
    model = trees.fit_model(rows, ["x1", "x2"], "y_t+1", "random_forest", seed=1)
    trees.save_model(model, str(tmp_path / "forest"))
    first = frame(trees.score(rows, model, ["x1", "x2"]))
    again = frame(trees.score(rows, trees.load_model(str(tmp_path / "forest")), ["x1", "x2"]))
    assert first["y_pred"].tolist() == again["y_pred"].tolist()
    assert np.corrcoef(first["y_pred"], first["y_t+1"])[0, 1] > 0.9
    with pytest.raises(ValueError, match="unknown model"):
        trees.make_estimator("svr")


def test_matrix_and_stacked_horizons(spark, regression):
    out = feature_matrix(regression, ["x1", "x2"], "y_t+1", keep=["station_id"])
    assert out.columns == ["station_id", "features", "label"] and len(out.first()["features"]) == 2
    with pytest.raises(ValueError, match="not present"):
        feature_matrix(regression, ["x1"], "nope")
    df = spark.createDataFrame([("s1", START, 1.0, 2.0, None)], "station_id string, ts_utc timestamp, t double, `t_t+1` double, `t_t+6` double")
    got = stack_horizons(df, "t", {"h01": 1, "h06": 6}, ["station_id", "ts_utc", "t"]).collect()
    assert [(r["horizon_label"], r["horizon_steps"], r["y_true"]) for r in got] == [("h01", 1, 2.0)]


def test_metrics_do_not_depend_on_partitions(spark):
    from stationcast.functions import scoring
    from stationcast.operators.evaluate import evaluate_predictions

    rng = np.random.default_rng(4)
    truth = rng.normal(0, 1, 5_000) * 10.0 ** rng.integers(-6, 7, 5_000)
    rows = [(f"s{i % 3}", float(t), float(t + e)) for i, (t, e) in enumerate(zip(truth, rng.normal(0, 0.3, 5_000)))]
    rows += [("s0", float("nan"), 1.0), ("s1", 1.0, float("inf")), ("s2", None, 1.0)]
    df = spark.createDataFrame(rows, "station_id string, y_true double, y_pred double")
    found = []
    for n in (1, 7, 200):
        dealt = df.repartition(n, "y_pred")
        found.append(sorted(map(str, evaluate_predictions(dealt, ["station_id"]).collect())))
    assert found[0] == found[1] == found[2]
    values = [r[2] for r in rows if np.isfinite(r[2])]
    total = spark.createDataFrame([(v,) for v in values], "v double").agg(scoring.stable_sum(F.col("v")).alias("s")).first()["s"]
    assert total == pytest.approx(math.fsum(values), rel=1e-15)
    odd = spark.createDataFrame([(1, 2.0**100), (1, 1.0), (2, float("inf")), (3, None), (4, -0.25), (4, 2.0**-110)], "k int, v double")
    sums = {r["k"]: r["s"] for r in odd.groupBy("k").agg(scoring.stable_sum(F.col("v")).alias("s")).collect()}
    assert sums == {1: 2.0**100 + 1.0, 2: math.inf, 3: None, 4: -0.25 + 2.0**-110}


def test_shares_are_taken_as_written(spark):
    df = spark.range(300_000).select(F.lit("s1").alias("station_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts_utc"))
    cut = splits.split_boundaries(df, 0.33333, 0.1).first()
    at = {c: int((cut[c] - datetime(1970, 1, 1)).total_seconds()) // 600 + 1 for c in ("train_end", "val_end")}
    assert at == {"train_end": 99_999, "val_end": 129_999}


def test_standard_scaler_folds_in_time_order(spark):
    from stationcast.operators.scaling import fit_scaler

    rng = np.random.default_rng(5)
    values = 1013.0 + rng.normal(0, 4, 4_000)
    rows = [("s1", START + timedelta(minutes=10 * i), float(v), None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "station_id string, ts_utc timestamp, p double, none double")
    runs = [fit_scaler(df.repartition(n), ["p", "none"], split=None, ts="ts_utc").orderBy("column").collect() for n in (1, 5)]
    for none, p in runs:
        assert (none["mean"], none["scale"]) == (None, None)
        assert p["mean"] == pytest.approx(values.mean(), rel=1e-14) and p["scale"] == pytest.approx(values.std(), rel=1e-12)


def test_sequence_store_gives_the_same_windows(spark, tmp_path):
    n = 3_000
    df = spark.range(n).select(
        F.when(F.col("id") < 200, "s2").otherwise("s1").alias("station_id"),
        F.timestamp_seconds(F.col("id") * 600).alias("ts_utc"),
        *[(F.rand(i) * 100).alias(f"x{i}") for i in range(6)],
        F.col("id").cast("double").alias("y"),
    )
    df = spark.createDataFrame(df.toPandas())
    names = [f"x{i}" for i in range(6)]
    for length, rows in ((1, 50), (7, 7), (30, 64), (144, None), (250, 300)):
        path = str(tmp_path / f"store-{length}")
        sequences.write_sequence_store(df, names, "y", length, path, "station_id", chunk_rows=rows)
        order = ["station_id", "ts_utc"]
        got = sequences.read_sequence_store(spark, path).orderBy(*order).toPandas()
        want = sequences.sequence_windows(df, names, "y", length, "station_id").orderBy(*order).toPandas()
        assert len(got) == len(want) == n - 200 - length + 1 + max(0, 200 - length + 1)
        assert got["label"].tolist() == want["label"].tolist()
        for a, b in zip(got["sequence"][:: max(1, len(got) // 20)], want["sequence"][:: max(1, len(want) // 20)]):
            np.testing.assert_array_equal(np.array(list(a)).ravel(), np.concatenate([np.asarray(x) for x in b]))
    # with the default chunks a series is stored once and a little
    chunks = spark.read.parquet(str(tmp_path / "store-144") + "/chunks")
    held = chunks.select(F.sum(F.size("values"))).first()[0]
    assert held == n * 6
    long = spark.range(40_000).select(F.lit("s").alias("station_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts_utc"), F.col("id").cast("double").alias("x"))
    sequences.write_sequence_store(long, ["x"], "x", 144, str(tmp_path / "long"), "station_id")
    assert spark.read.parquet(str(tmp_path / "long/chunks")).select(F.sum(F.size("values"))).first()[0] <= 1.1 * 40_000
    some = sequences.read_sequence_store(spark, str(tmp_path / "long"), F.col("label") == 30_000.0).first()
    assert [x[0] for x in some["sequence"]] == [30_000.0 - 143 + i for i in range(144)]
    with pytest.raises(ValueError, match="whole sequence"):
        sequences.write_sequence_store(df, names, "y", 9, str(tmp_path / "no"), "station_id", chunk_rows=8)


def test_digests_see_an_exchanged_row(spark):
    from stationcast.operators import runs

    a = series(spark, range(60)).withColumn("split", F.when(F.col("temp_c") < 40, "train").otherwise("test"))
    swapped = F.when(F.col("temp_c") == 20, "test").when(F.col("temp_c") == 50, "train").otherwise(F.col("split"))
    b = a.withColumn("split", swapped)
    one, two = runs.split_digest(a), runs.split_digest(b)
    assert [r["n_rows"] for r in one.orderBy("split").collect()] == [r["n_rows"] for r in two.orderBy("split").collect()]
    assert {r["same"] for r in runs.compare_digests(one, two).collect()} == {False}
    again = runs.split_digest(a.repartition(7))
    assert {r["same"] for r in runs.compare_digests(one, again).collect()} == {True}
    assert {r["split"]: r["same"] for r in runs.compare_digests(one, again.where("split = 'test'")).collect()} == {"test": True, "train": False}


def test_stored_models_of_all_horizons(spark, tmp_path):
    from stationcast.operators import model_store

    rng = np.random.default_rng(8)
    rows = []
    for station in ("s1", "s2"):
        for label, steps in (("h01", 1), ("h06", 6)):
            for i in range(120):
                a, b = float(1013 + rng.normal(0, 5)), float(rng.normal(0, 1))
                y = 0.5 * a + steps * b + float(rng.normal(0, 0.1))
                rows.append((station, START + timedelta(hours=i), a, b, label, steps, y, "train" if i < 90 else "test"))
    schema = "station_id string, ts_utc timestamp, a double, b double, horizon_label string, horizon_steps int, y_true double, split string"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "models")
    for name in ("ridge", "linear_regression"):
        model_store.save_models(model_store.fit_horizons(df, ["a", "b"], name), path, f"v-{name}")
    one = df.where("station_id = 's2' and horizon_label = 'h06'")
    for name in ("ridge", "linear_regression"):
        models = model_store.load_models(spark, path, f"v-{name}")
        assert models.count() == 4
        test = df.where("split = 'test'")
        scored = model_store.score_horizons(test, models)
        got = {r["ts_utc"]: r["y_pred"] for r in scored.where("station_id = 's2' and horizon_label = 'h06'").collect()}
        # the same horizon by the single steps
        params = scaling.fit_scaler(one, ["a", "b"])
        scaled = scaling.apply_scaler(one, params, ["a", "b"])
        train = scaled.where("split = 'train'")
        fitted = linear.fit_ridge_cv(train, ["a", "b"], "y_true") if name == "ridge" else linear.fit_ols(train, ["a", "b"], "y_true")
        want = linear.predict_linear(scaled.where("split = 'test'"), fitted, ["a", "b"]).collect()
        assert len(got) == len(want) == 30
        for r in want:
            assert got[r["ts_utc"]] == pytest.approx(r["y_pred"], abs=1e-8)
        # rows without a horizon meet the models of all
        plain = test.where("horizon_label = 'h01'").drop("horizon_label", "horizon_steps", "y_true")
        assert model_store.score_horizons(plain, models).groupBy("horizon_label").count().orderBy("horizon_label").collect()[0]["count"] == 60
    assert model_store.load_models(spark, path).select("version").distinct().collect()[0][0] == "v-ridge"
    with pytest.raises(ValueError, match="features missing"):
        model_store.score_horizons(df.drop("a"), model_store.load_models(spark, path))


def test_ridge_folds_far_from_zero(spark):
    rng = np.random.default_rng(21)
    n = 600
    x = 101_300 + rng.normal(0, 2, (n, 2))  # pressures in pascal
    y = 101_300 + 0.3 * (x[:, 0] - x[:, 1]) + rng.normal(0, 1e-3, n)
    rows = [("s1", START + timedelta(minutes=10 * i), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "station_id string, ts_utc timestamp, a double, b double, y double")
    got = linear.fit_ridge_cv(df, ["a", "b"], "y").first()
    size = n // 6
    wanted = []
    for alpha in linear.RIDGE_ALPHAS:
        errors = []
        for i in range(1, 6):
            end = n - (6 - i) * size
            train, test = slice(0, end), slice(end, end + size)
            centre = y[train].mean()
            extended = np.vstack([x[train], np.sqrt(alpha) * np.eye(2)])
            w = np.linalg.lstsq(extended, np.concatenate([y[train] - centre, [0, 0]]), rcond=None)[0]
            errors.append(np.sqrt(np.mean((y[test] - centre - x[test] @ w) ** 2)))
        wanted.append(np.mean(errors))
    assert got["alpha"] == linear.RIDGE_ALPHAS[int(np.argmin(wanted))]
    np.testing.assert_allclose(got["cv_rmse"], wanted, rtol=1e-5)
