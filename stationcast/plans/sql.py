"""SQL building blocks: the derived tables as common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

HOUR = "INTERVAL 1 HOUR"


def rounded(column: str, alias: str | None = None) -> str:
    return f'round({column} + 3.7e-9, 6) + 0.0 AS "{alias or column.strip(chr(34))}"'


# name -> (tables it reads, body)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def table(name: str, needs: Sequence[str], body: str) -> None:
    TABLES[name] = (tuple(needs), body)


def query(body: str, needs: Sequence[str]) -> str:
    """``body`` preceded by everything it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in TABLES[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in ordered)
    return f"WITH {parts}\n{body}" if parts else body


table("ev", (), "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
table(
    "obs",
    ("ev",),
    """SELECT event_type AS station_id, date_trunc('hour', ts) AS ts_utc,
       sum(CAST(round(value * 100) AS BIGINT)) / (count(*) * 1e3) AS temp_c,
       sum(k) * 1e0 / count(*) AS rh_pct,
       min(value) / 1e1 AS wspd_ms, max(value) / 1e1 AS gust_ms,
       CAST((sum(user_id) * 15) % 360 AS DOUBLE) AS wdir_deg,
       count(*) * 2e0 / 1e1 AS rain_mm
       FROM ev GROUP BY 1, 2""",
)
table("span", ("obs",), "SELECT station_id, min(ts_utc) AS lo, max(ts_utc) AS hi FROM obs GROUP BY 1")
table("axis", ("span",), f"SELECT station_id, unnest(generate_series(lo, hi, {HOUR})) AS ts_utc FROM span")
table(
    "grid",
    ("axis", "obs"),
    """SELECT a.station_id, a.ts_utc, temp_c, rh_pct, wspd_ms, gust_ms, wdir_deg, rain_mm,
       o.station_id IS NULL AS gap
       FROM axis a LEFT JOIN obs o ON o.station_id = a.station_id AND o.ts_utc = a.ts_utc""",
)
_BEFORE = "(PARTITION BY station_id ORDER BY ts_utc ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
_LINE = "(PARTITION BY station_id ORDER BY ts_utc)"


def lags(column: str, steps: Sequence[int] = (1, 3, 6)) -> str:
    return ", ".join(f'lag({column}, {n}) OVER {_LINE} AS "{column}_lag{n}"' for n in steps)


def rolled(column: str, window: int, frame: str | None = None) -> str:
    over = frame or f"(PARTITION BY station_id ORDER BY ts_utc ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    return ", ".join(
        f'CASE WHEN count({column}) OVER {over} >= {window} THEN {f}({column}) OVER {over} END AS "{column}_roll{window}_{s}"'
        for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    )


CALENDAR = """CAST(hour(ts_utc) AS INTEGER) AS hour, CAST(isodow(ts_utc) - 1 AS INTEGER) AS weekday,
       CAST(month(ts_utc) AS INTEGER) AS month, CAST(dayofyear(ts_utc) AS INTEGER) AS doy,
       sin(2 * pi() * hour(ts_utc) / 24) AS hour_sin, cos(2 * pi() * hour(ts_utc) / 24) AS hour_cos,
       sin(2 * pi() * dayofyear(ts_utc) / 365.25e0) AS doy_sin, cos(2 * pi() * dayofyear(ts_utc) / 365.25e0) AS doy_cos"""

FEATURES = (
    "temp_c", "rh_pct", "wspd_ms", "gust_ms", "wdir_deg", "rain_mm",
    "temp_c_roll6_mean", "temp_c_roll6_std", "temp_c_roll6_min", "temp_c_roll6_max",
    "hour", "weekday", "month", "doy", "hour_sin", "hour_cos", "doy_sin", "doy_cos",
    "temp_c_lag1", "rh_pct_lag1", "temp_c_lag3", "rh_pct_lag3", "temp_c_lag6", "rh_pct_lag6",
)
INTEGERS = ("hour", "weekday", "month", "doy")

table(
    "features",
    ("grid",),
    f"""SELECT *, {rolled('temp_c', 6)}, {CALENDAR}, {lags('temp_c')}, {lags('rh_pct')},
       lead(temp_c, 1) OVER {_LINE} AS y1, lead(temp_c, 6) OVER {_LINE} AS y6 FROM grid""",
)
table(
    "wide",
    ("features",),
    "SELECT * FROM features WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in FEATURES),
)
for _h in (1, 6):
    table(f"sup{_h}", ("wide",), f"SELECT * FROM wide WHERE y{_h} IS NOT NULL")
    table(
        f"split{_h}",
        (f"sup{_h}",),
        f"""SELECT *, CASE WHEN rn <= n * 7 // 10 THEN 'train' WHEN rn <= n * 85 // 100 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER {_LINE} AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM sup{_h})""",
    )
    table(
        f"clim{_h}",
        (f"split{_h}",),
        f"""SELECT station_id, month, hour, avg(temp_c) AS mean,
        any_value(overall) AS global_mean
        FROM (SELECT *, avg(temp_c) OVER (PARTITION BY station_id) AS overall FROM split{_h} WHERE split = 'train')
        GROUP BY 1, 2, 3""",
    )
    table(
        f"clim_all{_h}",
        (f"split{_h}",),
        f"SELECT station_id, avg(temp_c) AS global_mean FROM split{_h} WHERE split = 'train' GROUP BY 1",
    )
    table(
        f"ols{_h}",
        (f"split{_h}",),
        f"""SELECT station_id, regr_slope(y{_h}, temp_c) AS slope, regr_intercept(y{_h}, temp_c) AS intercept, count(*) AS n
        FROM split{_h} WHERE split = 'train' GROUP BY 1""",
    )

_LABELS = {1: "h01", 6: "h06"}
table(
    "base_predictions",
    tuple(f"{t}{h}" for h in (1, 6) for t in ("split", "clim", "clim_all")),
    " UNION ALL ".join(
        f"""SELECT t.station_id, '{_LABELS[h]}' AS horizon_label, {h} AS horizon_steps, model, 'baseline' AS model_family,
        ts_utc, y{h} AS y_true, {value} AS y_pred FROM (SELECT *, '{model}' AS model FROM split{h} WHERE split = 'test') t
        LEFT JOIN clim{h} c ON c.station_id = t.station_id AND c.month = t.month AND c.hour = t.hour
        LEFT JOIN clim_all{h} g ON g.station_id = t.station_id"""
        for h in (1, 6)
        for model, value in (
            ("persistence", "temp_c"),
            ("moving_average", "temp_c_roll6_mean"),
            ("climatology", "coalesce(c.mean, g.global_mean)"),
        )
    ),
)
table(
    "predictions",
    ("base_predictions", "ols1", "ols6"),
    "SELECT * FROM base_predictions UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT t.station_id, '{_LABELS[h]}', {h}, 'linear_regression', 'ml', ts_utc, y{h}, intercept + slope * temp_c
        FROM split{h} t JOIN ols{h} m ON m.station_id = t.station_id WHERE split = 'test'"""
        for h in (1, 6)
    ),
)
table(
    "horizons",
    ("predictions",),
    """SELECT DISTINCT 0 AS place, horizon_label FROM predictions UNION ALL
    SELECT * FROM (VALUES (0, 'm10'), (1, 'h01'), (2, 'h03'), (3, 'h06'), (4, 'h12'), (5, 'h24')) f(place, horizon_label)
    WHERE NOT EXISTS (SELECT 1 FROM predictions)""",
)
SCORES = """avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
        avg(CASE WHEN abs(y_true) > 1e-6 THEN abs((y_true - y_pred) / y_true) END) * 100 AS mape, count(*) AS n_test"""
SERIES = "station_id, target, horizon_label, horizon_steps, model, model_family"
table(
    "scores",
    ("predictions",),
    f"SELECT station_id, 'temp_c' AS target, horizon_label, horizon_steps, model, model_family, {SCORES} FROM predictions GROUP BY ALL",
)
table(
    "metrics",
    ("scores",),
    """SELECT s.*, CASE WHEN p.rmse > 0 THEN 1 - (s.rmse * s.rmse) / (p.rmse * p.rmse) END AS skill_score_persistence
    FROM scores s LEFT JOIN (SELECT station_id, horizon_label, rmse FROM scores WHERE model = 'persistence') p
    ON p.station_id = s.station_id AND p.horizon_label = s.horizon_label""",
)
table(
    "delta",
    ("split1", "split6"),
    f"""SELECT station_id, 'temp_c' AS target, horizon_label, horizon_steps, 'moving_average' AS model,
    'baseline' AS model_family, {SCORES}, CAST(NULL AS DOUBLE) AS skill_score_persistence
    FROM ("""
    + " UNION ALL ".join(
        f"""SELECT station_id, '{_LABELS[h]}' AS horizon_label, {h} AS horizon_steps, y{h} AS y_true,
        (temp_c_lag1 + temp_c_lag3 + temp_c_lag6) / 3 AS y_pred FROM split{h} WHERE split = 'test'"""
        for h in (1, 6)
    )
    + ") GROUP BY ALL",
)
for _h in (1, 6):
    for _name, _train, _val in (("base", 70, 85), ("late", 60, 75)):
        table(
            f"meta_{_name}{_h}",
            (f"sup{_h}",),
            f"""SELECT station_id, '{_LABELS[_h]}' AS horizon_label, 'temp_c_t+{_h}' AS target_column,
            min(ts_utc) FILTER (rn <= n * {_train} // 100) AS train_start,
            max(ts_utc) FILTER (rn <= n * {_train} // 100) AS train_end,
            count(*) FILTER (rn <= n * {_train} // 100) AS n_train,
            min(ts_utc) FILTER (rn > n * {_train} // 100 AND rn <= n * {_val} // 100) AS validation_start,
            max(ts_utc) FILTER (rn > n * {_train} // 100 AND rn <= n * {_val} // 100) AS validation_end,
            count(*) FILTER (rn > n * {_train} // 100 AND rn <= n * {_val} // 100) AS n_validation,
            min(ts_utc) FILTER (rn > n * {_val} // 100) AS test_start,
            max(ts_utc) FILTER (rn > n * {_val} // 100) AS test_end,
            count(*) FILTER (rn > n * {_val} // 100) AS n_test
            FROM (SELECT *, row_number() OVER {_LINE} AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM sup{_h})
            GROUP BY 1""",
        )
