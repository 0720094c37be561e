"""Feature selection and supervised tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast.functions.names import GAP_COLUMN, is_future, is_lag, ref, target_column
from stationcast.operators.buckets import Halo, grid_step, keys_list
from stationcast.operators.windows import lag_expressions, lead_expressions


def numeric_columns(df: DataFrame, booleans: bool = True) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if booleans else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def select_feature_columns(df: DataFrame, target_col: str, not_features: Sequence[str] = ()) -> list[str]:
    """Numeric and boolean columns without the target, future values and the gap marker."""
    skipped = {target_col, GAP_COLUMN, *not_features}
    features = [c for c in numeric_columns(df) if c not in skipped and not is_future(c)]
    if not features:
        raise ValueError("no numeric feature columns left after excluding future targets")
    return features


def select_sequence_columns(
    df: DataFrame,
    target_col: str,
    exclude_lags: bool = True,
    allow_list: Sequence[str] | None = None,
    not_features: Sequence[str] = (),
) -> list[str]:
    """Features of one time step of a sequence: an explicit list, or no lag columns."""
    if allow_list is not None:
        absent = [c for c in allow_list if c not in df.columns]
        if absent:
            raise ValueError(f"allow-list names missing columns: {absent}")
        return list(allow_list)
    features = select_feature_columns(df, target_col, not_features)
    return [c for c in features if not (exclude_lags and is_lag(c))]


def make_supervised(
    df: DataFrame,
    target: str,
    horizons: Sequence[int],
    lags: Sequence[int],
    freq_seconds: int,
    lag_columns: Sequence[str] | None = None,
    drop_incomplete: bool = True,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    bucket_steps: int | None = None,
) -> DataFrame:
    """Lags of every numeric column and future targets, in one window pass.

    ``df`` is a prepared series on its grid.  Rows with any missing value are
    dropped last, so positions still mean time steps while lags are taken.  Rows that
    ``prepare_series`` flags as off the axis have no step and no part in the table.
    """
    if "off_axis" in df.columns:
        df = df.where(~F.col("off_axis")).drop("off_axis")
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not a column of the prepared series")
    keys = keys_list(keys)
    lagged = list(lag_columns) if lag_columns is not None else [c for c in numeric_columns(df, booleans=False) if c not in keys]
    halo = Halo(keys, grid_step(F.col(ts), freq_seconds), max([0, *lags]), max([0, *horizons]), bucket_steps)
    out = halo.open(df).select(
        "*",
        *lag_expressions(halo.spec, lagged, lags),
        *lead_expressions(halo.spec, target, horizons),
    )
    out = halo.close(out)
    return out.dropna("any") if drop_incomplete else out


def stack_horizons(df: DataFrame, target: str, horizons: Mapping[str, int], columns: Sequence[str]) -> DataFrame:
    """One row per origin and horizon with a known outcome, for jobs over all horizons.

    ``df`` holds one ``<target>_t+<h>`` column per horizon; ``columns`` are kept.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("horizon_label"),
                F.lit(int(steps)).alias("horizon_steps"),
                ref(target_column(target, steps)).alias("y_true"),
            )
            for label, steps in horizons.items()
        ]
    )
    return (
        df.select(*[ref(c) for c in columns], F.explode(entries).alias("_h"))
        .where(F.col("_h.y_true").isNotNull())
        .select(*[ref(c) for c in columns], "_h.horizon_label", "_h.horizon_steps", "_h.y_true")
    )


def feature_matrix(df: DataFrame, features: Sequence[str], target_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``features`` vector and ``label`` per row; missing values raise."""
    if target_col not in df.columns:
        raise ValueError(f"target column {target_col!r} is not present")
    # Vector columns may not be named with the grammar's "+" and ".".
    names = {c: f"x{i}" for i, c in enumerate(features)}
    flat = df.select(
        *[ref(c) for c in keep],
        *[ref(c).cast("double").alias(a) for c, a in names.items()],
        ref(target_col).cast("double").alias("label"),
    )
    assembler = VectorAssembler(inputCols=list(names.values()), outputCol="features", handleInvalid="error")
    return assembler.transform(flat).select(*[ref(c) for c in keep], "features", "label")
