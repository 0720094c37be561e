"""Canonical series to prepared series, in one shuffle after gap insertion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stationcast.functions import encoding, meteo, quality
from stationcast.functions.units import CANONICAL_VARIABLES
from stationcast.operators import windows
from stationcast.operators.buckets import Halo, grid_step
from stationcast.operators.grid import insert_gaps, resample, snap_to_axis

# Variables that get rolling statistics, where present.
ROLLING_VARIABLES = (
    "temp_c",
    "rh_pct",
    "pres_hpa",
    "wspd_ms",
    "gust_ms",
    "rain_mm",
    "rain_rate_mmh",
    "solar_wm2",
    "uv_index",
    "wdir_sin",
    "wdir_cos",
)
DERIVED_METRICS = ("dew_point", "vpd", "heat_index", "wind_chill")


def prepare_series(
    df: DataFrame,
    freq_seconds: int,
    rolling_windows: Sequence[int],
    derived_metrics: Sequence[str] = DERIVED_METRICS,
    resample_seconds: int | None = None,
    min_periods: int | None = None,
    keys: str = "station_id",
    ts: str = "ts_utc",
    bucket_steps: int | None = None,
    off_axis: str = "keep",
) -> DataFrame:
    """Gaps, quality flags, derived variables, calendar, wind encoding, rolling statistics.

    The order is fixed: the consistency check sees derived columns, and no step
    looks at rows after the current one.

    Rows off the time axis stay, told by the column ``off_axis``: no window of another row
    sees them, and their own windows hold nothing else.  With ``off_axis="snap"`` those
    whose nearest step is free take its time first and are rows as all others.
    """
    if off_axis not in ("keep", "snap"):
        raise ValueError(f"off_axis is 'keep' or 'snap', not {off_axis!r}")
    rows = snap_to_axis(df, freq_seconds, keys, ts) if off_axis == "snap" else df
    grid = insert_gaps(rows, freq_seconds, keys, ts, keep_off_axis=True)
    variables = [c for c in CANONICAL_VARIABLES if c in grid.columns]
    reach = max([*rolling_windows, windows.SPIKE_ROWS, windows.FLATLINE_ROWS])
    halo = Halo(keys, grid_step(F.col(ts), freq_seconds), reach, 0, bucket_steps)

    def prepared(opened: DataFrame, spec: WindowSpec, place: list[str]) -> DataFrame:
        flags = quality.range_flags(variables)
        flags |= windows.spike_flags(spec, variables)
        flags |= windows.flatline_flags(spec, variables)
        out = opened.withColumns(flags)
        derived = meteo.derived_columns(variables, list(derived_metrics))
        if derived:
            out = out.withColumns(derived)
        out = out.withColumn("qc_consistency", quality.consistency_flag(out.columns))
        out = out.withColumn("qc_any", quality.any_of([F.col(c) for c in out.columns if c.startswith("qc_")]))
        out = out.withColumns(encoding.calendar_columns(F.col(ts)))
        if "wdir_deg" in variables:
            out = out.withColumns(encoding.wind_direction_columns(F.col("wdir_deg")))
        if rolling_windows:
            columns = [c for c in ROLLING_VARIABLES if c in out.columns]
            out = windows.apply_rolling(out, spec, columns, rolling_windows, min_periods=min_periods, place=place)
        return out

    on = halo.close(prepared(halo.open(grid.where(~F.col("off_axis"))), halo.spec, halo.place))
    # every other row is a window of its own; it may lack the time or key that a bucket needs
    alone = grid.where("off_axis").withColumn("_alone", F.monotonically_increasing_id())
    off = prepared(alone, Window.partitionBy("_alone").orderBy("_alone"), ["_alone"]).drop("_alone")
    out = on.unionByName(off)
    # merged steps hold the rows off the axis too and are all on their own
    return resample(out.drop("off_axis"), resample_seconds, keys, ts) if resample_seconds else out
