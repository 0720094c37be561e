"""Train-only scalers: fit, apply, invert."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast.functions.names import ref
from stationcast.operators.buckets import keys_list, lookup_join, time_bucket
from stationcast.session import stage

METHODS = ("standard", "minmax", "robust")
_DIGITS = 6_000  # leading digits of values per factor of e
_STRETCH_SECONDS = 10 * 86_400
PARAMETERS = ("mean", "scale", "min", "median", "iqr")


def _require(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unsupported scaler method {method!r}")


def scalable_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that are numeric and not flags."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if isinstance(kinds.get(c), T.NumericType)]


def _or_one(width: Column) -> Column:
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def _digit(value: Column) -> Column:
    """A whole number that never falls as ``value`` grows; NaN comes last, as Spark orders it.

    The logarithm of the magnitude in steps of ``1 / _DIGITS``, signed: about 4,000 digits
    for each factor of two, and at most some 17 million in all.  The logarithm of the
    JVM's strict mathematics never falls, which is all that is needed of it.
    """
    place = F.floor(F.least(F.ln(F.abs(value)) + 746.0, F.lit(1_456.0)) * float(_DIGITS))
    return (
        F.when(F.isnan(value), F.lit(1_457 * _DIGITS).cast("bigint"))
        .when(value == 0, F.lit(0).cast("bigint"))
        .otherwise(F.when(value > 0, place).otherwise(-place))
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    quantiles: dict[str, float],
    keys: str | Sequence[str] = "station_id",
) -> DataFrame:
    """Linearly interpolated quantiles: (keys, column, <name>...), exact at any size.

    Radix selection by two scans.  The first counts values by their leading digit
    (``_digit``), the second counts the distinct values of the few digits that hold a
    wanted rank.  Both are reduced inside each task, so a constant series of any length
    leaves a row per task, and no task holds a series.  The wanted digits, at most two a
    quantile for each key and column, are stored in between: Spark sees how small they are
    and leaves the rows of the second scan where they are, or salts them by time.
    Missing values are left out; a column without any value of a key gives no row.
    """
    keys = keys_list(keys)
    group = [*keys, "_i"]
    values = [f"_v{i}" for i in range(len(columns))]
    times = [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    narrow = df.select(
        *keys, *[ref(c).alias(f"_t{i}") for i, c in enumerate(times)], *[ref(c).cast("double").alias(v) for c, v in zip(columns, values, strict=True)]
    )

    def unfolded(rows: DataFrame, cells: Column) -> DataFrame:
        each = rows.select(*keys, F.posexplode(cells).alias("_i", "_c")).select(*group, "_c.*")
        return each.where(F.col("value").isNotNull()).withColumn("_d", _digit(F.col("value")))

    ranks = {
        (name, side): F.floor((F.col("_n") - 1) * F.lit(q)) + side + 1 for name, q in quantiles.items() for side in (0, 1)
    }

    def holds(rank: Column) -> Column:
        return (rank > F.col("_before")) & (rank <= F.col("_before") + F.col("_k"))

    whole = Window.partitionBy(*group)
    running = whole.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        unfolded(narrow, F.array(*[F.struct(F.col(v).alias("value")) for v in values])).groupBy(*group, "_d").agg(F.count(F.lit(1)).alias("_k"))
        .select(*group, "_d", "_k", (F.sum("_k").over(running) - F.col("_k")).alias("_before"), F.sum("_k").over(whole).alias("_n"))
    )
    wanted = reduce(Column.__or__, [holds(rank) for rank in ranks.values()])
    hits = stage(located.where(wanted).drop("_k"), "quantile-digits")
    # one entry per wanted digit and column
    per_key = hits.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_d", "_before", "_n")).alias("_l"))
    by_place = F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda j: F.filter("_l", lambda e: e["_i"] == j))
    placed = lookup_join(narrow, per_key.select(*keys, by_place.alias("_hits")), keys, [f"_t{i}" for i in range(len(times))] or values, "inner")
    # each value beside the wanted digits of its own column
    beside = F.zip_with(F.array(*values), "_hits", lambda v, h: F.struct(v.alias("value"), h.alias("_own")))
    met = unfolded(placed, beside).withColumn("_h", F.get(F.filter("_own", lambda e: e["_d"] == F.col("_d")), F.lit(0)))
    near = met.where(F.col("_h").isNotNull()).select(*group, "_d", "_h._before", "_h._n", "value")
    counted = near.groupBy(*group, "_d", "_before", "_n", "value").agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*group, "_d").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    # By key and column, which suffices for the running counts and for the points below.
    found = counted.repartition(*[F.col(k) for k in group]).withColumn("_before", F.col("_before") + upto - F.col("_k"))
    points = found.groupBy(*group, "_n").agg(
        *[F.max(F.when(holds(rank), F.col("value"))).alias(f"_{name}_{side}") for (name, side), rank in ranks.items()]
    )

    def between(name: str, q: float) -> Column:
        low, high = F.col(f"_{name}_0"), F.coalesce(F.col(f"_{name}_1"), F.col(f"_{name}_0"))
        spot = (F.col("_n") - 1) * F.lit(q)
        # an infinite value is not weighed with itself
        return F.when(low == high, low).otherwise(low + (high - low) * (spot - F.floor(spot))).alias(name)

    names = F.array(*[F.lit(c) for c in columns])
    return points.select(*keys, F.get(names, F.col("_i")).alias("column"), *[between(name, q) for name, q in quantiles.items()])


def fit_scaler(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "standard",
    keys: str | Sequence[str] = "station_id",
    split: str | None = "split",
    ts: str | None = None,
) -> DataFrame:
    """Parameters per key and column: (keys, column, method, mean, scale, min, median, iqr).

    Only ``train`` rows are used when the ``split`` column is named; pass
    ``split=None`` for a table that holds train rows alone.  The standard
    deviation is the population one and a zero width becomes 1.  With ``ts`` the
    standard scaler adds up short stretches of time and folds them in time order,
    so that two runs over the same table agree to the last bit.
    """
    _require(method)
    keys = keys_list(keys)
    train = df if split is None else df.where(F.col(split) == "train")
    nothing = F.lit(None).cast("double")
    if method == "robust":
        q = exact_quantiles(train, columns, {"_q1": 0.25, "median": 0.5, "_q3": 0.75}, keys)
        return q.select(
            *keys, "column", F.lit(method).alias("method"),
            nothing.alias("mean"), nothing.alias("scale"), nothing.alias("min"),
            "median", _or_one(F.col("_q3") - F.col("_q1")).alias("iqr"),
        )

    if method == "standard" and ts is not None:
        return _folded_standard(train, columns, keys, ts)

    def entry(c: str) -> Column:
        value = ref(c).cast("double")
        if method == "standard":
            mean, low, scale = F.avg(value), nothing, _or_one(F.stddev_pop(value))
        else:
            mean, low, scale = nothing, F.min(value), _or_one(F.max(value) - F.min(value))
        return F.struct(F.lit(c).alias("column"), mean.alias("mean"), scale.alias("scale"), low.alias("min"))

    return (
        train.groupBy(*keys)
        .agg(F.array(*[entry(c) for c in columns]).alias("_p"))
        .select(*keys, F.explode("_p").alias("_p"))
        .select(
            *keys, "_p.column", F.lit(method).alias("method"), "_p.mean", "_p.scale", "_p.min",
            nothing.alias("median"), nothing.alias("iqr"),
        )
    )


def _folded_standard(train: DataFrame, columns: Sequence[str], keys: list[str], ts: str) -> DataFrame:
    """Mean and population deviation from per-stretch moments, merged in time order.

    A stretch lies in one or two halo buckets, so at most two partial moments meet in
    Spark's own aggregation, and two merge alike in either order.
    """
    def moments(c: str) -> Column:
        value = ref(c).cast("double")
        return F.struct(
            F.count(value).cast("double").alias("n"),
            F.coalesce(F.avg(value), F.lit(0.0)).alias("m"),
            F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("q"),
        )

    stretches = train.groupBy(*keys, time_bucket(ref(ts), _STRETCH_SECONDS).alias("_at")).agg(
        F.array(*[moments(c) for c in columns]).alias("_m")
    )
    per_column = stretches.select(*keys, "_at", F.posexplode("_m").alias("_i", "_m")).select(*keys, "_i", "_at", "_m.*")
    # One entry per stretch, some hundred a year.
    series = per_column.groupBy(*keys, "_i").agg(F.array_sort(F.collect_list(F.struct("_at", "n", "m", "q"))).alias("_s"))

    def merged(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        gap = b["m"] - a["m"]
        share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
        return F.struct(
            n.alias("n"), (a["m"] + gap * share).alias("m"), (a["q"] + b["q"] + gap * gap * a["n"] * share).alias("q")
        )

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))
    whole = series.select(*keys, "_i", F.aggregate("_s", zero, merged).alias("_w"))
    known = F.col("_w.n") > 0
    nothing = F.lit(None).cast("double")
    names = F.array(*[F.lit(c) for c in columns])
    return whole.select(
        *keys, F.get(names, F.col("_i")).alias("column"), F.lit("standard").alias("method"),
        F.when(known, F.col("_w.m")).alias("mean"), F.when(known, _or_one(F.sqrt(F.col("_w.q") / F.col("_w.n")))).alias("scale"),
        nothing.alias("min"), nothing.alias("median"), nothing.alias("iqr"),
    )


def fit_target_scaler(
    df: DataFrame,
    target_column: str,
    method: str = "standard",
    keys: str | Sequence[str] = "station_id",
    split: str | None = "split",
    ts: str | None = None,
) -> DataFrame:
    return fit_scaler(df, [target_column], method, keys, split, ts)


def _centre_and_width(method: Column) -> tuple[Column, Column]:
    centre = (
        F.when(method == "standard", F.col("mean"))
        .when(method == "minmax", F.col("min"))
        .when(method == "robust", F.col("median"))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported scaler method: "), method)).cast("double"))
    )
    return centre, F.when(method == "robust", F.col("iqr")).otherwise(F.col("scale"))


def _with_parameters(df: DataFrame, params: DataFrame, columns: Sequence[str], keys: list[str], spread_on: Sequence[str]) -> DataFrame:
    centre, width = _centre_and_width(F.col("method"))
    order = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(i) for i in range(len(columns))])
    )
    per_key = (
        params.where(F.col("column").isin(list(columns)))
        .groupBy(*keys)
        # One entry per wanted column, whatever the size of the data.
        .agg(F.array_sort(F.collect_list(F.struct(order[F.col("column")].alias("i"), centre.alias("c"), width.alias("w")))).alias("_p"))
        .withColumn("_missing", F.size("_p") != len(columns))
    )
    return lookup_join(df, per_key, keys, spread_on)


def _parameter(i: int, part: str) -> str:
    """SQL text: hundreds of columns made of single calls take many seconds to put together."""
    if i == 0 and part == "w":
        return "CASE WHEN coalesce(_missing, true) THEN CAST(raise_error('scaler has no parameters for a wanted column') AS DOUBLE) ELSE _p[0].w END"
    return f"_p[{i}].{part}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def apply_scaler(
    df: DataFrame,
    params: DataFrame,
    columns: Sequence[str],
    keys: str | Sequence[str] = "station_id",
    spread_on: Sequence[str] = ("ts_utc",),
) -> DataFrame:
    """Replace ``columns`` by their scaled values."""
    keys = keys_list(keys)
    joined = _with_parameters(df, params, columns, keys, spread_on)
    index = {c: i for i, c in enumerate(columns)}

    def scaled(c: str) -> str:
        i = index[c]
        return f"(CAST({_quoted(c)} AS DOUBLE) - {_parameter(i, 'c')}) / ({_parameter(i, 'w')}) AS {_quoted(c)}"

    return joined.selectExpr(*[scaled(c) if c in index else _quoted(c) for c in df.columns])


def inverse_scale(
    df: DataFrame,
    params: DataFrame,
    column: str,
    values: str | None = None,
    keys: str | Sequence[str] = "station_id",
    spread_on: Sequence[str] = ("ts_utc",),
) -> DataFrame:
    """Bring ``values`` (default: ``column`` itself) back to the units of ``column``."""
    keys = keys_list(keys)
    name = values or column
    joined = _with_parameters(df, params, [column], keys, spread_on)
    return joined.select(
        *[(ref(c) * F.expr(_parameter(0, "w")) + F.expr(_parameter(0, "c"))).alias(c) if c == name else ref(c) for c in df.columns]
    )
