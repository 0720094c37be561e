"""Windowed features on a regular grid: lags, leads, rolling statistics, causal checks.

Each public function opens its own halo; ``prepare_series`` (operators.prepare)
opens one and applies all of them inside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast.functions.names import lag_column, ref, rolling_column, target_column
from stationcast.functions.quality import RESTING_AT_ZERO, flag_name, true_or_false
from stationcast.operators.buckets import BUCKET, Halo, grid_step

STATS = ("mean", "std", "min", "max")
SPIKE_ROWS = 12
SPIKE_MIN_VALUES = 6
SPIKE_FACTOR = 4.0
FLATLINE_ROWS = 18
_MAX_PARTS = 16
# Longer windows that are no multiple of a shorter one are put together from blocks.
_MOST_DIRECT = 24
# Rows gathered before whole partitions of a window are worked on, and cells of one step of that work.
_GATHERED, _CELLS = 1 << 16, 1 << 20


def _halo(df_keys, ts: str, freq_seconds: int, lookback: int, lookahead: int, bucket_steps: int | None) -> Halo:
    return Halo(df_keys, grid_step(F.col(ts), freq_seconds), lookback, lookahead, bucket_steps)


# --- lags and future targets ------------------------------------------------


def lag_expressions(spec: WindowSpec, columns: Sequence[str], lags: Sequence[int]) -> list[Column]:
    return [F.lag(ref(c), int(n)).over(spec).alias(lag_column(c, int(n))) for n in lags for c in columns]


def lead_expressions(spec: WindowSpec, target: str, horizons: Sequence[int]) -> list[Column]:
    return [F.lead(ref(target), int(h)).over(spec).alias(target_column(target, int(h))) for h in horizons]


def lag_features(
    df: DataFrame,
    columns: Sequence[str],
    lags: Sequence[int],
    freq_seconds: int,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    bucket_steps: int | None = None,
) -> DataFrame:
    """``<col>_lag<n>``: the value n grid rows earlier."""
    halo = _halo(keys, ts, freq_seconds, max(lags), 0, bucket_steps)
    return halo.close(halo.open(df).select("*", *lag_expressions(halo.spec, columns, lags)))


def horizon_targets(
    df: DataFrame,
    target: str,
    horizons: Sequence[int],
    freq_seconds: int,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    bucket_steps: int | None = None,
) -> DataFrame:
    """``<target>_t+<h>``: the target h grid rows later."""
    halo = _halo(keys, ts, freq_seconds, 0, max(horizons), bucket_steps)
    return halo.close(halo.open(df).select("*", *lead_expressions(halo.spec, target, horizons)))


# --- rolling statistics -----------------------------------------------------


def _rolling_order(windows: Sequence[int]) -> list[tuple[int, int | None]]:
    """(window, shorter window it is put together from) in build order."""
    order: list[tuple[int, int | None]] = []
    for w in sorted({int(x) for x in windows}):
        parts = [p for p, _ in order if w % p == 0 and 1 < w // p <= _MAX_PARTS]
        order.append((w, max(parts) if parts else None))
    return order


def _state(kind: str, window: int, column: str) -> str:
    return f"_r{window}_{kind}_{column}"


def _kinds(spread: bool, extremes: bool) -> list[str]:
    return ["n", "m", *(["q"] if spread else []), *(["lo", "hi"] if extremes else [])]


def _frame_state(frame: WindowSpec, column: str, spread: bool, extremes: bool) -> dict[str, Column]:
    """Count, mean, squared deviations and extremes of the rows of a frame."""
    value = ref(column)
    out = {"n": F.count(value).over(frame), "m": F.avg(value).over(frame)}
    if spread:
        out["q"] = F.var_pop(value).over(frame) * F.count(value).over(frame)
    if extremes:
        out |= {"lo": F.min(value).over(frame), "hi": F.max(value).over(frame)}
    return out


def _direct_state(spec: WindowSpec, column: str, window: int, spread: bool, extremes: bool) -> list[Column]:
    state = _frame_state(spec.rowsBetween(-window, -1), column, spread, extremes)
    return [value.alias(_state(kind, window, column)) for kind, value in state.items()]


def _merged_states(
    df: DataFrame,
    columns: Sequence[str],
    window: int,
    parts: Sequence[Callable[[str, str], str]],
    spread: bool,
    extremes: bool,
) -> DataFrame:
    """State of a window from states of the parts it consists of, whose columns each of ``parts`` names.

    Counts add up, means are weighted by them; squared deviations combine with
    the between-part term, which loses no precision to cancellation; extremes nest.
    """

    def states(kind: str, column: str) -> list[Column]:
        return [ref(part(kind, column)) for part in parts]

    def total(values: Sequence[Column]) -> Column:
        return sum(values[1:], values[0])

    def first_states(c: str) -> list[Column]:
        n = total([F.coalesce(v, F.lit(0)) for v in states("n", c)])
        weighted = [F.coalesce(k * m, F.lit(0.0)) for k, m in zip(states("n", c), states("m", c), strict=True)]
        out = [n.alias(_state("n", window, c)), (total(weighted) / F.nullif(n, F.lit(0))).alias(_state("m", window, c))]
        if extremes:
            out.append(F.least(*states("lo", c)).alias(_state("lo", window, c)))
            out.append(F.greatest(*states("hi", c)).alias(_state("hi", window, c)))
        return out

    def squares(c: str) -> Column:
        mean = ref(_state("m", window, c))
        terms = [
            F.coalesce(q + k * (m - mean) * (m - mean), F.lit(0.0))
            for k, m, q in zip(states("n", c), states("m", c), states("q", c), strict=True)
        ]
        return total(terms).alias(_state("q", window, c))

    # The new mean is used once per part below, so it gets a column of its own first.
    joined = df.select("*", *[e for c in columns for e in first_states(c)])
    if spread:
        joined = joined.select("*", *[squares(c) for c in columns])
    return joined.drop(*[part(k, c) for part in parts for k in _kinds(spread, extremes) for c in columns])


def _join_blocks(
    df: DataFrame,
    spec: WindowSpec,
    place: Sequence[str],
    columns: Sequence[str],
    window: int,
    spread: bool,
    extremes: bool,
) -> DataFrame:
    """State of a window of any length at a cost per row that does not depend on the length.

    The rows of a partition (named by ``place``) are cut into blocks of ``window`` rows.
    Any window is the end of one block and the start of the next, so it is put together
    from a running state towards the end of each block and one from its start; both take
    one step a row.  Blocks are finer than the partitions, so nothing is shuffled again.
    """
    row, block = F.col("_row"), F.col("_block")
    numbered = df.withColumn("_row", F.row_number().over(spec) - 1).withColumn("_block", F.floor(row / F.lit(float(window))))
    within = Window.partitionBy(*place, "_block")
    first, last = Window.unboundedPreceding, Window.currentRow
    to_end = within.orderBy(row.desc()).rowsBetween(first, last)
    from_start = within.orderBy("_row").rowsBetween(first, last)
    # the order within partitions that the states from the start have left
    ordered = Window.partitionBy(*place).orderBy("_block", "_row")
    kinds = _kinds(spread, extremes)

    def name(end: str) -> Callable[[str, str], str]:
        return lambda kind, column: f"_{end}{kind}_{column}"

    def running(rows: DataFrame, frame: WindowSpec, end: str) -> DataFrame:
        states = {c: _frame_state(frame, c, spread, extremes) for c in columns}
        return rows.select("*", *[states[c][k].alias(name(end)(k, c)) for c in columns for k in kinds])

    both = running(running(numbered, to_end, "tail"), from_start, "head")
    # At the first row of a block the window is the block before, which both states hold.
    sides = [
        *[F.lag(ref(name("tail")(k, c)), window).over(ordered).alias(name("older")(k, c)) for c in columns for k in kinds],
        *[
            F.when(row % window != 0, F.lag(ref(name("head")(k, c)), 1).over(ordered)).alias(name("newer")(k, c))
            for c in columns
            for k in kinds
        ],
    ]
    lagged = both.select("*", *sides).drop("_row", "_block", *[name(e)(k, c) for e in ("tail", "head") for c in columns for k in kinds])
    return _merged_states(lagged, columns, window, [name("older"), name("newer")], spread, extremes)


def _running(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Count, mean, squared deviations and extremes of rows 0..i of every column."""
    n = np.cumsum(valid, axis=0).astype(float)
    m, q = np.zeros_like(x), np.zeros_like(x)
    mean, square = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for i in range(len(x)):  # all blocks at once; a difference of sums would lose digits
        away = np.where(valid[i], x[i] - mean, 0.0)
        mean = mean + away / np.maximum(n[i], 1)
        square = square + np.where(valid[i], away * (x[i] - mean), 0.0)
        m[i], q[i] = mean, square
    bad = valid & np.isnan(x)
    # not-a-number is above all others
    lo = np.minimum.accumulate(np.where(valid & ~bad, x, np.inf), axis=0)
    hi = np.maximum.accumulate(np.where(valid, x, -np.inf), axis=0)
    return n, m, q, lo, hi, np.cumsum(bad, axis=0).astype(float)


def _slid(x: np.ndarray, valid: np.ndarray, begins: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Count, mean, squared deviations, least and largest of the ``window`` rows before each row of its partition.

    Partitions are cut into blocks of ``window`` rows. Any window is the end of one block and
    the start of the next, so a running state from either end takes one step a row.
    """
    width = min(window, int(lengths.max()))
    blocks = -(-lengths // width)
    first = np.cumsum(blocks) - blocks
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(begins, lengths) + inside
    row, column = inside % width, np.repeat(first, lengths) + inside // width
    cells, held = np.zeros((width, blocks.sum())), np.zeros((width, blocks.sum()), dtype=bool)
    cells[row, column], held[row, column] = x[at], valid[at]
    head, tail = _running(cells, held), [s[::-1] for s in _running(cells[::-1], held[::-1])]
    empty = (0.0, 0.0, 0.0, np.inf, -np.inf, 0.0)
    newer = [np.where(row > 0, s[row - 1, column], e) for s, e in zip(head, empty)]
    full = (inside >= width) & (width == window)  # a shorter width has a single block
    older = [np.where(full, s[row, column - 1], e) for s, e in zip(tail, empty)]
    (n1, m1, q1, lo1, hi1, bad1), (n2, m2, q2, lo2, hi2, bad2) = older, newer
    n = n1 + n2
    m = (n1 * m1 + n2 * m2) / np.maximum(n, 1)
    q = q1 + q2 + np.where(n1 > 0, n1 * (m1 - m) ** 2, 0.0) + np.where(n2 > 0, n2 * (m2 - m) ** 2, 0.0)
    bad = bad1 + bad2
    lo = np.where(bad == n, np.nan, np.minimum(lo1, lo2))
    return n, m, q, lo, np.where(bad > 0, np.nan, np.maximum(hi1, hi2))


def _partition_starts(table: pa.Table, place: Sequence[str]) -> np.ndarray:
    """First rows of the partitions of ``table``, whose rows come partition by partition."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in place:
        column = table.column(name)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy()
    return np.flatnonzero(new)


def _by_blocks(
    df: DataFrame,
    place: Sequence[str],
    order: str,
    columns: Sequence[str],
    windows: Sequence[int],
    spread: bool,
    extremes: bool,
) -> DataFrame:
    """States of windows of any length over doubles, for rows that are partitioned by ``place`` already.

    Each partition is sorted once for all windows and goes through as a stream; a task holds
    a few of the partitions of the window, which the halo bounds, at a time.
    """
    kinds = _kinds(spread, extremes)
    made = [(w, c) for w in windows for c in columns]
    names = [_state(k, w, c) for w, c in made for k in kinds]
    types = {k: "bigint" if k == "n" else "double" for k in kinds}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    out = ", ".join(fields + [f"`{_state(k, w, c)}` {types[k]}" for w, c in made for k in kinds])

    def worked(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        lengths = np.diff(np.append(starts, table.num_rows))
        values = {}
        for c in columns:
            column = table.column(c)
            values[c] = pc.fill_null(column, 0.0).to_numpy(), pc.is_valid(column).to_numpy()
        results = []
        for w, c in made:
            cells = np.cumsum(-(-lengths // w) * w) // _CELLS
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(starts)]
            parts = [_slid(*values[c], starts[i:j], lengths[i:j], w) for i, j in zip(cuts[:-1], cuts[1:])]
            state = dict(zip(("n", "m", "q", "lo", "hi"), (np.concatenate(x) for x in zip(*parts))))
            none = state["n"] == 0
            results += [
                pa.array(state[k].astype(np.int64)) if k == "n" else pa.array(state[k], mask=none, from_pandas=False) for k in kinds
            ]
        whole = table.combine_chunks()
        arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in whole.columns]
        done = pa.Table.from_arrays([*arrays, *results], names=[*table.column_names, *names])
        yield from done.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < _GATHERED:
                continue
            table = pa.Table.from_batches(held)
            starts = _partition_starts(table, place)
            if len(starts) > 1:  # the last one may go on
                yield from worked(table.slice(0, starts[-1]), starts[:-1])
                table = table.slice(starts[-1])
            held, rows = table.to_batches(), table.num_rows
        if held:
            table = pa.Table.from_batches(held)
            yield from worked(table, _partition_starts(table, place))

    return df.sortWithinPartitions(*[ref(c) for c in (*place, order)]).mapInArrow(run, out)


def _join_parts(
    df: DataFrame,
    spec: WindowSpec,
    columns: Sequence[str],
    window: int,
    part: int,
    spread: bool,
    extremes: bool,
) -> DataFrame:
    """State of a window from the states of its consecutive shorter parts."""
    kinds = _kinds(spread, extremes)
    shifts = range(1, window // part)

    def lagged(j: int) -> Callable[[str, str], str]:
        return lambda kind, column: f"_lag{j}{_state(kind, part, column)}"

    rows = df.select(
        "*",
        # the last part itself, under a name of its own, so that the shorter window stays
        *[ref(_state(k, part, c)).alias(lagged(0)(k, c)) for k in kinds for c in columns],
        *[F.lag(ref(_state(k, part, c)), j * part).over(spec).alias(lagged(j)(k, c)) for j in shifts for k in kinds for c in columns],
    )
    return _merged_states(rows, columns, window, [lagged(j) for j in (0, *shifts)], spread, extremes)


def apply_rolling(
    df: DataFrame,
    spec: WindowSpec,
    columns: Sequence[str],
    windows: Sequence[int],
    stats: Sequence[str] = STATS,
    min_periods: int | None = None,
    place: Sequence[str] = ("station_id", BUCKET),
) -> DataFrame:
    """Rolling statistics inside an open halo; ``place`` names the columns ``spec`` is partitioned by.

    Spark evaluates a sliding frame anew for every row, so a 144-row frame costs
    144 steps per row.  A window that is a multiple of a shorter one is put
    together from lagged results of the shorter one instead (6 -> 18 -> 36 -> 144
    costs 6+3+2+4), on the same partitioning and sort.  Other windows longer than
    ``_MOST_DIRECT`` rows are put together from blocks, a fixed number of steps per
    row whatever their length: doubles in one stream of each partition, all such windows
    on one sort; other types by two more sorts a window.
    """
    unknown = set(stats) - set(STATS)
    if unknown:
        raise ValueError(f"unknown rolling statistics {sorted(unknown)}")
    spread = "std" in stats
    extremes = "min" in stats or "max" in stats
    order = _rolling_order(windows)
    out = df.select(
        "*",
        *[
            e
            for w, part in order
            if part is None and w <= _MOST_DIRECT
            for c in columns
            for e in _direct_state(spec, c, w, spread, extremes)
        ],
    )
    # windows of doubles that no shorter one leads to, and what is put together from these, are worked on last
    doubles = all(isinstance(df.schema[c].dataType, T.DoubleType) for c in columns)
    alone: list[int] = []
    for w, part in order:
        if doubles and (part in alone or (part is None and w > _MOST_DIRECT)):
            alone.append(w)
        elif part is not None:
            out = _join_parts(out, spec, columns, w, part, spread, extremes)
        elif w > _MOST_DIRECT:
            out = _join_blocks(out, spec, place, columns, w, spread, extremes)
    if alone:
        step = "_step" if "_step" in df.columns else place[-1]
        out = _by_blocks(out, place, step, columns, alone, spread, extremes)

    def result(c: str, w: int, stat: str) -> Column:
        n = ref(_state("n", w, c))
        enough = n >= F.lit(w if min_periods is None else min_periods)
        value = {
            "mean": lambda: ref(_state("m", w, c)),
            "std": lambda: F.when(n > 1, F.sqrt(ref(_state("q", w, c)) / (n - 1))),
            "min": lambda: ref(_state("lo", w, c)),
            "max": lambda: ref(_state("hi", w, c)),
        }[stat]()
        return F.when(enough, value).alias(rolling_column(c, w, stat))

    return out.select(
        *[ref(c) for c in df.columns],
        *[result(c, w, s) for c in columns for w, _ in order for s in stats],
    )


def rolling_features(
    df: DataFrame,
    columns: Sequence[str],
    windows: Sequence[int],
    freq_seconds: int,
    stats: Sequence[str] = STATS,
    min_periods: int | None = None,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    bucket_steps: int | None = None,
) -> DataFrame:
    """``<col>_roll<w>_<stat>`` over the w rows before the current one.

    Without ``min_periods`` a full window of values is required.
    """
    halo = _halo(keys, ts, freq_seconds, max(windows), 0, bucket_steps)
    return halo.close(apply_rolling(halo.open(df), halo.spec, columns, windows, stats, min_periods, halo.place))


# --- causal quality checks --------------------------------------------------


def spike_flags(
    spec: WindowSpec,
    columns: Sequence[str],
    rows: int = SPIKE_ROWS,
    factor: float = SPIKE_FACTOR,
    min_values: int = SPIKE_MIN_VALUES,
) -> dict[str, Column]:
    """Value far from the mean of the rows before it, in their standard deviations."""
    frame = spec.rowsBetween(-rows, -1)

    def flag(c: str) -> Column:
        value = ref(c)
        mean, sd, n = F.avg(value).over(frame), F.stddev_samp(value).over(frame), F.count(value).over(frame)
        return true_or_false((n >= min_values) & (sd > 0) & (F.abs(value - mean) > sd * F.lit(float(factor))))

    return {flag_name("spike", c): flag(c) for c in columns}


def flatline_flags(
    spec: WindowSpec,
    columns: Sequence[str],
    rows: int = FLATLINE_ROWS,
    tolerance: float = 0.0,
) -> dict[str, Column]:
    """Last ``rows`` values all present and within ``tolerance`` of each other."""
    frame = spec.rowsBetween(-(rows - 1), 0)

    def flag(c: str) -> Column:
        value = ref(c)
        n, lo, hi = F.count(value).over(frame), F.min(value).over(frame), F.max(value).over(frame)
        stuck = (n == rows) & (hi - lo <= F.lit(float(tolerance)))
        if c in RESTING_AT_ZERO:
            stuck = stuck & (hi > tolerance)
        return true_or_false(stuck)

    return {flag_name("flatline", c): flag(c) for c in columns}


def qc_spike(
    df: DataFrame,
    columns: Sequence[str],
    freq_seconds: int,
    rows: int = SPIKE_ROWS,
    factor: float = SPIKE_FACTOR,
    min_values: int = SPIKE_MIN_VALUES,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    bucket_steps: int | None = None,
) -> DataFrame:
    halo = _halo(keys, ts, freq_seconds, rows, 0, bucket_steps)
    return halo.close(halo.open(df).withColumns(spike_flags(halo.spec, columns, rows, factor, min_values)))


def qc_flatline(
    df: DataFrame,
    columns: Sequence[str],
    freq_seconds: int,
    rows: int = FLATLINE_ROWS,
    tolerance: float = 0.0,
    keys: str | Sequence[str] = "station_id",
    ts: str = "ts_utc",
    bucket_steps: int | None = None,
) -> DataFrame:
    halo = _halo(keys, ts, freq_seconds, rows - 1, 0, bucket_steps)
    return halo.close(halo.open(df).withColumns(flatline_flags(halo.spec, columns, rows, tolerance)))
