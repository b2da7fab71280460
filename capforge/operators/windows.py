"""Per-device time-window features.

Frames are by *time*, left-open ``(t - n days, t]``, and the past features are shifted by one **row**: the
value a row carries is the window that ended at the previous row. Rows of one timestamp are ordered by the
tie-break columns, and a past window ends at its row, not at its last peer.

One plan serves every device, whatever its rows, ties or span:

1. every device is cut into blocks of ``block_days``; a row is copied into the earlier blocks whose future
   frames reach it and the later blocks whose past frames reach it;
2. where a device has nothing for longer than the past frames reach, the rows before the gap that the first
   row after it still needs (its previous row's window) are copied over the gap as well; these gaps come
   from one small aggregate per device and block;
3. rows are hashed by (device, block) and sorted by time; each task goes once over its sorted rows and finds
   every statistic with running sums, maxima over power-of-two runs and a wavelet matrix for the medians
   (``sliding``), in n log n steps, however dense a device is and however its values jump.

A block with its copies is handled by one task; shorter blocks make smaller ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capforge.functions import fixed as FX
from capforge.functions.scalar import DAY_MICROS, above_flag, add_days, epoch_micros, floor_div, nan_to_null
from capforge.operators import sliding
from capforge.operators.relational import fill_missing
from capforge.session import materialised

DEVICE_KEYS = FX.DEVICE_KEYS
BLOCK_DAYS = 90
_BLOCK, _OWN, _MICROS = "__block", "__own", "__micros"


@dataclass(frozen=True)
class Frame:
    """One framed aggregate.

    ``stat``: max | min | std | median | sum | mean | range.
    ``direction``: past | future.
    ``shift``: take the value of the previous row's window (past frames only).
    """

    name: str
    source: str
    stat: str
    days: int
    direction: str = "past"
    shift: bool = True


STATS = ("max", "min", "std", "median", "sum", "mean", "range")


def _day_suffix(n: int) -> str:
    return f"{n}Day" if n == 1 else f"{n}Days"


def _default_tiebreak(df: DataFrame, keys: Sequence[str], ts: str) -> list[str]:
    orderable = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return [f.name for f in df.schema.fields
            if f.name not in keys and f.name != ts and isinstance(f.dataType, orderable)]


def _check_ts(ts: str) -> Column:
    """A missing timestamp is an error (time windows cannot place it)."""
    c = F.col(ts)
    return F.when(c.isNull(), F.raise_error(F.lit(f"NULL value in time column '{ts}'"))).otherwise(c)


def _statistic(stat: str, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    if stat == "max":
        return sliding.range_max(x, low, high)
    if stat == "min":
        return -sliding.range_max(-x, low, high)
    if stat == "range":
        return sliding.range_max(x, low, high) + sliding.range_max(-x, low, high)
    return {"sum": sliding.range_sum, "mean": sliding.range_mean, "std": sliding.range_std, "median": sliding.range_median}[stat](x, low, high)


def _framed_values(group: np.ndarray, t: np.ndarray, values: dict[str, np.ndarray], frames: Sequence[Frame]) -> list[np.ndarray]:
    """The frames' values for rows sorted by (group, t); NaN: undefined."""
    n = len(t)
    rows = np.arange(n)
    first = np.concatenate([[True], group[1:] != group[:-1]])
    before = np.maximum(rows - 1, 0)
    ranges: dict = {}
    made: dict = {}
    for f in frames:
        where = (f.direction, f.days, f.shift)
        if where not in ranges:
            if f.direction == "future":
                ranges[where] = sliding.edges(group, t, t, group), sliding.edges(group, t, t + f.days * DAY_MICROS, group)
            else:
                low, high = sliding.edges(group, t, t - f.days * DAY_MICROS, group), rows + 1
                ranges[where] = (np.where(first, 0, low[before]), np.where(first, 0, high[before])) if f.shift else (low, high)
        key = (f.stat, f.source, where)
        if key not in made:
            made[key] = _statistic(f.stat, values[f.source], *ranges[where])
    return [made[(f.stat, f.source, (f.direction, f.days, f.shift))] for f in frames]


def _with_copies(d: DataFrame, keys: list[str], frames: Sequence[Frame], block: int) -> DataFrame:
    """Rows with ``__block``, copied to every block that needs them; ``__own`` marks the row's own block."""
    past = max([f.days for f in frames if f.direction == "past"] or [0]) * DAY_MICROS
    future = max([f.days for f in frames if f.direction == "future"] or [0]) * DAY_MICROS
    shifted = any(f.shift for f in frames)
    micros, own = F.col(_MICROS), floor_div(F.col(_MICROS), block)
    # a shifted frame is that of the previous row, which may be nearly a frame before the block itself
    reach = floor_div(micros + F.lit(2 * past if shifted else past), block)
    near = d.withColumn(_BLOCK, F.explode(F.sequence(floor_div(micros - F.lit(future), block), F.greatest(own, reach)))).withColumn(
        _OWN, F.col(_BLOCK) == own)
    if not shifted:
        return near
    # gaps: the next block with rows of its own starts more than a frame after the last row before it
    last = d.groupBy(*keys, own.alias("__from")).agg(F.max(_MICROS).alias("__last"))
    order = Window.partitionBy(*keys).orderBy("__from")
    gaps = last.withColumn("__to", F.lead("__from").over(order)).filter(F.col("__to") * F.lit(block) > F.col("__last") + F.lit(past))
    gaps = gaps.select(*[F.col(f"`{k}`").alias(f"__gap{i}") for i, k in enumerate(keys)], "__last", "__to", F.explode(
        F.sequence(F.col("__from") - F.lit(past // block + 1), F.col("__from"))).alias("__from"))
    same = own == F.col("__from")
    for i, k in enumerate(keys):
        same = same & (F.col(f"`{k}`") == F.col(f"__gap{i}"))
    far = d.join(gaps, same & (micros > F.col("__last") - F.lit(past)) & (reach < F.col("__to")))
    return near.unionByName(far.withColumn(_BLOCK, F.col("__to")).withColumn(_OWN, F.lit(False)).select(*near.columns))


def framed(df: DataFrame, keys: Sequence[str], ts: str, frames: Sequence[Frame],
           tiebreak: Sequence[str] | None = None, block_days: int | None = None) -> DataFrame:
    """Add one column per ``Frame``; input rows and columns are kept. Rows with a NULL key are expected to be
    removed by the caller; a NULL time is an error. Results don't depend on ``block_days`` (default 90)."""
    keys, frames = list(keys), list(frames)
    tiebreak = list(tiebreak) if tiebreak is not None else _default_tiebreak(df, keys, ts)
    for f in frames:
        if f.direction not in ("past", "future") or f.stat not in STATS:
            raise ValueError(f"unknown frame: {f}")
        if f.direction == "future" and f.shift:
            raise ValueError("future frames are not shifted")
    cols, sources = df.columns, sorted({f.source for f in frames})
    d = df.withColumn(ts, _check_ts(ts)).withColumn(_MICROS, epoch_micros(ts))
    for i, c in enumerate(sources):
        d = d.withColumn(f"__x{i}", F.col(f"`{c}`").cast("double"))
    spread = _with_copies(d, keys, frames, int(block_days or BLOCK_DAYS) * DAY_MICROS)
    names = [f"`{k}`" for k in keys] + [_BLOCK]
    dealt = spread.repartition(*names).sortWithinPartitions(*names, _MICROS, *[f"`{c}`" for c in tiebreak])
    place = [dealt.columns.index(c) for c in [*keys, _BLOCK]]
    own, micros = dealt.columns.index(_OWN), dealt.columns.index(_MICROS)
    xs = {c: dealt.columns.index(f"__x{i}") for i, c in enumerate(sources)}
    kept = [dealt.columns.index(c) for c in cols]
    names_out = [*cols, *[f.name for f in frames]]

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        """Rows whose (device, block) isn't that of the row before."""
        out = np.zeros(batch.num_rows, bool)
        for i in place:
            code = batch.column(i).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            out[1:] |= code[1:] != code[:-1]
        return out

    def finished(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        """The own rows of whole groups with their frames' values."""
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()
        if not batch:
            return None
        batch = batch[0]
        group = np.cumsum(changes(batch))
        t = batch.column(micros).to_numpy()
        values = {c: batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for c, i in xs.items()}
        made = _framed_values(group, t, values, frames)
        mine = batch.column(own)
        keep = mine.to_numpy(zero_copy_only=False).astype(bool)
        arrays = [batch.column(i).filter(mine) for i in kept]
        arrays += [pa.array(v[keep], pa.float64(), from_pandas=True) for v in made]
        return pa.RecordBatch.from_arrays(arrays, names_out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a group that may go on in the next batch

        def tail(b: pa.RecordBatch) -> tuple:
            return tuple(b.column(i)[b.num_rows - 1].as_py() for i in place)

        def head(b: pa.RecordBatch) -> tuple:
            return tuple(b.column(i)[0].as_py() for i in place)

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(changes(batch))
            if held and tail(held[-1]) != head(batch):
                starts = np.concatenate([[0], starts])
            if len(starts):
                cut = int(starts[-1])
                out = finished(held + [batch.slice(0, cut)])
                if out is not None:
                    yield out
                held = []
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            out = finished(held)
            if out is not None:
                yield out

    schema = T.StructType([*[df.schema[c] for c in cols], *[T.StructField(f.name, T.DoubleType()) for f in frames]])
    return dealt.mapInArrow(walk, schema)


# --------------------------------------------------------------------------- public operators

def _prepare(df: DataFrame, keys: Sequence[str], value_col: str | None) -> DataFrame:
    missing = [c for c in keys if c not in df.columns]
    if missing:
        raise ValueError(f"missing key columns: {missing}")
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    if cond is not None:
        df = df.filter(cond)  # grouping drops NULL keys in the reference
    if value_col:
        df = df.withColumn(value_col, nan_to_null(F.col(value_col).cast("double")))
    return df


def future_max(df: DataFrame, keys=DEVICE_KEYS, ts="Date", v="Value", days: int = 21,
               tiebreak=None, block_days=None, name: str | None = None) -> DataFrame:
    """Max of ``v`` over ``(t, t + days]`` per device; 0.0 when that span is empty (row 42)."""
    name = name or f"{v}_target_Max"
    d = _prepare(df, keys, v)
    out = framed(d, keys, ts, [Frame(name, v, "max", days, "future", False)], tiebreak, block_days)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def future_target(df: DataFrame, keys=DEVICE_KEYS, ts="Date", v="Value", days: int = 21,
                  threshold: float = 80.0, tiebreak=None, block_days=None) -> DataFrame:
    """``Target = future max >= threshold`` as INT (row 43)."""
    out = future_max(df, keys, ts, v, days, tiebreak, block_days, name=FX.FUTURE_MAX)
    return out.withColumn(FX.TARGET, above_flag(FX.FUTURE_MAX, threshold, inclusive=True))


def _past(df, keys, ts, v, frames, tiebreak, block_days):
    d = _prepare(df, keys, v)
    return framed(d, keys, ts, frames, tiebreak, block_days)


def past_max(df: DataFrame, keys=DEVICE_KEYS, ts="Date", v="Value", days: Iterable[int] = (1, 3),
             tiebreak=None, block_days=None) -> DataFrame:
    """Previous row's max over the last n days: ``<v>_Last_<n>Day(s)`` (row 44)."""
    return _past(df, keys, ts, v, [Frame(f"{v}_Last_{_day_suffix(n)}", v, "max", n) for n in days],
                 tiebreak, block_days)


def past_std(df: DataFrame, keys=DEVICE_KEYS, ts="Date", v="Value", days: int = 28,
             tiebreak=None, block_days=None) -> DataFrame:
    """Previous row's sample std over the last n days (row 45)."""
    return _past(df, keys, ts, v, [Frame(f"Date_{v}_Last_{days}Days_SDev", v, "std", days)],
                 tiebreak, block_days)


def past_median(df: DataFrame, keys=DEVICE_KEYS, ts="Date", v="Value", days: int = 28,
                tiebreak=None, block_days=None) -> DataFrame:
    """Previous row's exact median over the last n days (row 46)."""
    return _past(df, keys, ts, v, [Frame(f"Date_{v}_Last_{days}Days_Median", v, "median", days)],
                 tiebreak, block_days)


def _threshold_name(high: float) -> str:
    return str(int(high)) if float(high).is_integer() else str(high).replace(".", "_")


def past_count_above(df: DataFrame, keys=DEVICE_KEYS, ts="Date", v="Value", high: float = 70.0,
                     days: Iterable[int] = (3, 7, 14, 28), tiebreak=None, block_days=None) -> DataFrame:
    """Previous row's count of ``v > high`` over the last n days, as DOUBLE (row 47)."""
    d = _prepare(df, keys, v).withColumn("__above", above_flag(v, high))
    frames = [Frame(f"Date_Count_{v}_Above_{_threshold_name(high)}_Last_{n}Days", "__above", "sum", n)
              for n in days]
    return framed(d, keys, ts, frames, tiebreak, block_days).drop("__above")


def past_minmax_range(df: DataFrame, keys=DEVICE_KEYS, ts="Date", v="Value",
                      days: Iterable[int] = (3, 7, 14, 28), tiebreak=None, block_days=None) -> DataFrame:
    """Previous row's ``max - min`` over the last n days (row 48)."""
    return _past(df, keys, ts, v, [Frame(f"Date_MinMax_Range_Last_{n}Days", v, "range", n) for n in days],
                 tiebreak, block_days)


def shift_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, col: str, n: int = 1,
               name: str | None = None) -> DataFrame:
    """Value of the row ``n`` places earlier in the group, later where ``n`` is negative (``lag``/``lead``; row 49).

    ``order`` must make the order unique (add a tie-break column). The table is sorted once, by range; a task goes over its
    sorted rows and finds the value of every row that has the other one in the same partition. Only the first
    ``n`` rows of a partition are left open: they are joined by place with the last ``n`` rows of the partitions before.
    So neither a large group nor a table without groups (``keys`` empty) is one task, and no row but
    these is moved again. NULL keys are a group, as with ``lag``.
    """
    order = [order] if isinstance(order, str) else list(order)
    name, keys, steps = name or f"{col}_shift_{n}", list(keys), abs(int(n))
    if not steps:
        return df.select("*", F.col(f"`{col}`").alias(name))
    back = [F.col(f"`{c}`").asc() if n > 0 else F.col(f"`{c}`").desc() for c in order]  # later rows: the same from the end
    dealt = df.select("*", F.col(f"`{col}`").alias("__shifted")).orderBy(*[F.col(f"`{k}`") for k in keys], *back)
    place, value = [df.columns.index(k) for k in keys], df.columns.index(col)
    names = [*df.columns, "__shifted", "__part", "__pos", "__open", "__halo"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, group = TaskContext.get().partitionId(), 0, 0
        tail: list[pa.RecordBatch] = []  # the last rows so far, as many as a shift reaches back
        held = np.zeros(0, np.int64)  # the groups that they are in
        before: list | None = None

        def out(batch: pa.RecordBatch, shifted: pa.Array, first: int, opened: np.ndarray, halo: bool) -> pa.RecordBatch:
            k = batch.num_rows
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], shifted, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(first, first + k)), pa.array(opened),
                 pa.array(np.full(k, halo))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.zeros(batch.num_rows, bool)
            for i in place:
                code = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                starts[1:] |= code[1:] != code[:-1]
            here = [batch.column(i)[0] for i in place]
            starts[0] = before is not None and any(not x.equals(y) for x, y in zip(here, before))
            before = [batch.column(i)[batch.num_rows - 1] for i in place]
            groups = group + np.cumsum(starts)
            group = int(groups[-1])
            whole = pa.Table.from_batches([*tail, batch]).combine_chunks().to_batches()[0]
            all_groups = np.concatenate([held, groups])
            at = np.arange(len(held), len(all_groups)) - steps
            found = (at >= 0) & (all_groups[np.maximum(at, 0)] == groups)
            shifted = whole.column(value).take(pa.array(np.maximum(at, 0), mask=~found))
            yield out(batch, shifted, seen, at < 0, False)
            seen += batch.num_rows
            keep = min(steps, whole.num_rows)
            tail, held = [whole.slice(whole.num_rows - keep)], all_groups[len(all_groups) - keep:]
        if tail:
            last = tail[0]
            yield out(last, last.column(value), seen - last.num_rows, np.zeros(last.num_rows, bool), True)

    schema = T.StructType([*dealt.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__pos", T.LongType()),
                           T.StructField("__open", T.BooleanType()), T.StructField("__halo", T.BooleanType())])
    rows = materialised(dealt.mapInArrow(walk, schema), "shifted")
    ends = rows.filter("__halo").groupBy("__part").agg((F.max("__pos") + 1).alias("__size"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    first = ends.select("__part", F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__first"))
    halo = rows.filter("__halo").join(first, "__part").select((F.col("__first") + F.col("__pos") + steps).alias("__for"), F.col("__shifted").alias("__value"),
                                                              *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)])
    wanted = rows.filter("__open").join(first, "__part").withColumn("__at", F.col("__first") + F.col("__pos"))
    same = F.col("__at") == F.col("__for")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    joined = wanted.join(halo, same, "left").select(*columns, F.col("__value").alias(name))
    return rows.filter("NOT __open AND NOT __halo").select(*columns, F.col("__shifted").alias(name)).unionByName(joined)


def rolling_stat(df: DataFrame, keys=DEVICE_KEYS, ts="Date", col="Value", days: int = 14,
                 stat: str = "max", tiebreak=None, block_days=None, name: str | None = None) -> DataFrame:
    """``<col>_Last_<n>Days_<Stat>`` over ``(t - n days, t]`` up to the row itself, no shift (row 61)."""
    name = name or f"{col}_Last_{days}Days_{stat.capitalize()}"
    d = _prepare(df, keys, col)
    return framed(d, keys, ts, [Frame(name, col, stat, days, "past", False)], tiebreak, block_days)


FEATURE_COLUMNS = FX.FEATURE_COLUMNS


def engineer_features(df: DataFrame, value_col: str = FX.VALUE_COLUMN, high: float = FX.HIGH_THRESHOLD,
                      target: float = FX.TARGET_THRESHOLD, horizon_days: int = FX.HORIZON_DAYS,
                      keys: Sequence[str] = DEVICE_KEYS, ts: str = FX.TIME_COLUMN,
                      tiebreak: Sequence[str] | None = None, block_days: int | None = None) -> DataFrame:
    """The flagship device feature table (row 50).

    Output: ``Date``, the other raw columns, ``Date_Next_2Weeks``, ``Date_Next_3Weeks``,
    the device keys, then ``FEATURE_COLUMNS``. Missing numbers become 0.
    ``block_days``: length of the time blocks (see ``framed``); results don't depend on it.
    """
    keys = list(keys)
    missing = [c for c in keys + [ts, value_col] if c not in df.columns]
    if missing:
        raise ValueError(f"engineer_features: missing columns {missing}")
    d = _prepare(df, keys, value_col)
    if not isinstance(d.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType)):
        d = d.withColumn(ts, F.to_timestamp_ntz(F.col(ts)))
    for name, days in FX.DATE_OFFSETS:
        d = d.withColumn(name, add_days(ts, days))
    d = d.withColumn("__above", above_flag(value_col, high))
    v = value_col
    frames = [
        Frame(FX.FUTURE_MAX, v, "max", horizon_days, "future", False),
        Frame(FX.LAST_1_DAY, v, "max", 1),
        Frame(FX.LAST_3_DAYS, v, "max", 3),
        Frame(FX.SDEV_28_DAYS, v, "std", 28),
        Frame(FX.MEDIAN_28_DAYS, v, "median", 28),
        *[Frame(name, "__above", "sum", n) for name, n in FX.COUNT_ABOVE],
        *[Frame(name, v, "range", n) for name, n in FX.MINMAX_RANGE],
    ]
    raw = [c for c in d.columns if c not in keys and c != ts and c != "__above"]
    tb = list(tiebreak) if tiebreak is not None else _default_tiebreak(d.drop("__above"), keys, ts)
    out = framed(d, keys, ts, frames, tb, block_days)
    out = out.withColumn(FX.FUTURE_MAX, F.coalesce(F.col(FX.FUTURE_MAX), F.lit(0.0)))
    out = out.withColumn(FX.TARGET, above_flag(FX.FUTURE_MAX, target, inclusive=True))
    out = out.select(F.col(ts), *[F.col(f"`{c}`") for c in raw], *[F.col(k) for k in keys],
                     *[F.col(c) for c in FEATURE_COLUMNS])
    return fill_missing(out, 0)
