"""Exact medians of all columns of a table at once, by radix selection.

A double's bits, with the order of the negative ones turned round, are a 64-bit key of the same order. A pass counts, for
all columns together, the keys by their next digit below a known prefix; the digit that holds the middle rank is the
next prefix. With digits of 18, 23 and 23 bits three passes find any middle value; a pass also knows the smallest and
the largest value of each digit, and where these agree (whole numbers, few distinct values) the later passes are left out.

Tasks hold the counts of their own digits (handed on beyond ``HELD``), Spark adds them; two rows a column come to the
driver. No value is shuffled, no bound is guessed, and nothing depends on how rows are dealt.

The first pass also gives each column's present rows, smallest and largest value, mean and squared
deviations, merged task by task as running means are.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capforge.session import materialised

#: Bits of the digits, 64 in all.
DIGITS = (18, 23, 23)
#: Counted digits that a task holds for a column before it hands them on.
HELD = 200_000


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the doubles ``x`` (no NaN; both zeros are one)."""
    bits = (x + 0.0).view(np.uint64)
    negative = bits >> np.uint64(63) == 1
    return np.where(negative, ~bits, bits | np.uint64(1 << 63))


@dataclass
class Summary:
    """What is known of one column: present rows, and NaN-free statistics (None where undefined)."""

    n: int = 0
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std: float | None = None
    median: float | None = None


class _Counts:
    """Of one column (or one prefix of it): rows, smallest and largest value by digit."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, x: np.ndarray, shift: int) -> None:
        if len(x):
            x = np.sort(x + 0.0)
            digit = ordered_keys(x) >> np.uint64(shift)
            start = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1]]))
            end = np.concatenate([start[1:], [len(x)]])
            self.parts.append((digit[start], end - start, x[start], x[end - 1]))

    def merged(self) -> tuple[np.ndarray, ...]:
        digit, n, lo, hi = (np.concatenate(p) for p in zip(*self.parts))
        order = np.argsort(digit, kind="stable")
        digit, n, lo, hi = digit[order], n[order], lo[order], hi[order]
        start = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1]]))
        made = digit[start], np.add.reduceat(n, start), np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)
        self.parts = [made]
        return made

    def size(self) -> int:
        return sum(len(p[0]) for p in self.parts)


class _Moments:
    """Rows, extremes, mean and squared deviations, merged batch by batch."""

    def __init__(self):
        self.n, self.min, self.max, self.mean, self.m2, self.total = 0, np.inf, -np.inf, 0.0, 0.0, 0.0

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        n, mean = len(x), float(x.mean())
        step, total = mean - self.mean, self.n + n
        self.m2 += float(((x - mean) ** 2).sum()) + step * step * self.n * n / total
        self.mean += step * n / total if self.n else mean
        self.total = float(np.cumsum(np.concatenate([[self.total], x]))[-1])  # one by one, as SQL engines add
        self.n, self.min, self.max = total, min(self.min, float(x.min())), max(self.max, float(x.max()))


_SCHEMA = "id int, slot int, digit long, n long, lo double, hi double, mean double, m2 double, total double"


def _digit_counts(numbers: DataFrame, level: int, prefixes: dict[int, list[int]] | None) -> DataFrame:
    """Stored rows (id, slot, digit, n, lo, hi) of each column's digits, below prefix number ``slot`` of ``prefixes``.

    The first pass (no prefixes) also gives, with slot -1, a task's moments of each column and, with id -1, its rows.
    """
    shift, above = 64 - sum(DIGITS[:level + 1]), np.uint64(64 - sum(DIGITS[:level]))
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def rows(i: int, slot: int, digit: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, mean=None, m2=None, total=None) -> pa.RecordBatch:
        k = len(n)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(k, i, np.int32)), pa.array(np.full(k, slot, np.int32)), pa.array(digit.astype(np.int64)),
            pa.array(np.asarray(n, np.int64)), pa.array(lo, pa.float64()), pa.array(hi, pa.float64()),
            *[pa.array([v] * k, pa.float64()) for v in (mean, m2, total)]], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], _Counts] = {}
        moments: dict[int, _Moments] = {}
        total = 0
        for batch in batches:
            total += batch.num_rows
            for i in range(batch.num_columns) if prefixes is None else prefixes:
                x = batch.column(i).to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                parts = [x]
                if prefixes is None:
                    with np.errstate(all="ignore"):
                        moments.setdefault(i, _Moments()).add(x)
                else:
                    top = ordered_keys(x) >> above
                    parts = [x[top == np.uint64(p)] for p in prefixes[i]]
                for slot, part in enumerate(parts):
                    counts = held.setdefault((i, slot), _Counts())
                    counts.add(part, shift)
                    if counts.size() > HELD:
                        made = counts.merged()
                        if len(made[0]) > HELD // 2:
                            yield rows(i, slot, *made)
                            counts.parts = []
        for (i, slot), counts in held.items():
            if counts.parts:
                yield rows(i, slot, *counts.merged())
        zero, none = np.zeros(1, np.int64), np.array([np.nan])
        if prefixes is None:
            for i, m in moments.items():
                yield rows(i, -1, zero, [m.n], np.array([m.min]), np.array([m.max]), m.mean, m.m2, m.total)
            yield rows(-1, -1, zero, [total], none, none)

    return materialised(numbers.mapInArrow(count, _SCHEMA), f"digits-{level}")


def _found(counts: DataFrame, ranks: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int, int], tuple]:
    """(id, slot, rank) -> (digit, rows before it, lo, hi) of the digits that hold the ranks: at most two for each id and slot."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(i, s, r) for (i, s), some in ranks.items() for r in some], "id int, slot int, rank long")
    digits = counts.filter("slot >= 0").groupBy("id", "slot", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    upto = Window.partitionBy("id", "slot").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    running = digits.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    hit = running.join(F.broadcast(wanted), ["id", "slot"]).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    return {(r.id, r.slot, r["rank"]): (r.digit, r.before, r.lo, r.hi) for r in hit.collect()}


def summaries(numbers: DataFrame) -> tuple[int, list[Summary]]:
    """(rows, a summary of each column) of a table of DOUBLE columns without NaN (NULL: missing)."""
    columns = numbers.columns
    first = _digit_counts(numbers, 0, None)
    task = first.filter("slot < 0")
    whole = Window.partitionBy("id")
    mean = F.sum(F.when(F.col("n") > 0, F.col("mean") * F.col("n"))).over(whole) / F.sum("n").over(whole)
    spread = F.col("m2") + F.col("n") * (F.col("mean") - F.col("all_mean")) * (F.col("mean") - F.col("all_mean"))
    known = task.filter("n > 0").withColumn("all_mean", mean).groupBy("id").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("total") / F.sum("n")).alias("mean"), F.sum(spread).alias("m2"))
    out, rows = [Summary() for _ in columns], 0
    for r in known.collect():  # one row for each column
        if r.id < 0:
            rows = r.n
            continue
        std = (r.m2 / (r.n - 1)) ** 0.5 if r.n > 1 and r.m2 == r.m2 else float("nan") if r.n > 1 else None
        out[r.id] = Summary(r.n, r.lo, r.hi, r.mean, std)
    # the two middle ranks of each column: their prefix (none so far), and their place below it
    at = {(i, r): (0, r) for i, s in enumerate(out) if s.n for r in {(s.n - 1) // 2, s.n // 2}}
    value: dict[tuple[int, int], float] = {}
    slots: dict[int, list[int]] | None = None
    for level in range(len(DIGITS)):
        if not at:
            break
        counts = first if level == 0 else _digit_counts(numbers, level, slots)
        place = {key: 0 if slots is None else slots[key[0]].index(prefix) for key, (prefix, _) in at.items()}
        ranks: dict[tuple[int, int], list[int]] = {}
        for key, (_, rest) in at.items():
            ranks.setdefault((key[0], place[key]), []).append(rest)
        found = _found(counts, {k: sorted(set(v)) for k, v in ranks.items()})
        left = {}
        for key, (_, rest) in at.items():
            digit, before, lo, hi = found[(key[0], place[key], rest)]
            if lo == hi:
                value[key] = lo
            else:
                left[key] = (digit, rest - before)
        at = left
        slots = {i: sorted({p for (j, _), (p, _) in at.items() if j == i}) for i, _ in at}
    for i, s in enumerate(out):
        if s.n:
            lo, hi = value[(i, (s.n - 1) // 2)], value[(i, s.n // 2)]
            s.median = (lo + hi) / 2 if not np.isfinite([lo, hi]).all() or abs(lo) + abs(hi) < 1e308 else lo / 2 + hi / 2
    return rows, out
