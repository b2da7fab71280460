"""Sums over pairs of columns, in blocks of columns.

A wide table is read block by block: a scan of the columns of one block, or of two, gives one small row of sums a task, and
rows of a block are merged in two levels (by block and slice, then by block), so that neither a task's memory nor a
merge grows with the table's width squared. Parquet reads only the columns of the block.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block: of the target's partners, and of a tile's sides.
PARTNERS, TILE = 512, 256
#: Slices in which rows of a block are merged first.
SLICES = 64


def blocks(n: int, size: int) -> list[range]:
    return [range(i, min(n, i + size)) for i in range(0, n, size)]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The columns side by side, NaN where missing."""
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


# ------------------------------------------------------------------ one column with all others

def _batch_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(6, k): rows, means and squared deviations of both, and their product, over the rows where both are present."""
    m = ~np.isnan(x) & ~np.isnan(y)[:, None]
    n = m.sum(axis=0)
    first = np.argmax(m, axis=0)  # deviations from a value of the column: exactly 0 where it is constant
    x0, y0 = x[first, np.arange(x.shape[1])], y[first]
    dx, dy = np.where(m, x - x0, 0.0), np.where(m, y[:, None] - y0, 0.0)
    some = np.maximum(n, 1)
    ax, ay = dx.sum(axis=0) / some, dy.sum(axis=0) / some
    dx, dy = np.where(m, dx - ax, 0.0), np.where(m, dy - ay, 0.0)
    out = np.stack([n, x0 + ax, y0 + ay, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0)])
    return np.where(n > 0, out, 0.0)


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    dx, dy = np.where(a[0] * b[0] > 0, b[1:3] - a[1:3], 0.0)
    share, weight = b[0] / some, a[0] * b[0] / some
    means = np.where(a[0] > 0, a[1:3] + np.stack([dx, dy]) * share, b[1:3])
    return np.stack([n, *means, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight])


def correlations_with(numbers: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(at, correlation): Pearson of each column with ``target`` on the rows where both are present, NULL when a side is
    constant or there are fewer than two rows. ``numbers``: DOUBLE columns without NaN."""

    def summed(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                with np.errstate(all="ignore"):
                    here = _batch_moments(x[:, 1:], x[:, 0])
                    total = here if total is None else _merge(total, here)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["block", "s"])

    def merged(table: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            total = reduce(_merge, (np.array(s.as_py()).reshape(6, -1) for s in table["s"]))
        return pa.table({"block": table["block"][:1], "s": pa.array([total.ravel()], pa.list_(pa.float64()))})

    def final(table: pa.Table) -> pa.Table:
        at = table["block"][0].as_py() * PARTNERS
        n, _, _, xx, yy, xy = np.array(merged(table)["s"][0].as_py()).reshape(6, -1)
        with np.errstate(all="ignore"):
            r = np.where((n > 1) & (xx > 0) & (yy > 0), xy / (np.sqrt(xx) * np.sqrt(yy)), np.nan)
        return pa.table({"at": pa.array(np.arange(at, at + len(r)), pa.int32()), "correlation": pa.array(r, from_pandas=True)})

    parts = []
    for b, block in enumerate(blocks(len(columns), PARTNERS)):
        some = numbers.select(target, *[columns[i] for i in block])
        parts.append(some.mapInArrow(lambda batches, b=b: summed(batches, b), "block int, s array<double>"))
    sums = _union(parts).withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(SLICES)) + F.spark_partition_id() % SLICES)
    once = sums.groupBy("block", "slice").applyInArrow(merged, "block int, s array<double>")
    return once.groupBy("block").applyInArrow(final, "at int, correlation double")


# ------------------------------------------------------------------ all pairs

def _summed(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows (tile, s) of tasks → one row a tile, added in two levels."""
    rows = _union(parts).select("tile", F.pmod(F.spark_partition_id(), F.lit(SLICES)).alias("slice"), array_to_vector("s").alias("v"))
    once = rows.groupBy("tile", "slice").agg(Summarizer.sum(F.col("v")).alias("v"))
    return once.groupBy("tile").agg(Summarizer.sum(F.col("v")).alias("v")).select("tile", vector_to_array("v").alias("s"))


def _means(numbers: DataFrame) -> np.ndarray:
    """Each column's mean, 0 where it has no value."""

    def sums(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                here = np.stack([np.nansum(x, axis=0), (~np.isnan(x)).sum(axis=0)])
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["tile", "s"])

    found = blocks(len(numbers.columns), TILE)
    parts = [numbers.select(*[numbers.columns[i] for i in block]).mapInArrow(lambda batches, b=b: sums(batches, b), "tile int, s array<double>")
             for b, block in enumerate(found)]
    out = np.zeros(len(numbers.columns))
    for r in _summed(parts).collect():  # two numbers a column
        s, n = np.array(r.s).reshape(2, -1)
        out[found[r.tile]] = np.where(n > 0, s / np.maximum(n, 1), 0.0)
    return np.where(np.isfinite(out), out, 0.0)


def all_correlations(numbers: DataFrame) -> DataFrame:
    """(i, j, correlation) for all i < j, Pearson on the rows where both columns are present; NULL when a side is constant or
    there are fewer than two such rows. ``numbers``: DOUBLE columns without NaN.

    A tile is a block of columns with itself or a later one: four sums for each of its pairs (rows where both are present,
    sums and squares of one where the other is, products), of columns less their means.
    """
    names, found, mu = numbers.columns, blocks(len(numbers.columns), TILE), _means(numbers)
    tiles = [(a, b) for a in range(len(found)) for b in range(a, len(found))]

    def sums(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
        a, b = (found[k] for k in tiles[tile])
        shift, k, acc = np.concatenate([mu[a], mu[b]]), len(a), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            x = (x if a != b else np.concatenate([x, x], axis=1)) - shift
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x, 0.0)
            (x1, x2), (m1, m2) = (x[:, :k], x[:, k:]), (m[:, :k], m[:, k:])
            here = np.stack([m1.T @ m2, x1.T @ m2, m1.T @ x2, (x1 * x1).T @ m2, m1.T @ (x2 * x2), x1.T @ x2])
            acc = here if acc is None else acc + here
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([acc.ravel()], pa.list_(pa.float64()))], ["tile", "s"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (found[k] for k in tiles[batch.column(0)[row].as_py()])
                s = batch.column(1)[row].values.to_numpy(zero_copy_only=False).reshape(6, len(a), len(b))
                n, sa, sb, qa, qb, sab = s
                with np.errstate(all="ignore"):
                    cab, caa, cbb = sab - sa * sb / n, qa - sa * sa / n, qb - sb * sb / n
                    r = np.where((n > 1) & (caa > 0) & (cbb > 0), cab / np.sqrt(caa * cbb), np.nan)
                i, j = (g.ravel() for g in np.meshgrid(np.array(a), np.array(b), indexing="ij"))
                keep = i < j
                yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()),
                                                  pa.array(r.ravel()[keep], from_pandas=True)], ["i", "j", "correlation"])

    parts = []
    for t, (a, b) in enumerate(tiles):
        some = numbers.select(*[names[i] for i in found[a]], *([names[i] for i in found[b]] if a != b else []))
        parts.append(some.mapInArrow(lambda batches, t=t: sums(batches, t), "tile int, s array<double>"))
    return _summed(parts).mapInArrow(pairs, "i int, j int, correlation double")
