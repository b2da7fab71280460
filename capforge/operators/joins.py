"""Joins.

No join here is hinted: Spark and AQE choose broadcast, shuffled-hash or
sort-merge from runtime sizes. The only explicit ``broadcast`` is on a one-row
parameter table, whose size is fixed.
"""

from __future__ import annotations

from typing import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capforge.functions import fixed as FX
from capforge.functions import scalar as S
from capforge.session import materialised

HOST_METRICS = ("core_number", "cpu_usage_percentage", "memory_number", "memory_usage_percentage")
GAP_COLUMNS = ("hostname", "host_id", "datetime_1", "datetime_2", *[f"{m}_avg" for m in HOST_METRICS])


def _gap_rows(df: DataFrame, host_id: int | None, host_col: str, ts_col: str, metrics: Sequence[str]) -> DataFrame:
    """``(hostname, host_id, __t, metrics)`` of the host, or of all."""
    base = df.select(F.col(host_col).alias("hostname"), S.host_id(host_col).alias("host_id"),
                     F.col(ts_col).alias("__t"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return base if host_id is None else base.filter(F.col("host_id") == F.lit(int(host_id)))


def _gap_partners(base: DataFrame, gap_days: int, metrics: Sequence[str]) -> DataFrame:
    """Right rows keyed ``(__rh, __rt = t - gap)``."""
    shift = F.make_dt_interval(F.lit(int(gap_days)))
    return (base.filter(F.col("host_id").isNotNull() & F.col("__t").isNotNull())
                .select(F.col("host_id").alias("__rh"), (F.col("__t") - shift).alias("__rt"),
                        F.col("__t").alias("datetime_2"), *[F.col(m).alias(f"__r_{m}") for m in metrics]))


def _gap_sides(df: DataFrame, gap_days: int, host_id: int | None, host_col: str, ts_col: str,
               metrics: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Left rows ``(hostname, host_id, __t, metrics)`` and right rows keyed ``(__rh, __rt = t - gap)``."""
    base = _gap_rows(df, host_id, host_col, ts_col, metrics)
    return base, _gap_partners(base, gap_days, metrics)


def _pair(left: DataFrame, right: DataFrame, metrics: Sequence[str]) -> DataFrame:
    j = left.join(right, (F.col("host_id") == F.col("__rh")) & (F.col("__t") == F.col("__rt")), "left")
    return j.select(
        "hostname", "host_id", F.col("__t").alias("datetime_1"), "datetime_2",
        *[((F.col(m) + F.col(f"__r_{m}")) / F.lit(2.0)).alias(f"{m}_avg") for m in metrics])


def gap_join(df: DataFrame, gap_days: int = FX.GAP_DAYS, host_id: int | None = None,
             host_col: str = "hostname", ts_col: str = "datetime",
             metrics: Sequence[str] = HOST_METRICS) -> DataFrame:
    """Pair each host row at ``t`` with the same host's rows at exactly ``t + gap`` (row 24).

    Left outer: unmatched rows are kept with NULL partner columns; duplicate
    ``(host, t)`` keys multiply; a NULL host id never matches. The right side is
    projected to ``t - gap`` so the condition is a plain equi-join on
    ``(host_id, t)``: both sides hash-partition on the pair, so one busy host
    is spread over partitions by time.
    """
    left, right = _gap_sides(df, gap_days, host_id, host_col, ts_col, metrics)
    return _pair(left, right, metrics)


def sort_gap_rows(df: DataFrame) -> DataFrame:
    """Host id, then time, NULLs last; the remaining columns make the order unique."""
    first = [F.col("host_id").asc_nulls_last(), F.col("datetime_1").asc_nulls_last()]
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in ("host_id", "datetime_1")]
    return df.orderBy(*first, *rest)


def gap_row_count(df: DataFrame, gap_days: int = FX.GAP_DAYS, host_id: int | None = None, host_col: str = "hostname",
                  ts_col: str = "datetime") -> DataFrame:
    """Number of ``gap_join`` rows without building them: each left row counts its partners, at least 1.

    The right side is first counted per key (partial aggregation), so duplicated
    keys never multiply here. → one row ``row_count``.
    """
    left, right = _gap_sides(df, gap_days, host_id, host_col, ts_col, ())
    partners = right.groupBy("__rh", "__rt").agg(F.count(F.lit(1)).alias("__n"))
    j = left.join(partners, (F.col("host_id") == F.col("__rh")) & (F.col("__t") == F.col("__rt")), "left")
    return j.agg(F.coalesce(F.sum(F.coalesce(F.col("__n"), F.lit(1))), F.lit(0)).cast("long").alias("row_count"))


#: What stands for a missing key when keys are ordered (missing last).
_LAST = np.iinfo(np.int64).max


class _Head:
    """Of the rows seen so far those that the first ``n`` report rows may come from."""

    def __init__(self, n: int, gap: int):
        self.n, self.gap = n, gap
        self.keys: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.held: list[pa.RecordBatch] = []

    @staticmethod
    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return tuple(batch.column(batch.schema.get_field_index(c)).cast(pa.int64()).fill_null(int(_LAST)).to_numpy() for c in ("host_id", "__k"))

    def within(self, host: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Keys up to the n-th smallest left key so far."""
        if len(self.keys[0]) < self.n:
            return np.ones(len(host), bool)
        h, k = self.keys[0][-1], self.keys[1][-1]
        return (host < h) | ((host == h) & (t <= k))

    def kept(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        host, t = self.of(batch)
        partner = (host != _LAST) & (t != _LAST)
        return batch.filter(pa.array(self.within(host, t) | (partner & self.within(host, np.where(partner, t - self.gap, t)))))

    def add(self, batch: pa.RecordBatch) -> None:
        host, t = (np.concatenate(x) for x in zip(self.keys, self.of(batch)))
        first = np.lexsort((t, host))[:self.n]
        self.keys = host[first], t[first]
        self.held.append(self.kept(batch))

    def rows(self) -> int:
        return sum(b.num_rows for b in self.held)

    def shrink(self) -> None:
        self.held = [self.kept(b) for b in self.held]


def _gap_digest(base: DataFrame, gap_days: int, n: int) -> DataFrame:
    """The host table read once → stored rows of two kinds. ``counts``: ``(host_id, __k, __left, __right)``, how many rows of a
    batch are left and right rows under a key. Others: the rows that the first ``n`` report rows may come from.

    A row is a left row under its own time and a right row under the time one gap earlier. Each task keeps the
    rows whose key, on either side, is at most the n-th smallest left key that it has seen: every left row yields a report
    row, so no later key reaches the first n, and all partners of the keys that do are kept by every task.
    """
    gap, columns = int(gap_days) * S.DAY_MICROS, base.columns
    keyed = base.withColumn("__k", S.epoch_micros("__t"))
    schema = T.StructType([*keyed.schema.fields, *[T.StructField(c, T.LongType()) for c in ("__left", "__right")]])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, names = _Head(n, gap), [*columns, "__k", "__left", "__right"]

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, *[pa.nulls(batch.num_rows, pa.int64())] * 2], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            host, t = _Head.of(batch)
            partner = (host != _LAST) & (t != _LAST)
            hosts, times = np.concatenate([host, host[partner]]), np.concatenate([t, t[partner] - gap])
            right = np.concatenate([np.zeros(len(host), np.int64), np.ones(int(partner.sum()), np.int64)])
            order = np.lexsort((times, hosts))
            hosts, times, right = hosts[order], times[order], right[order]
            start = np.flatnonzero(np.concatenate([[True], (hosts[1:] != hosts[:-1]) | (times[1:] != times[:-1])]))
            rights = np.add.reduceat(right, start)
            lefts = np.diff(np.concatenate([start, [len(right)]])) - rights
            kind = {f.name: f.type for f in batch.schema}
            made = {"host_id": pa.array(hosts[start], mask=hosts[start] == _LAST).cast(kind["host_id"]),
                    "__k": pa.array(times[start], mask=times[start] == _LAST), "__left": pa.array(lefts), "__right": pa.array(rights)}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(len(start), kind[c]) for c in names], names)
            head.add(batch)
            if head.rows() > HELD_ROWS:
                head.shrink()
                if head.rows() > HELD_ROWS // 2:  # very many rows of one time: handed on as they are
                    yield from map(rows, head.held)
                    head.held = []
        head.shrink()
        yield from map(rows, head.held)

    return materialised(keyed.mapInArrow(digest, schema), "gap-digest")


#: Rows that a task holds for the head of the report before it hands them on.
HELD_ROWS = 100_000


def gap_report(df: DataFrame, columns: str | Iterable[str], gap_days: int = FX.GAP_DAYS,
               host_id: int | None = None, n: int = FX.GAP_REPORT_ROWS, metrics: Sequence[str] = HOST_METRICS) -> DataFrame:
    """``gap_join`` + full row count + the first ``n`` rows of the requested columns (row 25).

    The host table is read once (``_gap_digest``): what is stored of it are the rows that the first ``n`` report rows
    may come from, which are joined and sorted, and counts by key. Rows of a key multiply only in the count:
    left rows times partners, at least 1. Every reported row carries ``row_count``, ``gap_days`` and
    ``host_id_filter`` (``all`` when no host is given).
    """
    from capforge.operators.relational import parse_column_list, select_requested

    stored = _gap_digest(_gap_rows(df, host_id, "hostname", "datetime", metrics), gap_days, int(n))
    rows = stored.filter("__left IS NULL").select("hostname", "host_id", "__t", *metrics)
    top = sort_gap_rows(_pair(rows, _gap_partners(rows, gap_days, metrics), metrics)).limit(int(n))
    rank_cols = [F.col("host_id").asc_nulls_last(), F.col("datetime_1").asc_nulls_last()] + [
        F.col(c).asc_nulls_last() for c in top.columns if c not in ("host_id", "datetime_1")]
    # numbering the n reported rows (a window over at most n rows)
    top = top.withColumn("row_number", F.row_number().over(Window.orderBy(*rank_cols)))
    pairs = stored.filter("__left IS NOT NULL").groupBy("host_id", "__k").agg(F.sum("__left").alias("l"), F.sum("__right").alias("r"))
    count = pairs.agg(F.coalesce(F.sum(F.col("l") * F.greatest("r", F.lit(1))), F.lit(0)).cast("long").alias("row_count")).select(
        F.lit(int(gap_days)).alias("gap_days"), F.lit("all" if host_id is None else str(host_id)).alias("host_id_filter"), "row_count")
    picked = select_requested(top, parse_column_list(columns) + ["row_number"])
    return picked.crossJoin(F.broadcast(count))


def params_join(df: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """Attach a one-row parameter table to every row (row 26). The parameter row is broadcast."""
    spark = df.sparkSession
    fields, values = [], []
    for k, v in params.items():
        if isinstance(v, bool):
            t = T.BooleanType()
        elif isinstance(v, int):
            t = T.IntegerType()
        elif isinstance(v, float):
            t = T.DoubleType()
        else:
            t = T.StringType()
            v = None if v is None else str(v)
        fields.append(T.StructField(k, t, True))
        values.append(v)
    p = spark.createDataFrame([tuple(values)], T.StructType(fields))
    return df.crossJoin(F.broadcast(p))


def exists_flag(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None,
                name: str = "has_engineered") -> DataFrame:
    """Per left row, whether any right row has the key (row 27) — one join, not one lookup per row.

    The right keys are de-duplicated first (map-side partial aggregate), so the
    join cannot multiply left rows.
    """
    right_key = right_key or left_key
    keys = right.select(F.col(right_key).alias("__ek")).filter(F.col("__ek").isNotNull()).distinct()
    j = left.join(keys.withColumn("__hit", F.lit(True)), F.col(left_key) == F.col("__ek"), "left")
    return j.select(*[F.col(f"`{c}`") for c in left.columns], F.coalesce(F.col("__hit"), F.lit(False)).alias(name))


def child_count(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
                name: str = "dataset_count") -> DataFrame:
    """Per parent row, the number of children, 0 when none (row 28)."""
    counts = child.groupBy(F.col(child_key).alias("__ck")).agg(F.count(F.lit(1)).alias("__n"))
    j = parent.join(counts, F.col(parent_key) == F.col("__ck"), "left")
    return j.select(*[F.col(f"`{c}`") for c in parent.columns], F.coalesce(F.col("__n"), F.lit(0)).cast("long").alias(name))


def model_features(models: DataFrame, selections: DataFrame, model_id: str = "id",
                   selection_key: str = "selection_id", selection_id: str = "id",
                   features: str = "selected_features") -> DataFrame:
    """Model → its selection run → one row per selected feature with its position (row 29)."""
    s = selections.select(F.col(selection_id).alias("__sid"), F.col(features).alias("__f"))
    j = models.select(F.col(model_id).alias("model_id"), F.col(selection_key).alias("__sk")).join(
        s, F.col("__sk") == F.col("__sid"), "inner")
    return j.select("model_id", F.posexplode("__f").alias("position", "feature"))


def broken_model_links(models: DataFrame, selections: DataFrame, selection_key: str = "selection_id",
                       selection_id: str = "id") -> DataFrame:
    """Models whose selection run is missing (the reference raises for these)."""
    return models.join(selections.select(F.col(selection_id).alias("__sid")),
                       F.col(selection_key) == F.col("__sid"), "left_anti")


def purge_project(project_id, tables: Mapping[str, tuple[DataFrame, str]],
                  children: Mapping[str, tuple[DataFrame, str, str]] | None = None) -> dict[str, DataFrame]:
    """Rows that survive deleting one project (row 30).

    ``tables``: name → (registry frame, its project-id column).
    ``children``: name → (frame, its foreign key, parent table name): rows pointing
    at a deleted parent row are deleted too (``left_anti`` on the doomed keys).
    The parent's own key column is assumed to be ``id``.
    Writing the survivors back is ``sources.tables.replace_table`` (lineage is cut
    before the overwrite, so a table can be rewritten from itself).
    """
    out: dict[str, DataFrame] = {}
    for name, (df, pcol) in tables.items():
        out[name] = df.filter(F.col(pcol).isNull() | (F.col(pcol) != F.lit(project_id)))
    for name, (df, fk, parent) in (children or {}).items():
        pdf, pcol = tables[parent]
        doomed = pdf.filter(F.col(pcol) == F.lit(project_id)).select(F.col("id").alias("__doomed")).distinct()
        out[name] = df.join(doomed, F.col(fk) == F.col("__doomed"), "left_anti")
    return out


def params_frame(spark: SparkSession, params: Mapping[str, object]) -> DataFrame:
    return params_join(spark.range(1).drop("id"), params)
