"""Declared feature-pipeline steps and their runner.

A step row is ``(pipeline_id, feature_name, function_name, input_param_value,
sequence_num)``; ``input_param_value`` is JSON. The reference only declares these
(no executor), so the parameter names below are this library's design:

* ``filter``          ``{"condition": "<SQL predicate>"}``
* ``aggregate``       ``{"group_by": [...], "aggregations": {"<alias>": "<SQL aggregate>"}}``
* ``shift``           ``{"partition_by": [...], "order_by": [...], "column": c, "periods": 1, "name": alias}``
* ``date_conversion`` ``{"column": c, "to": "timestamp"|"date"|"string"|"trunc", "format": f, "unit": u, "name": alias}``
* ``join``            ``{"table": name, "on": [[left, right], ...], "how": "inner"}``

The steps of one pipeline are a handful of definition rows; they are read on
the driver to build one lazy plan (``DataFrame.transform`` per step).
"""

from __future__ import annotations

import json
from typing import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capforge.operators.windows import shift_rows

STEP_FUNCTIONS = ("filter", "aggregate", "shift", "date_conversion", "join")


def step_filter(df: DataFrame, condition: str) -> DataFrame:
    """Keep rows matching a SQL predicate (row 56); it is pushed into the scan when possible."""
    return df.filter(F.expr(condition))


def step_aggregate(df: DataFrame, group_by: Sequence[str], aggregations: Mapping[str, str]) -> DataFrame:
    """Group by keys with named SQL aggregates (row 57); partial aggregation before the shuffle."""
    return df.groupBy(*[F.col(c) for c in group_by]).agg(*[F.expr(e).alias(a) for a, e in aggregations.items()])


def step_shift(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], column: str,
               periods: int = 1, name: str | None = None) -> DataFrame:
    """``lag``/``lead`` of a column inside groups (declared step ``shift``; row 49); without ``partition_by``
    the whole table is one group, whose order must be unique like any other's."""
    return shift_rows(df, partition_by, order_by, column, int(periods), name)


def step_date_conversion(df: DataFrame, column: str, to: str = "timestamp", format: str | None = None,
                         unit: str | None = None, name: str | None = None) -> DataFrame:
    """String ↔ time, or truncate to a unit (row 58)."""
    c = F.col(column)
    if to == "timestamp":
        out = F.to_timestamp_ntz(c.cast("string"), F.lit(format)) if format else c.cast("timestamp_ntz")
    elif to == "date":
        out = F.to_date(c.cast("string"), format) if format else c.cast("date")
    elif to == "string":
        out = F.date_format(c, format or "yyyy-MM-dd HH:mm:ss")
    elif to == "trunc":
        out = F.date_trunc(unit or "day", c).cast("timestamp_ntz")
    else:
        raise ValueError(f"unknown date conversion: {to}")
    return df.withColumn(name or column, out)


def step_join(df: DataFrame, other: DataFrame, on: Sequence[Sequence[str]] | Sequence[str],
              how: str = "inner") -> DataFrame:
    """Join a second table on key pairs, kind given (row 59). Spark/AQE pick the join strategy."""
    how = how.lower()
    pairs = [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in on]
    if all(a == b for a, b in pairs):
        return df.join(other, on=[a for a, _ in pairs], how=how)
    cond = None
    for a, b in pairs:
        c = df[a] == other[b]
        cond = c if cond is None else cond & c
    return df.join(other, cond, how)


def apply_step(df: DataFrame, function_name: str, params: Mapping, tables: Mapping[str, DataFrame]) -> DataFrame:
    fn = function_name.lower()
    p = dict(params)
    if fn == "filter":
        return step_filter(df, p["condition"])
    if fn == "aggregate":
        return step_aggregate(df, p["group_by"], p["aggregations"])
    if fn == "shift":
        return step_shift(df, p.get("partition_by", []), p["order_by"], p["column"], p.get("periods", 1),
                          p.get("name"))
    if fn == "date_conversion":
        return step_date_conversion(df, p["column"], p.get("to", "timestamp"), p.get("format"), p.get("unit"),
                                    p.get("name"))
    if fn == "join":
        return step_join(df, tables[p["table"]], p["on"], p.get("how", "inner"))
    raise ValueError(f"unknown step function: {function_name}")


def run_pipeline(source: DataFrame, steps: DataFrame | Iterable[Mapping], pipeline_id: str | None = None,
                 tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run the steps of one pipeline in ``sequence_num`` order as one lazy plan (row 60)."""
    if isinstance(steps, DataFrame):
        s = steps
        if pipeline_id is not None:
            s = s.filter(F.col("pipeline_id") == F.lit(pipeline_id))
        rows = [r.asDict() for r in s.select(*[c for c in ("pipeline_id",) if c in s.columns], "function_name", "input_param_value", "sequence_num")
                .orderBy("sequence_num").collect()]
    else:
        rows = sorted((dict(r) for r in steps if pipeline_id is None or r.get("pipeline_id") == pipeline_id),
                      key=lambda r: r["sequence_num"])
    if pipeline_id is None and len({r.get("pipeline_id") for r in rows}) > 1:
        raise ValueError("the steps belong to several pipelines: name one by pipeline_id")
    out = source
    for r in rows:
        params = r["input_param_value"]
        if isinstance(params, str):
            params = json.loads(params)
        out = out.transform(_bind(r["function_name"], params, tables or {}))
    return out


def _bind(fn: str, params: Mapping, tables: Mapping[str, DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: apply_step(df, fn, params, tables)


def horizon_split(df: DataFrame, ts: str, cutoff: str, past_weeks: int = 12, n1_weeks: int = 4,
                  n2_weeks: int = 8, name: str = "part") -> DataFrame:
    """Label rows by time around a cutoff (row 62): ``train`` = the ``past_weeks`` before it,
    ``horizon_1`` = the first ``n1_weeks`` after it, ``horizon_2`` = from there up to
    ``n2_weeks`` after it. Rows outside every span are dropped.
    """
    t = F.col(ts)
    c = F.lit(cutoff).cast("timestamp_ntz")
    wk = lambda n: F.make_dt_interval(F.lit(7 * int(n)))
    part = (F.when((t >= c - wk(past_weeks)) & (t < c), F.lit("train"))
             .when((t >= c) & (t < c + wk(n1_weeks)), F.lit("horizon_1"))
             .when((t >= c + wk(n1_weeks)) & (t < c + wk(n2_weeks)), F.lit("horizon_2")))
    return df.withColumn(name, part).filter(F.col(name).isNotNull())
