"""User functions over whole groups.

Each group reaches the function whole, as one pandas frame in one task, so a group
must fit in one task's memory: use keys that bound the group (for time series,
add a time bucket to the device key). The built-in operators never rely on it.
"""

from __future__ import annotations

import inspect
import itertools
from typing import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grouped_apply(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame | Mapping],
                  schema: str, partitions: int | None = None) -> DataFrame:
    """Run ``fn`` on each group as a pandas frame; rows out follow ``schema``.

    ``fn`` takes the group's frame (or its key and the frame) and returns a frame, or a mapping
    (column to value) for a single row, which is several times cheaper for small groups.

    The input is hash-partitioned by the keys into ``partitions`` (default
    ``spark.sql.shuffle.partitions``) before grouping; the grouping reuses that
    partitioning. A fixed count keeps the Python work spread over tasks: AQE
    would otherwise merge small shuffle partitions by bytes, and a few MB of
    input can carry minutes of Python work.

    Sorted rows go to Python in batches of many groups, cut there where Spark marks a new
    one: ``applyInPandas`` sends an Arrow stream for each group, milliseconds a group.
    """
    n = int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, names, keyed = list(keys), list(df.columns), len(inspect.signature(fn).parameters) == 2
    # a group without nulls has whole numbers whatever the rest of its batch holds: nulls travel beside them
    whole = [(f.name, isinstance(f.dataType, T.BooleanType)) for f in df.schema
             if f.nullable and isinstance(f.dataType, (T.IntegralType, T.BooleanType))]
    marked = df.repartition(n, *keys).withColumn(
        "__first", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) == 1)
    sent = marked.select(
        "__first", *[F.col(f"`{c}`").isNull().alias(f"__null_{c}") for c, _ in whole],
        *[F.coalesce(F.col(f"`{c}`"), F.lit(False if dict(whole)[c] else 0).cast(df.schema[c].dataType)).alias(c)
          if c in dict(whole) else F.col(f"`{c}`") for c in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list = []

        def apply(group: pd.DataFrame) -> int:
            frame = group[names].copy() if whole else group.copy()
            frame.index = pd.RangeIndex(len(frame))
            for c, boolean in whole:
                if (gone := group[f"__null_{c}"].to_numpy()).any():
                    frame[c] = frame[c].astype(object if boolean else "float64")
                    frame.loc[gone, c] = None
            out = fn(tuple(frame[k].iloc[0] for k in keys), frame) if keyed else fn(frame)
            made.append(out)
            return len(out) if isinstance(out, pd.DataFrame) else 1

        def column(values: list) -> pd.Series:
            found = pd.Series(values)
            if found.dtype.kind == "f" and any(isinstance(v, (int, np.integer)) for v in values):
                return pd.Series(values, dtype=object)  # whole numbers beside nulls stay exact
            return found

        def flush() -> Iterator[pd.DataFrame]:
            def kind(out):
                return (tuple(out.columns), tuple(out.dtypes)) if isinstance(out, pd.DataFrame) else tuple(out)

            for k, alike in itertools.groupby([o for o in made if not isinstance(o, pd.DataFrame) or len(o)], kind):
                alike = list(alike)
                if isinstance(alike[0], pd.DataFrame):
                    yield pd.concat(alike, ignore_index=True)
                else:
                    yield pd.DataFrame({c: column([o[c] for o in alike]) for c in k})
            made.clear()

        held, rows = [], 0  # the frames of the group that goes on
        for batch in batches:
            starts = np.flatnonzero(batch.pop("__first").to_numpy())
            cuts = [0, *starts.tolist(), len(batch)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if i and held:
                    rows += apply(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))
                    held = []
                if b > a:
                    held.append(batch.iloc[a:b])
                if rows >= 10_000:
                    yield from flush()
                    rows = 0
        if held:
            apply(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))
        yield from flush()

    return sent.mapInPandas(run, schema)
