"""Table profiles and correlations.

Every statistic over all columns is one aggregate pass (partial aggregation on
the map side); results are unpivoted from that single row. Exact medians come from radix selection
(``selection``), distinct and frequent values from counts by digest (``valuecounts``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capforge.functions import fixed as FX
from capforge.functions.scalar import nan_to_null
from capforge.operators import comoments, selection, valuecounts
from capforge.operators.relational import numeric_columns, rows_to_json


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _num(df: DataFrame, name: str) -> Column:
    """A numeric column as DOUBLE with NaN read as missing (booleans count as 0/1)."""
    c = _c(name).cast("double")
    return nan_to_null(c)


def _is_missing(df: DataFrame, f: T.StructField) -> Column:
    c = _c(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _unpivot_row(agg_row: DataFrame, names: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One-row frame with columns ``{name}__{stat}`` → rows ``(column, stat...)``."""
    packed = F.array(*[F.struct(F.lit(n).alias("column"),
                                *[F.col(f"`{n}__{s}`").alias(s) for s in stats]) for n in names])
    return agg_row.select(F.inline(packed))


def table_metadata(df: DataFrame, n: int = 1, order: Sequence[str] = ()) -> DataFrame:
    """Column list ``(ordinal, column_name, data_type, nullable)`` with the table's ``row_count`` and its first ``n`` rows
    as a JSON array, ``sample_rows`` (row 31).

    The column list comes from the schema; the count is one aggregate that reads no column (Parquet: the files' footers).
    ``order``: the columns that say which rows are first, NULLs last; none: any rows. Values as in ``rows_to_json``.
    """
    spark = df.sparkSession
    cols = spark.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString(), bool(f.nullable)) for i, f in enumerate(df.schema.fields)],
        "ordinal int, column_name string, data_type string, nullable boolean")
    count = df.agg(F.count(F.lit(1)).alias("row_count"))
    first = df.orderBy(*[_c(c).asc_nulls_last() for c in order]) if order else df
    # at most n rows, numbered in their order before they meet in one array
    rows = rows_to_json(first.limit(int(n))).withColumn("at", F.monotonically_increasing_id())
    sample = rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "json"))), lambda r: r["json"]), ","),
                               F.lit("]")).alias("sample_rows"))
    return cols.crossJoin(F.broadcast(count)).crossJoin(F.broadcast(sample))


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as DOUBLE with NaN read as missing, c0, c1, ... (as SQL text: one call for any number of them)."""
    return df.selectExpr(*[f"nanvl(CAST({valuecounts.quoted(c)} AS DOUBLE), CAST(NULL AS DOUBLE)) AS c{i}" for i, c in enumerate(columns)])


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median (mean of the two middle values) per column → ``(column, median)``; NULL without values.

    By radix selection (``selection``): at most three passes, each for all columns together.
    """
    columns = list(columns)
    found = selection.summaries(_numbers(df, columns))[1] if columns else []
    return df.sparkSession.createDataFrame([(c, s.median) for c, s in zip(columns, found)], "column string, median double")


def profile_numeric(df: DataFrame, approx: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: ``min, max, mean, median, std`` (sample), NULL when undefined (row 32).

    All but the median come from the first of its passes (``selection``). ``approx=True`` takes
    ``percentile_approx`` for the median in one aggregate.
    """
    cols = list(columns) if columns is not None else numeric_columns(df, include_bool=True)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, min double, max double, mean double, median double, std double")
    if approx:
        aggs = []
        for c in cols:
            v = _num(df, c)
            aggs += [F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"), F.avg(v).alias(f"{c}__mean"),
                     F.percentile_approx(v, 0.5, 10000).cast("double").alias(f"{c}__median"), F.stddev_samp(v).alias(f"{c}__std")]
        return _unpivot_row(df.agg(*aggs), cols, ["min", "max", "mean", "median", "std"])
    found = selection.summaries(_numbers(df, cols))[1]
    return df.sparkSession.createDataFrame([(c, s.min, s.max, s.mean, s.median, s.std) for c, s in zip(cols, found)],
                                           "column string, min double, max double, mean double, median double, std double")


def categorical_columns(df: DataFrame) -> list[str]:
    num = set(numeric_columns(df, include_bool=True))
    return [f.name for f in df.schema.fields if f.name not in num]


def profile_categorical(df: DataFrame, approx: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct count per non-numeric column, NULL excluded → ``(column, unique_count)`` (row 33).

    Counted by digest (``valuecounts``): whole texts aren't shuffled.
    """
    cols = list(columns) if columns is not None else categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, unique_count bigint")
    if approx:
        row = df.agg(*[F.approx_count_distinct(_c(c)).alias(f"{c}__unique_count") for c in cols])
        return _unpivot_row(row, cols, ["unique_count"])
    found = valuecounts.per_column(valuecounts.value_counts(df, cols))
    return df.sparkSession.createDataFrame([(c, found.get(i, (0, 0))[0]) for i, c in enumerate(cols)], "column string, unique_count bigint")


def _named(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a column number get its name."""
    names = F.array(*[F.lit(c) for c in cols])
    return df.withColumn("column", F.element_at(names, F.col("id") + 1))


def top_values(df: DataFrame, k: int = FX.TOP_VALUES, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` most frequent values per non-numeric column, NULL excluded (row 34).

    → ``(column, rank, value, count)``; ties by value ascending. Counted by digest (``valuecounts``); the rank filters
    are planned with a partial group limit before the shuffle.
    """
    cols = list(columns) if columns is not None else categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, count bigint")
    return _named(valuecounts.top_counts(df, cols, valuecounts.value_counts(df, cols), k), cols).select("column", "rank", "value", "count")


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column (NULL, and NaN for floating columns) → ``(column, missing)`` (row 35)."""
    fields = df.schema.fields
    row = df.agg(*[F.count_if(_is_missing(df, f)).alias(f"{f.name}__missing") for f in fields])
    return _unpivot_row(row, [f.name for f in fields], ["missing"])


def dataset_statistics(df: DataFrame, k: int = FX.TOP_VALUES) -> DataFrame:
    """Rows 31–35 as one long table ``(column, stat, item, value)`` (row 36).

    stats: ``row_count``/``column_count`` (column ``*``), ``dtype`` (item = Spark type) for
    every column, ``min max mean median std``
    for numeric columns, ``unique_count`` and ``top_value`` (item = the value,
    value = its count) for the others, ``missing`` for every column.

    Passes over the data: up to three for the numeric columns (``selection``; the first also gives the
    row count and the moments), one for the others' value counts, and one more where frequent values are
    longer than a count's piece (``valuecounts``).
    """
    spark = df.sparkSession
    num, cat = numeric_columns(df, include_bool=True), categorical_columns(df)
    fields = df.schema.fields
    rows, found = selection.summaries(_numbers(df, num)) if num else (None, [])
    counts = valuecounts.value_counts(df, cat) if cat else None
    distinct = valuecounts.per_column(counts) if cat else {}
    if rows is None:
        rows = counts.filter("id = 0").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] if cat else df.count()
    missing = {c: rows - s.n for c, s in zip(num, found)} | {c: distinct.get(i, (0, 0))[1] for i, c in enumerate(cat)}
    facts: list[tuple] = [("*", "row_count", None, float(rows)), ("*", "column_count", None, float(len(fields)))]
    facts += [(f.name, "dtype", f.dataType.simpleString(), None) for f in fields]
    facts += [(f.name, "missing", None, float(missing[f.name])) for f in fields]
    facts += [(c, stat, None, getattr(s, stat)) for c, s in zip(num, found) for stat in ("min", "max", "mean", "median", "std")]
    facts += [(c, "unique_count", None, float(distinct.get(i, (0, 0))[0])) for i, c in enumerate(cat)]
    out = spark.createDataFrame(facts, "column string, stat string, item string, value double")
    if not cat:
        return out
    top = _named(valuecounts.top_counts(df, cat, counts, k), cat)
    return out.unionByName(top.select("column", F.lit("top_value").alias("stat"), F.col("value").alias("item"),
                                      F.col("count").cast("double").alias("value")))


def _pair_corr(x: Column, y: Column) -> Column:
    """Pearson on rows where both are present; NULL when a side is constant or < 2 pairs."""
    xc = F.when(y.isNotNull(), x)
    yc = F.when(x.isNotNull(), y)
    den = F.stddev_samp(xc) * F.stddev_samp(yc)
    return F.when(den > 0, F.covar_samp(xc, yc) / den)


#: Columns beyond which one generated aggregate is too long: then blocks of columns are summed (``comoments``).
WIDE = 200


def target_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson of every numeric column with ``target``, pairwise complete → ``(feature, correlation)`` (row 37)."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    if target not in cols and target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    feats = [c for c in cols if c != target]
    if not feats:
        return df.sparkSession.createDataFrame([], "feature string, correlation double")
    if len(feats) > WIDE:
        numbers = _numbers(df, [target, *feats])
        found = comoments.correlations_with(numbers, "c0", numbers.columns[1:])
        names = df.sparkSession.createDataFrame(list(enumerate(feats)), "at int, feature string")
        return names.join(found, "at", "left").select("feature", "correlation")
    y = _num(df, target)
    row = df.agg(*[_pair_corr(_num(df, c), y).alias(f"{c}__correlation") for c in feats])
    return _unpivot_row(row, feats, ["correlation"]).withColumnRenamed("column", "feature")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson for every pair ``i < j`` of numeric columns, pairwise complete → ``(column_1, column_2, correlation)`` (row 38).

    Tiles of column blocks (``comoments``): each task multiplies its Arrow batches (masked, mean-shifted columns)
    into the sums of one tile, and tiles are added in two levels. Up to ``comoments.TILE`` columns are one tile, so
    one scan after the means'. NULL when a side is constant or fewer than two pairs.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "column_1 string, column_2 string, correlation double")
    found = comoments.all_correlations(_numbers(df, cols))
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(F.element_at(names, F.col("i") + 1).alias("column_1"), F.element_at(names, F.col("j") + 1).alias("column_2"), "correlation")
