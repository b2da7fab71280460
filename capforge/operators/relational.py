"""Projections, filters and predicates."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capforge.functions import fixed as FX
from capforge.functions import scalar as S


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def lookup_by_key(df: DataFrame, order: Sequence[str] | None = None, **eq) -> DataFrame:
    """Rows equal on the given keys, first match only (row 10).

    ``order`` fixes which row is "first" (the key is normally unique); Spark plans
    ``filter + orderBy + limit(1)`` as a top-1, no full sort.
    """
    if not eq:
        raise ValueError("lookup_by_key needs at least one key=value")
    cond = None
    for k, v in eq.items():
        c = _c(k) == F.lit(v)
        cond = c if cond is None else cond & c
    out = df.filter(cond)
    if order:
        out = out.orderBy(*[_c(c).asc_nulls_last() for c in order])
    return out.limit(1)


def search_name(df: DataFrame, col: str, term: str) -> DataFrame:
    """Case-insensitive "contains" (row 11). The term is not escaped: ``%`` and ``_`` match like in SQL."""
    return df.filter(_c(col).ilike(f"%{term}%"))


def parse_column_list(columns: str | Iterable[str]) -> list[str]:
    if isinstance(columns, str):
        return [c.strip() for c in columns.split(",") if c.strip()]
    return list(columns)


def select_requested(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    """Keep the requested columns in the given order; an unknown name becomes a NULL string (row 12)."""
    present = set(df.columns)
    out = []
    for c in parse_column_list(columns):
        out.append(_c(c) if c in present else F.lit(None).cast("string").alias(c))
    return df.select(*out)


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if include_bool else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def select_numeric(df: DataFrame) -> DataFrame:
    """Numeric columns only (row 13)."""
    return df.select(*[_c(c) for c in numeric_columns(df)])


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in required if c not in present]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Check the schema before building the plan; raise listing the missing ones (row 14).

    Returns the required columns so the check composes into a query.
    """
    required = list(required)
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[_c(c) for c in required])


def parse_dates(df: DataFrame, col: str, fmt: str | None = None, strict: bool = True) -> DataFrame:
    """String → naive timestamp (row 15). Strict: a bad value raises; lenient: it becomes NULL."""
    c = _c(col).cast("string")
    if strict:
        parsed = F.to_timestamp_ntz(c, F.lit(fmt)) if fmt else F.to_timestamp_ntz(c)
        # to_timestamp_ntz yields NULL on a bad value when ANSI is off; make it an error either way.
        parsed = F.when(c.isNotNull() & parsed.isNull(),
                        F.raise_error(F.concat(F.lit(f"cannot parse '{col}' value: "), c))).otherwise(parsed)
    else:
        parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
        parsed = parsed.cast("timestamp_ntz")
    return df.withColumn(col, parsed)


def date_offsets(df: DataFrame, col: str = FX.TIME_COLUMN, days: Sequence[int] = tuple(d for _, d in FX.DATE_OFFSETS),
                 names: Sequence[str] | None = None) -> DataFrame:
    """``col + n days`` columns, named ``Date_Next_2Weeks`` / ``Date_Next_3Weeks`` for 14 / 21 (row 16)."""
    default = {d: name for name, d in FX.DATE_OFFSETS}
    names = list(names) if names else [default.get(n, f"{col}_Plus_{n}Days") for n in days]
    return df.select("*", *[S.add_days(col, n).alias(nm) for n, nm in zip(days, names)])


def host_id_extract(df: DataFrame, col: str = "hostname", name: str = "host_id") -> DataFrame:
    """First digit run of the trimmed host name as INT, NULL if none (row 17)."""
    return df.withColumn(name, S.host_id(col))


def filter_optional(df: DataFrame, col: str, value=None) -> DataFrame:
    """Filter ``col = value``; ``None`` keeps every row (row 18). Decided when the plan is built."""
    if value is None:
        return df
    return df.filter(_c(col) == F.lit(value))


def threshold_flags(df: DataFrame, col: str = FX.VALUE_COLUMN, high: float = FX.HIGH_THRESHOLD,
                    target: float = FX.TARGET_THRESHOLD) -> DataFrame:
    """``col > high`` and ``col >= target`` as 0/1, missing → 0 (row 19)."""
    return df.select("*", S.above_flag(col, high).alias(f"{col}_Above_{_num(high)}"),
                     S.above_flag(col, target, inclusive=True).alias(f"{col}_AtLeast_{_num(target)}"))


def _num(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x).replace(".", "_")


def fill_missing(df: DataFrame, value=0) -> DataFrame:
    """Missing numbers (NULL and NaN) → ``value``; text/time cells stay NULL (row 20)."""
    cols = []
    for f in df.schema.fields:
        c = _c(f.name)
        if isinstance(f.dataType, T.NumericType):
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = S.nan_to_null(c)
            c = F.coalesce(c, F.lit(value).cast(f.dataType)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def rows_to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row (row 21): times as ISO text (a fraction only where
    there is one), DECIMAL as DOUBLE, bytes as UTF-8 without invalid bytes, NULLs kept."""
    cols = []
    for f in df.schema.fields:
        c = _c(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = S.time_text(c, "T")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.BinaryType):
            c = S.utf8_text(c)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(name))


def project_registry(datasets: DataFrame) -> DataFrame:
    """Dataset registry rows as feature-store entries (row 22)."""
    return datasets.select(
        F.col("id"), F.col("name"),
        F.concat(F.lit(FX.FILENAME_PREFIX), F.col("filename")).alias("description"),
        F.col("filename").alias("offline_dataset_path"),
        F.col("created_at"),
    )


def model_label(models: DataFrame, task_col: str = "task_type", id_col: str = "id") -> DataFrame:
    """``<Task>Model-<first 6 of id>`` and the table-safe id (``-`` → ``_``) (row 23)."""
    return models.select("*", S.model_label(task_col, id_col).alias("model_name"),
                         S.table_suffix(id_col).alias("table_suffix"))
