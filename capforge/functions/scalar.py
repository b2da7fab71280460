"""Scalar column expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capforge.functions.fixed import PANDAS_NULL_TOKENS  # noqa: F401  (re-exported)

DAY_MICROS = 86_400_000_000


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (wall clock, no zone)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, col_of(c).cast("timestamp_ntz"))


def floor_div(a: Column, b: int) -> Column:
    """Exact floor division of a BIGINT by a positive constant (also below zero)."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def add_days(c, days: int) -> Column:
    return col_of(c) + F.make_dt_interval(F.lit(days))


def nan_to_null(c) -> Column:
    """pandas has one missing value; Spark has NULL and NaN. Keep only NULL."""
    c = col_of(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def above_flag(c, threshold: float, inclusive: bool = False) -> Column:
    """``value > t`` (or ``>=``) as 0/1; a missing value counts as 0."""
    c = col_of(c)
    cond = c >= F.lit(threshold) if inclusive else c > F.lit(threshold)
    return F.coalesce(cond.cast("int"), F.lit(0))


def host_id(c) -> Column:
    """First run of digits in the trimmed host name as INT; NULL when there is none."""
    return F.regexp_substr(F.trim(col_of(c)), F.lit(r"\d+")).cast("int")


def table_suffix(c) -> Column:
    """A UUID-like id made safe for table names: ``-`` becomes ``_``."""
    return F.translate(col_of(c), "-", "_")


def title_case(c) -> Column:
    """Every run of letters with a capital first letter and small others (``multi-class`` → ``Multi-Class``)."""
    runs = F.regexp_extract_all(F.lower(col_of(c)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def model_label(task_col, id_col) -> Column:
    """``<TaskTitle>Model-<first 6 chars of id>``, e.g. ``Time_SeriesModel-1a2b3c``."""
    from capforge.functions.fixed import MODEL_ID_CHARS, MODEL_NAME_INFIX
    return F.concat(title_case(task_col), F.lit(MODEL_NAME_INFIX),
                    F.substring(col_of(id_col), 1, MODEL_ID_CHARS))


def time_text(c, between: str = " ") -> Column:
    """ISO date and time; six fraction digits only where the fraction isn't zero."""
    c = col_of(c)
    whole = F.date_format(c, f"yyyy-MM-dd'{between}'HH:mm:ss")
    part = F.date_format(c, ".SSSSSS")
    return F.when(part == ".000000", whole).otherwise(F.concat(whole, part))


def utf8_text(c) -> Column:
    """Bytes as text; bytes that aren't UTF-8 are left out."""
    raw = col_of(c).cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT column (for comparisons against SQL oracles)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
