"""CSV and stored-table sources and sinks.

CSV typing follows pandas' reader, done the Spark way: the file is read as text,
the pandas missing-value tokens become NULL, and one aggregate pass decides per
column whether every present value is a BIGINT, else a DOUBLE, else a boolean,
else text. Then the columns are cast. No data goes through the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capforge.functions.fixed import FALSE_TOKENS, PANDAS_NULL_TOKENS, TRUE_TOKENS
from capforge.functions.scalar import time_text
from capforge.sources import csvrecords


def _check_suffix(path: str) -> None:
    base = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in base and not base.lower().endswith(".csv"):
        raise ValueError(f"unsupported file type: {base} (only .csv)")


# Cell texts that are numbers, as pandas reads them (Spark's casts accept more, e.g. ``10D``).
WHOLE = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
DECIMAL = r"(?i)^[ \t]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?[ \t]*$|^[+-]?inf(inity)?$"
#: What both CSV directions agree on: quotes inside quoted cells are doubled.
CSV_QUOTING = {"quote": '"', "escape": '"'}
_BROKEN, _EXTRA = "__broken_row", "__extra_cell"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             null_tokens: Sequence[str] = PANDAS_NULL_TOKENS, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """Read CSV with a header (row 1). With ``schema`` the types are given; otherwise inferred as above.

    Quotes inside quoted cells are doubled, rows with too few cells get NULLs, and a row with too many is
    an error, whichever columns are read. Files are split into byte ranges: whether cells hold line breaks is found by one
    look at the lines with quotes; if some do, records are put together across ranges
    (``csvrecords``). ``multi_line`` False skips the look (no cell holds a line break); True reads each
    file in one task, as any encoding but UTF-8 does when it isn't False.
    """
    _check_suffix(path)
    if multi_line is None and encoding.upper().replace("-", "") != "UTF8":
        multi_line = True
    reader = spark.read.options(header=True, encoding=encoding, multiLine=bool(multi_line), inferSchema=False, **CSV_QUOTING)
    given = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)) if schema is not None else None
    names = [f.name for f in given.fields] if given else spark.read.options(
        header=True, encoding=encoding, multiLine=multi_line is not False, inferSchema=False, **CSV_QUOTING).csv(path).columns
    wider = ", ".join(f"c{i} STRING" for i in range(len(names) + 1))
    if multi_line is None and csvrecords.has_line_breaks(spark, path):
        cells = F.from_csv(F.col("record"), wider, {**CSV_QUOTING, "multiLine": "true"})
        raw = csvrecords.records(spark, path).select("record", cells.alias("cells")).select(
            *[F.col(f"cells.c{i}").alias(c) for i, c in enumerate(names)], F.col(f"cells.c{len(names)}").alias(_EXTRA), F.col("record").alias(_BROKEN))
    else:
        cells = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _BROKEN]])
        raw = reader.schema(cells).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).csv(path)
        # a broken row is short or long: parsed with one more cell, a long one fills it
        raw = raw.withColumn(_EXTRA, F.from_csv(F.col(_BROKEN), wider, CSV_QUOTING)[f"c{len(names)}"])
    # a filter, so that it holds whichever columns are read; it names all, as a row is only compared with the columns that are read
    too_long = F.raise_error(F.concat(F.lit("CSV row with too many cells: "), F.coalesce(F.col(_BROKEN), *[F.col(f"`{c}`") for c in names])))
    tokens = list(null_tokens)
    text = raw.filter(F.when(F.col(_EXTRA).isNotNull(), too_long.cast("boolean")).otherwise(
        F.lit(True))).select(*[F.when((value := F.col(f"`{c}`")).isin(tokens), F.lit(None).cast("string")).otherwise(value).alias(c) for c in names])
    if given:
        return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in given.fields])
    return text.select(*[_typed(F.col(f"`{c}`"), t).alias(c) for c, t in infer_types(text).items()])


def _typed(cell, kind: str):
    return F.trim(cell).cast(kind) if kind in ("bigint", "double") else cell.cast(kind)


def infer_types(text: DataFrame) -> dict[str, str]:
    """Per text column: ``bigint`` / ``double`` / ``boolean`` / ``string`` from one aggregate pass."""
    cols = text.columns
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        present = v.isNotNull()
        aggs += [
            F.count_if(present & (~v.rlike(WHOLE) | F.trim(v).try_cast("bigint").isNull())).alias(f"l{i}"),
            F.count_if(present & ~v.rlike(DECIMAL)).alias(f"d{i}"),
            F.count_if(present & ~v.isin(list(TRUE_TOKENS + FALSE_TOKENS))).alias(f"b{i}"),
            F.count_if(present).alias(f"n{i}"),
        ]
    row = text.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        if row[f"n{i}"] == 0:
            out[c] = "string"
        elif row[f"l{i}"] == 0:
            out[c] = "bigint"
        elif row[f"d{i}"] == 0:
            out[c] = "double"
        elif row[f"b{i}"] == 0:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def scan_table(spark: SparkSession, name_or_path: str = "", format: str | None = None, **options) -> DataFrame:
    """A stored table (row 2): catalog name, parquet folder, or any Spark source.

    ``format`` + ``options`` read through ``spark.read.format(...)``, e.g. the
    reference's relational tables with ``format="jdbc", url=..., dbtable=...``
    (add ``partitionColumn/lowerBound/upperBound/numPartitions`` to read in parallel).
    """
    if format:
        reader = spark.read.format(format).options(**options)
        return reader.load(name_or_path) if name_or_path else reader.load()
    if "/" in name_or_path or name_or_path.endswith(".parquet"):
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def sink_table(df: DataFrame, name_or_path: str = "", partition_by: Sequence[str] = (), format: str | None = None,
               **options) -> None:
    """Write, replacing the table (row 3). Path → parquet folder; name → catalog table;
    ``format`` + ``options`` → any Spark sink (e.g. ``jdbc``)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if format:
        w = w.format(format).options(**options)
        w.save(name_or_path) if name_or_path else w.save()
    elif "/" in name_or_path:
        w.parquet(name_or_path)
    else:
        w.format("parquet").saveAsTable(name_or_path)


def sink_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column (row 4); one part file per partition.

    Quotes are doubled, times are ``2024-01-02 03:04:05`` (with a fraction only where there is one), booleans
    ``True``/``False``, missing cells empty.
    """
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = time_text(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, TRUE_TOKENS[0]).when(~c, FALSE_TOKENS[0])
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        cells.append(c.alias(f.name))
    df.select(*cells).write.mode("overwrite").options(header=True, emptyValue="", **CSV_QUOTING).csv(path)


def ingest_predictions(spark: SparkSession, path: str, dest: str, runs_path: str | None = None,
                       run: dict | None = None) -> DataFrame:
    """Read an external prediction CSV (UTF-8), refuse an empty one, store it, return the stored rows (row 5).

    With ``runs_path`` a prediction-run row pointing at ``dest`` is appended too, so
    uploaded predictions can be listed, downloaded and purged like computed ones.
    """
    df = scan_csv(spark, path)
    if df.isEmpty():
        raise ValueError(f"prediction file is empty: {path}")
    sink_table(df, dest)
    if runs_path:
        from capforge.sources.registry import append_records, registry_schema

        schema = registry_schema("predictions")
        row = {**(run or {}), "output_path": dest, "status": (run or {}).get("status", "UPLOADED")}
        rec = spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields)], schema)
        append_records(rec.withColumn("created_at", F.coalesce(F.col("created_at"), F.current_timestamp())),
                       runs_path)
    return scan_table(spark, dest)
