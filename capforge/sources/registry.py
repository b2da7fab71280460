"""Registry tables and declared schemas.

Registries are small append-only tables (datasets, engineered tables, selection
runs, models, prediction runs). Rows are added in batches with ``mode("append")``;
a table that is rewritten from itself is written beside the old one and swapped in,
because Spark cannot overwrite a path it reads.
"""

from __future__ import annotations

import uuid
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capforge.functions.fixed import DECLARED_TYPES
from capforge.session import materialised

REGISTRY_SCHEMAS = {
    "datasets": "id string, project_id string, name string, filename string, target_column string, "
                "created_at timestamp",
    "engineered": "dataset_id string, project_id string, table_name string, created_at timestamp",
    "selections": "id string, project_id string, dataset_id string, target_column string, "
                  "selected_features array<string>, dropped_features array<struct<name:string,reason:string>>, "
                  "created_at timestamp",
    "models": "id string, name string, project_id string, dataset_id string, selection_id string, "
              "task_type string, target_column string, metrics map<string,double>, artifact_path string, "
              "created_at timestamp",
    "predictions": "id string, project_id string, model_id string, dataset_id string, status string, "
                   "output_path string, created_at timestamp",
}


def registry_schema(name: str) -> T.StructType:
    return T._parse_datatype_string(REGISTRY_SCHEMAS[name])


def append_records(df: DataFrame, path: str) -> None:
    """Add rows to a registry table (row 6): a typed batch, ``mode("append")``."""
    df.write.mode("append").parquet(path)


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing`` (one per key) (row 7).

    ``left_anti`` on the key; among incoming rows with the same new key the
    smallest by the other (orderable) columns is kept, so the result is
    deterministic. The pick is an aggregate (``min_by``, partial on the map side),
    so a key repeated in a large share of the batch is not one task's work.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fresh = new.join(existing.select(*keys).distinct(), on=keys, how="left_anti")
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return fresh.distinct()
    order = [F.col(f"`{c}`") for c in rest if _orderable(new, c)]
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in rest])
    rank = F.struct(*order) if order else F.lit(0)
    picked = fresh.groupBy(*keys).agg(F.min_by(row, rank).alias("__row"))
    return picked.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__row.`{c}`").alias(c) for c in new.columns])


def _orderable(df: DataFrame, c: str) -> bool:
    return not isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))


def _default_expr(default, dtype: str) -> Column:
    if default is None or (isinstance(default, str) and default.strip().upper() == "NULL"):
        return F.lit(None).cast(dtype)
    if isinstance(default, str) and default.strip().upper() in ("NOW()", "CURRENT_TIMESTAMP"):
        return F.current_timestamp().cast(dtype)
    if isinstance(default, str):
        return F.lit(default.strip().strip("'")).cast(dtype)
    return F.lit(default).cast(dtype)


def spark_type(declared: str) -> str:
    t = declared.strip().upper()
    if t not in DECLARED_TYPES:
        raise ValueError(f"Unsupported type: {declared}")
    return DECLARED_TYPES[t]


def conform_schema(df: DataFrame, spec: Sequence[Mapping]) -> DataFrame:
    """Declared ``[{name, type, default}]`` → exactly those columns, cast, missing ones and NULLs
    filled with the default (``'ON PROGRESS'``, ``NOW()``) (row 8). Unknown type → error."""
    present = set(df.columns)
    cols = []
    for c in spec:
        dtype = spark_type(c["type"])
        d = _default_expr(c.get("default"), dtype)
        v = F.col(f"`{c['name']}`").cast(dtype) if c["name"] in present else F.lit(None).cast(dtype)
        cols.append(F.coalesce(v, d).alias(c["name"]))
    return df.select(*cols)


def _sql_default(default, dtype: str) -> str:
    if default is None or (isinstance(default, str) and default.strip().upper() == "NULL"):
        return ""
    if isinstance(default, str) and default.strip().upper() == "NOW()":
        return " DEFAULT current_timestamp()"
    if isinstance(default, str):
        return " DEFAULT '" + default.strip().strip("'").replace("'", "\\'") + "'"
    return f" DEFAULT {default}"


def recreate_tables(spark: SparkSession, tables: Sequence[Mapping], location: str) -> list[str]:
    """Drop and re-create every declared table, empty, as parquet under ``location`` (row 9).

    ``tables``: ``[{table_name, columns: [{name, type, default}]}]``. Returns the DDL run.
    """
    ddl = []
    for t in tables:
        name = t["table_name"]
        cols = ", ".join(f"`{c['name']}` {spark_type(c['type'])}{_sql_default(c.get('default'), spark_type(c['type']))}"
                         for c in t["columns"])
        path = f"{location.rstrip('/')}/{name}"
        stmts = [f"DROP TABLE IF EXISTS `{name}`",
                 f"CREATE TABLE `{name}` ({cols}) USING parquet LOCATION '{path}'"]
        spark.sql(stmts[0])
        # dropping a table with a location keeps its files: empty the folder first
        schema = ", ".join(f"`{c['name']}` {spark_type(c['type'])}" for c in t["columns"])
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        spark.sql(stmts[1])
        ddl += stmts
    return ddl


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a stored table's folder, if it is there."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a parquet table with rows that may be computed from itself (e.g. ``purge_project`` survivors).

    The rows are written to a folder beside it; only when they are complete does the old folder move away
    and the new one take its name, so a failure while writing leaves the table as it was. A reader that
    comes between the two renames finds no table and should try again.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    mark = uuid.uuid4().hex
    df.write.parquet(f"{base}.new-{mark}")
    fs, old = _hadoop(spark, base)
    new, away = (spark._jvm.org.apache.hadoop.fs.Path(f"{base}.{k}-{mark}") for k in ("new", "old"))
    moved = fs.exists(old)
    if moved and not fs.rename(old, away):
        raise OSError(f"{path} could not be moved away")
    if not fs.rename(new, old):
        if moved:
            fs.rename(away, old)
        raise OSError(f"{path} could not be replaced")
    spark.catalog.refreshByPath(base)
    if moved:
        fs.delete(away, True)


def drop_tables(spark: SparkSession, names: Sequence[str]) -> list[str]:
    """``DROP TABLE IF EXISTS`` for each name (a project's raw / engineered / prediction tables)."""
    stmts = [f"DROP TABLE IF EXISTS `{n}`" for n in names]
    for st in stmts:
        spark.sql(st)
    return stmts


def purge_project_tables(spark: SparkSession, project_id, registries: Mapping[str, tuple[str, str]],
                         children: Mapping[str, tuple[str, str, str]] | None = None,
                         drop: Sequence[str] = ()) -> dict[str, int]:
    """Delete one project from stored registry tables and drop its data tables (row 30).

    ``registries``: name → (parquet path, project-id column); ``children``: name →
    (parquet path, foreign key, parent registry name). Survivors are computed with
    ``operators.joins.purge_project`` (``left_anti`` on the doomed keys), all of them
    written beside the old tables and swapped in. Returns the surviving row count per table.
    """
    from capforge.operators.joins import purge_project

    frames = {n: (spark.read.parquet(path), col) for n, (path, col) in registries.items()}
    kids = {n: (spark.read.parquet(path), fk, parent) for n, (path, fk, parent) in (children or {}).items()}
    survivors = purge_project(project_id, frames, kids)
    paths = {**{n: p for n, (p, _) in registries.items()}, **{n: p for n, (p, _, _) in (children or {}).items()}}
    # child survivors are computed from the parents' old rows: all are written before the first is replaced
    stored = {name: materialised(df, f"survivors-{name}") for name, df in survivors.items()}
    counts = {}
    for name, df in stored.items():
        replace_table(df, paths[name])
        counts[name] = spark.read.parquet(paths[name]).count()
    drop_tables(spark, drop)
    return counts
