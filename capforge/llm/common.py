"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capforge.session import ensure_checkpoint_dir

#: What separates words everywhere in this subpackage: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one broadcast table may have; beyond it the salted join is used.
BROADCAST_ROWS = 100_000


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping arithmetic)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from that table,
    so a lost executor costs a re-read and row ids made before stay as they are."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whole texts that a Python task gets at once, and the build side of a hash join (checked by AQE at run
#: time, partition by partition; larger ones are sorted).
TEXT_ROWS, HASH_JOIN = 1000, "8MB"


def task_memory(spark: SparkSession) -> None:
    """Settings that keep tasks small, for a session that has Spark's defaults (it keeps its own values): few
    long texts in a batch for Python, and no sort of both sides where a small hash table will do. No result
    depends on them."""
    for key, default, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(TEXT_ROWS)),
                               ("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "0b", HASH_JOIN)):
        if spark.conf.get(key).lower() in (default, default.rstrip("b")):
            spark.conf.set(key, ours)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A unique long per row: two rows that agree in every column still differ in it. Store the result before
    it is used twice: how a scan is split, and so these ids, can change when executors come or go."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


#: A key with more than one of so many rows is joined by broadcast (so fewer than as many keys are).
HEAVY = 1000


def join_counted(df: DataFrame, per_key: DataFrame, key: str, count: str, rows: int, how: str = "inner") -> DataFrame:
    """Join ``df`` (``rows`` rows) with a table of one row per ``key``, whose column ``count`` says how many rows of ``df``
    have it: the few keys with very many rows by broadcast, all others by a shuffle in which no key is large.
    ``how``: inner or left; the column ``count`` is left out, other names must differ. Null keys match nothing."""
    added = [c for c in per_key.columns if c not in (key, count)]
    heavy, light = (per_key.filter(c).select(key, *added) for c in (F.col(count) * HEAVY > rows, F.col(count) * HEAVY <= rows))
    mark = fresh(df, "__heavy")
    marked = df.join(F.broadcast(heavy.withColumn(mark, F.lit(True))), key, "left")
    rest = marked.filter(F.col(mark).isNull()).select(*[F.col(f"`{c}`") for c in df.columns]).join(light, key, how)
    names = [F.col(f"`{c}`") for c in [*df.columns, *added]]
    return marked.filter(F.col(mark)).select(*names).unionByName(rest.select(*names))


def join_per_key(df: DataFrame, per_key: DataFrame, key: str, salts: int = 32,
                 limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of many rows with a table of one row per ``key`` (null keys match each other).

    The small table is counted first: up to ``limit`` rows it is broadcast; a larger one is copied
    ``salts`` times and joined on (key, salt), so that a key with a third of all rows is spread
    over ``salts`` tasks.
    """
    own, salt, copy = fresh(df, "__key"), fresh(df, "__salt"), fresh(df, "__copy")
    other = per_key.withColumnRenamed(key, own)
    same = F.col(f"`{key}`").eqNullSafe(F.col(own))
    if per_key.count() <= limit:
        return df.join(F.broadcast(other), same, "left").drop(own)
    left = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = other.withColumn(copy, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, same & (F.col(salt) == F.col(copy)), "left").drop(own, salt, copy)


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
