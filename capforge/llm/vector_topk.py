"""Exact top-k search by integer inner product over a vector-approximation file.

1. Vectors become integers floor(scale * x). Equal vectors are one class: of its rows only the k + 1
   smallest (id, row) can be among anybody's k best, so a class keeps these. Queries are classes too.
2. The approximation file holds one byte for each component of a class, its cell, and the cells' width: 1 where all
   integers fit into a byte (then the cells are exact), else the smallest that makes them fit. Blocks of queries, the smaller
   side, meet blocks of the file: from cells alone every product gets a lower and an upper bound,
   widened by what doubles may round. A block keeps, for each query, the classes whose upper bound reaches the lower bound
   that k + 1 of its own rows are sure to reach, of those with one and the same exact product the k + 1 with the
   smallest ids; over all blocks the (k + 1)-th best lower bound cuts again.
3. The exact vectors of each query's k + 1 first classes in order of their bounds are read; the score that
   is certain by then cuts the rest, and only classes whose upper bound still reaches it are read.

No class that could hold a result is left out, so the result is that of comparing all vectors.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do those with
components that overflow when scaled; null ids take no part; only vectors of the query's length are compared. Rows that repeat
in id or vector are rows of their own, as candidates and as queries; a query's own row alone is left out. Scores are
exact; one beyond 64 bits is given, and ranked, as the nearest long. Ties go to the smaller id. An empty table gives an
empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capforge.llm.common import join_counted, stored, task_memory, with_row_id

#: Queries and classes in a block, on average, and the rows of a block that are multiplied at once.
QUERY_BLOCK, VECTOR_BLOCK, STRIP = 16384, 32768, 64
LONG = (1 << 63) - 1


def vector_rows(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """Stored (rid, id, digest, dim, v, width, cells) of the rows that take part: v holds integers as doubles' bytes."""
    rows = with_row_id(vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")),
                       "rid").filter("id is not null AND size(v) > 0").select("rid", "id", "v")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "id", "digest", "dim", "v", "width", "cells"]
        for batch in batches:
            keep, made = [], []
            for i, v in enumerate(batch.column(2)):
                if v.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(v.values.to_numpy(zero_copy_only=False) * scale) + 0.0  # one zero, not two
                if np.isfinite(x).all():
                    width, cells = cell_codes(x)
                    keep.append(i)
                    made.append((xxhash.xxh3_128_digest(x.tobytes()), len(x), x.tobytes(), width, cells.tobytes()))
            at = pa.array(keep, pa.int64())
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)] + [
                pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names)

    return stored(rows.mapInArrow(describe, "rid long, id long, digest binary, dim int, v binary, width double, cells binary"), "vectors")


def cell_codes(x: np.ndarray) -> tuple[float, np.ndarray]:
    """The width of a vector's cells and their numbers: x lies in [width * cell, width * (cell + 1)], and is
    width * cell where the width is 1."""
    width = max(1.0, float(np.abs(x).max()) / 127)
    return width, np.clip(np.floor(x / width), -128, 127).astype(np.int8)


def bounds(queries: np.ndarray, cells: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each query's product with the vectors of these cells."""
    with np.errstate(over="ignore", invalid="ignore"):
        at_low = (queries @ cells.astype(np.float64).T) * width
        wide = np.where(width > 1, width, 0.0)
        lower = at_low + np.minimum(queries, 0).sum(axis=1)[:, None] * wide
        upper = at_low + np.maximum(queries, 0).sum(axis=1)[:, None] * wide
        # what doubles may round away: nothing while all sums stay below 2^53
        size = np.abs(queries).sum(axis=1)[:, None] * (129 * width)
        error = np.where(size < 2.0 ** 52, 0.0, size * (queries.shape[1] + 8) * 2.0 ** -51) + np.where((wide > 0) & (size < 2.0 ** 52), size * 1e-12, 0.0)
        lower, upper = lower - error, upper + error
    lost = ~(np.isfinite(lower) & np.isfinite(upper))
    lower[lost], upper[lost] = -np.inf, np.inf
    return np.clip(lower, -2.0 ** 63, 2.0 ** 63), np.clip(upper, -2.0 ** 63, 2.0 ** 63)  # as scores are held within a long


def reachable(classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, c, n, lower, upper): for each query class the classes that its block can't rule out.

    ``classes``: (c, n, least, dim, width, cells) with n = rows of the class, up to k + 1, and its smallest id;
    ``queries``: (q, dim, v).
    """
    nq, nv = queries.count(), classes.count()
    q_blocks, v_blocks = max(1, -(-nq // QUERY_BLOCK)), max(1, -(-nv // VECTOR_BLOCK), min(8, -(-nv // 1024)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("dim", block("q", q_blocks).alias("qb"), every(v_blocks).alias("vb"), "q", "v")
    file = classes.select("dim", every(q_blocks).alias("qb"), block("c", v_blocks).alias("vb"), "c", "n", "least", "width", "cells")
    names, kinds = ["q", "c", "n", "lower", "upper"], [pa.int64()] * 3 + [pa.float64()] * 2

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.schema(list(zip(names, kinds))).empty_table()
        dim = key[0].as_py()
        q = np.frombuffer(b"".join(v.as_buffer() for v in left["v"]), np.float64).reshape(-1, dim)
        cells = np.frombuffer(b"".join(v.as_buffer() for v in right["cells"]), np.int8).reshape(-1, dim)
        qs, cs, rows, least, width = left["q"].to_numpy(), *(right[x].to_numpy() for x in ("c", "n", "least", "width"))
        by_id = np.argsort(least, kind="stable")  # so that ties are met in the order of their ids
        cells, cs, rows, width = cells[by_id], cs[by_id], rows[by_id], width[by_id]
        out: list[list[np.ndarray]] = [[] for _ in names]
        for start in range(0, len(qs), STRIP):
            lower, upper = bounds(q[start:start + STRIP], cells, width)
            for i in range(len(lower)):
                low, up = lower[i], upper[i]
                reach = min(k + 1, len(cs))
                cut = np.partition(low, len(low) - reach)[len(low) - reach]
                best = np.flatnonzero(low >= cut)
                best = best[np.argsort(-low[best], kind="stable")]
                sure = np.cumsum(rows[best]) >= k + 1
                floor = low[best[np.argmax(sure)]] if sure.any() else -np.inf
                above = np.flatnonzero(up >= floor)
                tied = above[(up[above] == floor) & (low[above] == floor)]  # products known and equal
                if len(tied) > k + 1:
                    above = np.setdiff1d(above, tied[k + 1:], assume_unique=True)
                for o, x in zip(out, (np.full(len(above), qs[start + i]), cs[above], rows[above], low[above], up[above])):
                    o.append(x)
        return pa.table([pa.array(np.concatenate(o), kind) for o, kind in zip(out, kinds)], names=names)

    keys = ["dim", "qb", "vb"]
    return asked.groupBy(*keys).cogroup(file.groupBy(*keys)).applyInArrow(compare, "q long, c long, n long, lower double, upper double")


def scores(pairs: DataFrame) -> DataFrame:
    """(q, c, n, score) from (q, c, n, qv, v), exact, held within a long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(3), batch.column(4)):
                x, y = np.frombuffer(a.as_buffer(), np.float64), np.frombuffer(b.as_buffer(), np.float64)
                if np.abs(x).max() * np.abs(y).max() * len(x) < 2.0 ** 52:
                    out.append(int(x @ y))
                else:
                    out.append(max(-LONG, min(LONG, sum(int(s) * int(t) for s, t in zip(x.tolist(), y.tolist())))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int64())], ["q", "c", "n", "score"])

    return pairs.select("q", "c", "n", "qv", "v").mapInArrow(score, "q long, c long, n int, score long")


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
                scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose ``is_query(id column)`` holds its k best other rows."""
    task_memory(vectors.sparkSession)
    rows = vector_rows(vectors, vec_id, embedding, scale)
    first = Window.partitionBy("digest").orderBy("id", "rid")  # at most k + 1 rows of a task reach it
    few = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    classes = few.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("id", "rid"))).alias("members"),
                                        *[F.first(c).alias(c) for c in ("dim", "v", "width", "cells")])
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("n", F.size("members")), "classes")
    asked = stored(rows.filter(is_query(F.col("id"))).select("id", "rid", "digest").join(classes.select("digest", "c"), "digest").select(
        "id", "rid", F.col("c").alias("q")), "asked")
    queries = stored(asked.select("q").distinct().join(classes.select(F.col("c").alias("q"), "dim", "v"), "q"), "queries")
    near = stored(reachable(classes.select("c", F.col("n").cast("long").alias("n"), F.col("members")[0]["id"].alias("least"), "dim", "width",
                                           "cells"), queries, k), "blocks")
    by_query = Window.partitionBy("q")
    upto = F.sum("n").over(by_query.orderBy(F.col("lower").desc(), "c"))
    sure = near.withColumn("upto", upto).filter(F.col("upto") >= k + 1).groupBy("q").agg(F.max("lower").alias("sure"))
    near = stored(near.join(sure, "q", "left").filter(F.col("sure").isNull() | (F.col("upper") >= F.col("sure"))).select(
        "q", "c", "upper"), "bounds")
    # 1 + k classes in bound order are enough for k rows besides the query's own
    ranked = near.withColumn("r", F.row_number().over(by_query.orderBy(F.col("upper").desc(), "c")))
    left, right = queries.select("q", F.col("v").alias("qv")), classes.select("c", "v", "n")

    def scored(pairs: DataFrame) -> DataFrame:
        return scores(pairs.join(left, "q").join(right, "c"))

    head = stored(scored(ranked.filter(F.col("r") <= k + 1).select("q", "c")), "head")
    upto = F.sum("n").over(by_query.orderBy(F.col("score").desc(), "c"))
    certain = head.withColumn("upto", upto).filter(F.col("upto") >= k + 1).groupBy("q").agg(F.max("score").alias("certain"))
    rest = near.join(head.select("q", "c"), ["q", "c"], "left_anti").join(certain, "q", "left").filter(
        F.col("certain").isNull() | (F.col("upper") >= F.col("certain"))).select("q", "c")
    best = stored(head.unionByName(scored(rest)), "best")
    least = best.withColumn("upto", upto).filter(F.col("upto") >= k + 1).groupBy("q").agg(F.max("score").alias("least"))
    # classes of equal score may be many, but each has k + 1 rows at most
    hits = best.join(least, "q", "left").filter(F.col("least").isNull() | (F.col("score") >= F.col("least"))).join(
        classes.select("c", F.explode("members").alias("m")), "c").select("q", "score", F.col("m.id").alias("vec_id"), F.col("m.rid").alias("row"))
    top = hits.withColumn("r", F.row_number().over(by_query.orderBy(F.col("score").desc(), "vec_id", "row"))).filter(
        F.col("r") <= k + 1).drop("r")
    # a class of queries has one list of k + 1 rows: a row of it joins a query each, so a frequent vector isn't one task's work
    lists = top.groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "row", "score")).alias("top"))
    asks = asked.groupBy("q").agg(F.count(F.lit(1)).alias("asks"))
    with_list = join_counted(asked, stored(lists.join(asks, "q"), "lists"), "q", "asks", asked.count())
    others = F.filter(F.sort_array("top"), lambda m: m["row"] != F.col("rid"))
    return with_list.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
