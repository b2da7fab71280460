"""Embedding near-dedup: int8 tile products with error bounds for each vector, full precision where they leave it open.

1. Rows with equal vectors form a class, which is compared once; copies are linked without being paired.
2. A vector is scaled to length 1 and quantised to int8: u = s q + e. The product of two such vectors lies within
   (1 + |e1|) |e2| + |e1| of s1 s2 (q1 . q2), whatever the directions of the errors; |e| is computed for each vector
   and rounded up. Products of int8 are summed exactly (in 24 or 53 bits, by the number of components).
3. Classes are dealt into blocks, and a task compares two of them (a tile). Pairs whose product and
   bound stay below the threshold are done; the others, and only these, get their cosine in double precision from
   the original vectors, which the tile holds beside the int8 ones.
4. A tile hands on no pairs: for each class how many rows it is linked with, and the links' connected parts as stars,
   which have fewer links than the tile has classes. Components come from these.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing and
are their own component; only vectors of equal length are compared; rows that repeat, in id or vector, are rows of
their own; a component's id leaves out null ids unless all are null; a null id is never kept; an empty table gives an
empty result; other columns are ignored whatever their names. Vectors are divided by a power of two near their largest component
first, so neither huge nor tiny components overflow.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capforge.llm.common import join_counted, stored, task_memory, with_row_id
from capforge.llm.components import components

#: Classes in a block, at most on average, and the blocks that a table of some size has at least.
BLOCK, BLOCKS, SMALL_BLOCK = 16384, 8, 1024
#: Rows of a tile that are multiplied at once.
STRIP = 512


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two above their largest component (exact, but for what falls below 2^-1074)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale and error bound of each row of nonzero finite doubles."""
    u = scaled(x)
    u = u / np.linalg.norm(u, axis=1)[:, None]
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(u - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12 * np.sqrt(x.shape[1])
    return q, scale, error


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``x`` with the same row of ``y``, in double precision."""
    x, y = scaled(x), scaled(y)
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def open_pairs(a: tuple, b: tuple, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) whose cosine may be ``least`` or more; a and b: (q, scale, error)."""
    exact = np.float32 if a[0].shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = b[0].astype(exact).T
    b_scale, b_error = b[1], b[2]
    for at in range(0, len(a[0]), STRIP):
        q, scale, error = (part[at:at + STRIP] for part in a)
        low = (q.astype(exact) @ right).astype(np.float64)
        low *= scale[:, None]
        low *= b_scale
        low += (1 + error)[:, None] * b_error  # now the upper bound, less |e1|
        i, j = np.nonzero(low >= (least - 1e-9 - error)[:, None])
        yield i + at, j


class Forest:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def vector_rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Stored (rid, id, digest, dim, x): x holds the doubles' bytes; digest and x are null for vectors that take no part."""
    rows = with_row_id(vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")), "rid").select("rid", "id", "v")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "id", "digest", "dim", "x"]
        for batch in batches:
            digest, dim, data = [], [], []
            for v in batch.column(2):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and len(v) and not v.values.null_count else np.zeros(1)
                x = x + 0.0  # one zero, not two
                if np.isfinite(x).all() and x.any():
                    digest.append(xxhash.xxh3_128_digest(x.tobytes()))
                    dim.append(len(x))
                    data.append(x.tobytes())
                else:
                    digest.append(None), dim.append(None), data.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(dim, pa.int32()),
                                              pa.array(data, pa.binary())], names)

    return stored(rows.mapInArrow(describe, "rid long, id long, digest binary, dim int, x binary"), "vectors")


def tile_results(classes: DataFrame, least: float, blocks: int) -> DataFrame:
    """Stored rows of all tiles: (a, n, null) rows that a class is linked with there, and (a, null, b) stars."""
    cut = F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int")
    dealt = classes.select("dim", "c", "m", "x", cut.alias("at"))
    one = dealt.select("dim", F.col("at").alias("i"), F.explode(F.sequence("at", F.lit(blocks - 1))).alias("j"), "c", "m", "x")
    two = dealt.select("dim", F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"), "c", "m", "x")
    node = classes.schema["c"].dataType

    def side(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(v.as_buffer() for v in table["x"]), np.float64).reshape(-1, dim)
        return x, table["m"].to_numpy()

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, i, j = (k.as_py() for k in key)
        c_kind = left.schema.field("c").type
        kinds = [("a", c_kind), ("n", pa.int64()), ("b", c_kind)]
        if not left.num_rows or not right.num_rows:
            return pa.schema(kinds).empty_table()
        x, m = side(left, dim)
        y, w = (x, m) if i == j else side(right, dim)
        a = quantised(x)
        b = a if i == j else quantised(y)
        offset = 0 if i == j else len(x)  # the tile's rows: those of the left block, then those of the right one
        forest = Forest(len(x) + (0 if i == j else len(y)))
        linked = np.zeros(len(forest.up), np.int64)
        for p, q in open_pairs(a, b, least):
            if i == j:
                p, q = p[p < q], q[p < q]
            for lo in range(0, len(p), 65536):
                u, v = p[lo:lo + 65536], q[lo:lo + 65536]
                on = cosines(x[u], y[v]) >= least
                u, v = u[on], v[on]
                np.add.at(linked, u, w[v])
                np.add.at(linked, v + offset, m[u])
                for s, t in zip(u.tolist(), (v + offset).tolist()):
                    forest.join(s, t)
        ids = left["c"].combine_chunks() if i == j else pa.concat_arrays([*left["c"].chunks, *right["c"].chunks])
        on = np.flatnonzero(linked)
        root = np.array([forest.root(s) for s in on.tolist()], np.int64)
        leaf = on != root
        degrees = [ids.take(pa.array(on)), pa.array(linked[on]), pa.nulls(len(on), c_kind)]
        edges = [ids.take(pa.array(on[leaf])), pa.nulls(int(leaf.sum()), pa.int64()), ids.take(pa.array(root[leaf]))]
        return pa.Table.from_arrays([pa.chunked_array([d, e]) for d, e in zip(degrees, edges)], schema=pa.schema(kinds))

    schema = T.StructType([T.StructField("a", node), T.StructField("n", T.LongType()), T.StructField("b", node)])
    keys = ["dim", "i", "j"]
    return stored(one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(tile, schema), "tiles")


def near_vectors(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
                 block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links (other rows linked directly), component_id (smallest id
    reachable), kept (the row has its component's id)."""
    task_memory(vectors.sparkSession)
    rows = vector_rows(vectors, vec_id, embedding)
    # ordered by id, null ids last; the row id keeps rows with equal ids apart
    node = F.struct(F.col("id").isNull().alias("z"), "id", "rid")
    classes = stored(rows.filter("digest is not null").groupBy("digest").agg(
        F.min(node).alias("c"), F.count(F.lit(1)).alias("m"), F.first("dim").alias("dim"), F.first("x").alias("x")), "classes")
    n, all_rows = classes.count(), rows.count()
    blocks = max(1, -(-n // block), min(BLOCKS, -(-n // SMALL_BLOCK)))
    found = tile_results(classes, least, blocks)
    degrees = found.filter("n is not null").groupBy(F.col("a.rid").alias("rid")).agg(F.sum("n").alias("linked"))
    labels = components(found.filter("n is null").select("a", "b")).select(F.col("node.rid").alias("rid"), "label")
    of_class = stored(classes.select("digest", "m", "c", F.col("c.rid").alias("rid")).join(degrees, "rid", "left").join(labels, "rid", "left").select(
        "digest", "m", (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "c").alias("label")), "of_class")
    part = rows.select("id", "digest")
    found = of_class.select("digest", "m", "n_links", F.col("label.id").alias("component_id"))
    linked = join_counted(part.filter("digest is not null"), found, "digest", "m", all_rows)
    every = linked.unionByName(part.filter("digest is null").select(
        "id", "digest", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return every.select(F.col("id").alias("vec_id"), "n_links", "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
