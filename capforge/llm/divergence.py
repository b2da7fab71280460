"""Source divergence audit: how the term distributions of a language's sources differ, in whole numbers.

1. Each task counts the terms of its documents by (language, source): occurrences, and documents that hold them. Spark
   adds the counts by (language, source, term), then finds each language's kept terms: those in at least
   ``min_docs`` of its documents.
2. The counts are a cube of (source block, source block, term block) cells for each language. A slice, the counts of one
   source block in one term block, is copied to every cell that needs it, on either side; each source also
   sends its total to all its cells. A cell takes its terms one after another, gives every
   pair of its sources its part of the divergence, and its diagonal cells give the candidates of the term ranking.
3. Parts are added along the term axis. Terms that neither source block of a cell holds have the same share in each of
   these terms; their number is known, so they are added at the end and no cell holds absent terms.

Shares are p = 1 + floor(10^9 (count + 1) / (N + V)): V kept terms, N the kept occurrences of the source (of the
language for q in part ``term``). f = floor((p - q)^2 / q), all in 64-bit integers.

Defined results: null text, lang and source are read as ''; every row is a document of its own, repeated
ids or not; a source without terms has its pairs; without kept terms all pair values are 0; ties are ranked by item in
UTF-8 order; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capforge.llm.common import stored, task_memory, text_or_empty

UNIT = 1_000_000_000
#: Sources and kept terms that a block has, on average.
SOURCE_BLOCK, TERM_BLOCK = 64, 8192
#: Counted (group, term) entries that a task holds before it hands them on.
HELD = 200_000
#: Terms times sources that a cell takes at once.
WIDTH = 1 << 17

#: ASCII letters are lower-cased, other ASCII separates, all else belongs to terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term. A row with a null
    term for each occurring (lang, source)."""
    rows = docs.select(*[text_or_empty(F.col(f"`{c}`")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    schema = "lang string, source string, term string, n long, docs long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (l, s), (n, d) in held.items():
                found = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([l] * (len(found) + 1), pa.string()), pa.array([s] * (len(found) + 1), pa.string()),
                     pa.array([None, *found], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()),
                     pa.array([0, *(d[t] for t in found)], pa.int64())], names)
            held.clear()

        for batch in batches:
            for l, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, d = held.setdefault((l, s), (Counter(), Counter()))
                found = Counter(terms(t.as_buffer().to_pybytes()))
                n.update(found)
                d.update(found.keys())
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    return rows.mapInArrow(count, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) for count + 1 <= total < 2^53, digit group by digit group."""
    rest, out = count + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def block(c: str, n: int):
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def cells(kept: DataFrame, groups: DataFrame, source_blocks: int, term_blocks: int, top: int) -> DataFrame:
    """(lang, source, part, item, value, covered, absent) of all cells: ``covered``: terms that value has
    taken in; ``absent``: what each further term gives.

    ``kept``: (lang, source, term, n, all_n); ``groups``: (lang, source, total, all_total, v).
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    null = lambda kind: F.lit(None).cast(kind)
    slices = kept.select("lang", "source", "term", "n", "all_n", null("long").alias("v"), block("source", source_blocks).alias("b"),
                         block("term", term_blocks).alias("k"))
    heads = groups.select("lang", "source", null("string").alias("term"), F.col("total").alias("n"), F.col("all_total").alias("all_n"), "v",
                          block("source", source_blocks).alias("b"), every(term_blocks).alias("k"))
    both = slices.unionByName(heads)
    one = both.withColumn("b1", F.col("b")).withColumn("b2", every(source_blocks))
    two = both.withColumn("b2", F.col("b")).withColumn("b1", every(source_blocks))
    names = ["lang", "source", "part", "item", "value", "covered", "absent"]

    def column(left: pa.Table, right: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, list]:
        """Codes of both tables (null: -1) and what they stand for."""
        whole = pa.concat_arrays([*left[name].chunks, *right[name].chunks]).dictionary_encode()
        codes = whole.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return codes[:left.num_rows], codes[left.num_rows:], whole.dictionary.to_pylist()

    def side(table: pa.Table, source: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the sources, their totals, and their counts by term."""
        n, head = table["n"].to_numpy(), term < 0
        order = np.argsort(source[head], kind="stable")
        codes, totals = source[head][order], n[head][order]
        counts = np.zeros((len(codes), width), np.int64)
        counts[np.searchsorted(codes, source[~head]), term[~head]] = n[~head]
        return codes, totals, counts

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, b1, b2 = (k.as_py() for k in key[:3])
        if not left.num_rows or not right.num_rows:
            return pa.schema(list(zip(names, kinds))).empty_table()
        left_term, right_term, words = column(left, right, "term")
        left_source, right_source, sources = column(left, right, "source")
        words = [w for w in words if w is not None]
        at = len(words)
        head = int(np.flatnonzero(left_term < 0)[0])
        all_total, v = left["all_n"][head].as_py(), left["v"][head].as_py()
        a, a_total, left_n = side(left, left_source, left_term, at)
        b, b_total, right_n = side(right, right_source, right_term, at)
        p, q = shares(left_n, (a_total + max(v, 1))[:, None]), shares(right_n, (b_total + max(v, 1))[:, None])
        p0, q0 = shares(np.zeros_like(a_total), a_total + max(v, 1)), shares(np.zeros_like(b_total), b_total + max(v, 1))
        parts: list[list] = [[] for _ in names]

        def add(source: str, part: str, items: list, values: list, covered: int, absent: list) -> None:
            for c, x in zip(parts, ([lang] * len(items), [source] * len(items), [part] * len(items), items, values,
                                    [covered] * len(items), absent)):
                c.extend(x)

        step = max(1, WIDTH // len(b))
        for i, s in enumerate(a):
            value = np.zeros(len(b), np.int64)
            for lo in range(0, at, step):
                value += divergence(p[i, None, lo:lo + step], q[:, lo:lo + step]).sum(axis=1)
            absent = divergence(p0[i], q0) if v else np.zeros(len(b), np.int64)
            other = np.flatnonzero(b != s)
            add(sources[s], "pair", [sources[b[j]] for j in other], value[other].tolist(), at, absent[other].tolist())
        if b1 == b2 and at:
            whole = np.zeros(at, np.int64)
            whole[left_term[left_term >= 0]] = left["all_n"].to_numpy()[left_term >= 0]
            base = shares(whole, all_total + v)
            for i, s in enumerate(a):
                f = np.where((left_n[i] > 0) & (p[i] > base), divergence(p[i], base), -1)
                on = np.flatnonzero(f >= 0)
                if len(on) > top:  # all that tie with the last one are kept
                    on = on[f[on] >= np.partition(f[on], len(on) - top)[len(on) - top]]
                add(sources[s], "term", [words[j] for j in on], f[on].tolist(), 0, [0] * len(on))
        return pa.table([pa.array(c, k) for c, k in zip(parts, kinds)], names=names)

    kinds = [pa.string()] * 4 + [pa.int64()] * 3
    keys = ["lang", "b1", "b2", "k"]
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(
        cell, "lang string, source string, part string, item string, value long, covered long, absent long")


def divergence_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3,
                     top: int = 200, source_block: int = SOURCE_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks all other sources of the language, part ``term`` the
    ``top`` terms that the source has more of than its language."""
    task_memory(docs.sparkSession)
    counts = stored(term_counts(docs, text, lang, source), "counts")
    of_term = Window.partitionBy("lang", "term")  # as many rows as a language has sources, at most
    kept = stored(counts.filter("term is not null").withColumn("in_docs", F.sum("docs").over(of_term)).withColumn(
        "all_n", F.sum("n").over(of_term)).filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "all_n"), "kept")
    per_term = kept.groupBy("lang", "term").agg(F.max("all_n").alias("all_n"))
    langs = per_term.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(
        langs, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "all_total", "v")]),
        "groups")
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("v").alias("v")).agg(F.max("sources"), F.max("v")).first()
    source_blocks, term_blocks = (max(1, -(-(n or 0) // size)) for n, size in zip(most, (source_block, term_block)))
    parts = stored(cells(kept, groups, source_blocks, term_blocks, top), "parts")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        F.sum("value").alias("value"), F.sum("covered").alias("covered"), F.max("absent").alias("absent"))
    pairs = pairs.join(groups.select("lang", "source", "v"), ["lang", "source"]).select(
        "lang", "source", "part", "item", (F.col("value") + (F.col("v") - F.col("covered")) * F.col("absent")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    words = parts.filter("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", rank).filter(
        F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(words).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
