"""N-gram Jaccard self-join: tiles of equal parts, hashed bitmap signatures, exact sorted-array intersection.

A text's set is its distinct word shingles (words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased;
with fewer than ``n`` words the whole sequence is one shingle; without words the set is empty and linked
with nothing). Two rows are linked when 100 * |intersection| >= percent * |union|; components are the
rows reachable by links. Shingles are 64-bit hashes.

1. Rows with equal sets form a class; from here on a class is one row (its sets' row with the smallest
   id). Copies are linked without being paired.
2. A level holds the pairs whose larger set has 2^(l-1) + 1 to 2^l shingles; a set is of the level of its own size and of those
   that larger linked sets may have. Each level deals all shingles into parts by their hash, the same for all its sets. Sets of
   sizes a and b that are linked differ in d = (a + b) (100 - percent) / (100 + percent) shingles at most, and each spoils one
   part only: of the parts that aren't empty a set shares all but d with any linked one, whole. So a key is all of a
   part's shingles. Of a set's parts, the largest first, the first d + s are its list. How many lists hold a key is counted, and each
   list is ordered by that, the rarest first: the first d + 1 are a set's keys, of which it shares one with any linked
   set. So neither single shingles that occur by chance in many texts nor, up to s, parts of passages that many share are keys.
   Sets that have no more than d parts with shingles (few, and small) have single shingles as keys too: linked sets share at least
   ceil(percent |a| / 100), so of the first |a| - ceil(percent |a| / 100) + m of each in hash order they share at least m.
3. Each row's bitmap has one bit for each shingle hash modulo its length,
   set when an odd number of shingles falls on it. The bits that differ between two bitmaps are at most the
   symmetric difference, which bounds the intersection from above by (|a| + |b| - bits) / 2.
4. The rows that have a key are its tile; keys that one list only holds make none. In each tile one row is the pivot, the one whose list
   others share most of (of a group of near copies the one nearest to all); a row is compared with the
   likeliest pivots of its tiles only, so a tile of m near copies costs m comparisons. Rows connected through pivots get one label; then all
   pairs of a tile with different labels are compared, 256 bits of their bitmaps first. Pairs within one label can
   add nothing to the components and are never made. Rows that share many keys are paired in the first of their tiles and
   few others: each row of a tile knows the keys before it, and of two rows that have one of those in common this tile makes no pair.
5. Pairs that pass the bitmap bound are intersected exactly: the sorted arrays are built again from the
   texts of these rows alone (a fixed-size Bloom filter of their ids thins the scan, a join makes it exact).
6. Components by alternating large-star and small-star steps over the links, as stored tables.

Defined results: null and empty texts have an empty set and are their own component; rows that repeat
are one class; component ids ignore null ids unless all are null; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capforge.llm.common import BROADCAST_ROWS, HEAVY, columns_of, fresh, join_counted, mix, stored, task_memory, text_or_empty, with_row_id
from capforge.llm.components import components

BLOOM_BITS = 1 << 23
ROUNDS = 1
#: Single shingles that two linked rows' lists share at least, where their sizes ask for as many.
SHARED = 4
#: A list of single shingles has one of so many beyond what linked sets must share.
SPARE = 20
#: A list has one of so many keys beyond the parts that linked sets may differ in.
SPARE_PARTS = 8
#: Orders of ids among which a key chooses the one that decides its pivot.
ORDERS = 4
#: Pivots that a row is compared with in a round: those with the best bounds.
TRIED = 5
#: Keys before a tile's in a row's order, by which pairs of two rows that met in an earlier tile are known.
LAST = 8
SLICE = 1_000_000


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of about ``SLICE`` bytes each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, in order."""
    for _, part in slices(texts):
        clean = pc.ascii_trim_whitespace(part.cast(pa.large_string()))
        words = pc.ascii_split_whitespace(clean)
        offsets = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        lexicon = np.array([xxhash.xxh64_intdigest(w.lower())  # of bytes: A-Z only
                            for w in coded.dictionary.cast(pa.large_binary()).to_pylist()] or [0], np.uint64)
        h = lexicon[coded.indices.to_numpy()]
        m = max(0, len(h) - n + 1)
        rolled = np.zeros(m, np.uint64)
        for i in range(n):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[i:i + m])
        blank = pc.equal(pc.binary_length(clean), 0).to_numpy(zero_copy_only=False)
        for i in range(len(part)):
            s, e = int(offsets[i]), int(offsets[i + 1])
            if blank[i]:
                yield np.zeros(0, np.uint64)
            elif e - s < n:
                short = np.zeros(1, np.uint64)
                for j in range(s, e):
                    short = mix(short * np.uint64(0x9E3779B97F4A7C15) + h[j:j + 1])
                yield mix(short + np.uint64(e - s))
            else:
                x = np.sort(rolled[s:e - n + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]


def bitmap(x: np.ndarray) -> bytes:
    """Parity bitmap with a power of two of at least 64 and at least |x| bits."""
    bits = max(64, 1 << (len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Of two bitmaps the longer one is folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def class_rows(rows: DataFrame, n: int) -> DataFrame:
    """Stored (rid, n, digest) of all rows."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for x in shingle_sets(batch.column(1), n):
                sizes.append(len(x))
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], ["rid", "n", "digest"])

    return stored(rows.mapInArrow(describe, "rid long, n long, digest binary"), "sets")


def must_share(n: int, percent: int) -> int:
    """How many shingles a set of ``n`` shares with any linked one."""
    return -(-percent * n // 100)


def spare(n: int, percent: int) -> int:
    """How many of their lists' shingles two linked sets share at least, if the smaller has ``n``: more let more frequent
    ones be left out, and make the lists longer. It grows with ``n``."""
    return min(must_share(n, percent), max(SHARED, n // SPARE))


def list_sizes(n: int, percent: int) -> tuple[int, int, int]:
    """Of a set of ``n``: the size of its list, how many of them are keys, and how many keys it shares with any linked set."""
    share = must_share(n, percent)
    size = n - share + spare(n, percent)
    common = spare(share, percent)  # a linked set has at least ``share``
    least = min(SHARED, common)
    return size, size - common + least, least


def may_differ(a: int, b: int, percent: int) -> int:
    """In how many shingles linked sets of these sizes differ at most."""
    return (a + b) * (100 - percent) // (100 + percent)


def level_of(n: int) -> int:
    return (n - 1).bit_length()


@lru_cache
def parts_of(level: int, percent: int) -> tuple[int, int]:
    """How many parts a level deals shingles into, and how many keys its lists have to spare: as few parts as leave its
    largest sets enough that aren't empty."""
    top = 1 << level
    differ = may_differ(top, top, percent)
    more = 1 + differ // SPARE_PARTS
    parts = differ + more
    while parts < 4 * differ + 8:
        empty = parts * math.exp(-top / parts)  # about so many, and twice its deviation
        if parts - empty - 2 * math.sqrt(empty) > differ + more:
            break
        parts += 1 + parts // 50
    return parts, more


def part_keys(x: np.ndarray, level: int, parts: int) -> np.ndarray:
    """Of the sorted array ``x`` a key for each part that isn't empty, in an order that all sets share: those of most shingles first."""
    part = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending as x is
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    tag = mix(part[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1))
    keys = mix(np.add.reduceat(mix(x), starts) + tag)
    return keys[np.lexsort((keys, -np.diff(starts, append=len(x))))]


def key_lists(x: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(level, how many of the list are keys, list) of a set at each of its levels, and at level -1 its single shingles where
    the parts of a level are too few. Sets that only equal ones are linked with have no lists."""
    n, out, few = len(x), [], False
    for level in range(level_of(n), level_of(100 * n // percent) + 1) if n else ():
        differ = may_differ(n, min(1 << level, 100 * n // percent), percent)
        if not differ:
            continue
        parts, more = parts_of(level, percent)
        keys = part_keys(x, level, parts)
        few |= len(keys) <= differ
        out.append((level, min(len(keys), differ + 1), keys[:differ + more]))
    if few:
        size, keep, _ = list_sizes(n, percent)
        out.append((-1, keep, mix(x[:size])))
    return out


def signature(x: np.ndarray) -> np.ndarray:
    """A parity bitmap of 256 bits, whatever the size of the set, as four 64-bit words."""
    odd = np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def bloom_word(rid: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(rid, F.lit(seed)), F.lit(BLOOM_BITS))


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over the column rid: one row for each of its words at most is collected."""
    words = ids.select(F.explode(F.array(bloom_word(F.col("rid"), 1), bloom_word(F.col("rid"), 2))).alias("bit")).groupBy(
        F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    bits = np.zeros(BLOOM_BITS // 64, np.int64)
    for r in words.collect():
        bits[r.word] = r.bits
    return bits


def hashed(rows: DataFrame) -> DataFrame:
    """(rid, text) with the two places of each rid in a Bloom filter."""
    return rows.select("rid", "text", bloom_word(F.col("rid"), 1).alias("b1"), bloom_word(F.col("rid"), 2).alias("b2"))


def passed(batch: pa.RecordBatch, bits: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The rid and text of the rows that a Bloom filter lets through."""
    keep = np.ones(batch.num_rows, bool)
    for i in (2, 3):
        at = batch.column(i).to_numpy()
        keep &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    rid, text = (batch.column(i).filter(pa.array(keep)) for i in (0, 1))
    return rid, text


def sets_of(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Stored (rid, x) with the sorted array of each row of ``ids`` and of the few others that its Bloom filter lets through."""
    bits = bloom_filter(ids)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, text = passed(batch, bits)
            yield pa.RecordBatch.from_arrays([rid, pa.array([x.tobytes() for x in shingle_sets(text, n)], pa.binary())], ["rid", "x"])

    return stored(hashed(rows).mapInArrow(arrays, "rid long, x binary"), "arrays")


def profiles(rows: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """Stored (rid, n, bitmap, s0 to s3, level, size, keep, list) of the rows ``reps`` and few others (see ``bloom_filter``):
    a row for each of ``key_lists``, the bitmaps on the first of a rid only. Rows with rid -1 name keys of many lists."""
    bits = bloom_filter(reps)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, text = passed(batch, bits)
            out: list[list] = [[] for _ in range(11)]
            for r, x in zip(rid.to_pylist(), shingle_sets(text, n)):
                marks = [bitmap(x), *signature(x)] if len(x) else []
                for level, keep, keys in key_lists(x, percent):
                    row = (r, len(x), *(marks or [None] * 5), level, len(keys), keep, keys.view(np.int64))
                    marks = []
                    for column, value in zip(out, row):
                        column.append(value)
            # keys in more than a thousandth of these lists' places: any that is so often in all lists is so in some batch
            places = np.concatenate(out[10]) if out[10] else np.zeros(0, np.int64)
            key, times = np.unique(places, return_counts=True)
            often = key[(times > 1) & (times * HEAVY >= len(places))]
            if len(often):
                for column, value in zip(out, (-1, *[None] * 9, often)):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             ["rid", "n", "bitmap", "s0", "s1", "s2", "s3", "level", "size", "keep", "list"])

    return stored(hashed(rows).mapInArrow(describe, "rid long, n long, bitmap binary, s0 long, s1 long, s2 long, s3 long, level int, "
                                                    "size int, keep int, list array<long>"), "profiles")


def bounded(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b, slack) of the pairs whose bitmaps allow a link; slack: the upper bound less what a link needs."""
    left = known.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba"))
    right = known.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ba, bb = (batch.column(i).to_pylist() for i in range(6))
            slack = [min((x + y - differing_bits(u, v)) // 2, x, y) * (100 + percent) - percent * (x + y)
                     for x, y, u, v in zip(na, nb, ba, bb)]
            keep = [i for i, s in enumerate(slack) if s >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()),
                                              pa.array([slack[i] for i in keep], pa.int64())], ["a", "b", "slack"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(
        bound, "a long, b long, slack long")


def links(pairs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Stored (a, b) of the stored ``pairs`` whose sets are linked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for u, v in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(linked(int((y[at] == x).sum()), len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    sets = sets_of(rows, ids, n)
    left, right = sets.select(F.col("rid").alias("a"), F.col("x").alias("xa")), sets.select(F.col("rid").alias("b"), F.col("x").alias("xb"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(check, "a long, b long"), "links")


def tile_keys(rows: DataFrame, classes: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored (rid, n, key, common) of the keys that several classes have, and the bitmaps of those classes; common: how often
    all lists hold what this list holds, so the largest is a group's most typical row."""
    reps = classes.select(F.col("rep").alias("rid"))
    known = profiles(rows, reps, n, percent)
    lists = known.filter("rid >= 0").select("rid", "n", "level", "size", "keep", "list")
    listed = lists.select("rid", "level", F.explode("list").alias("key"))
    total = lists.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    often = stored(known.filter("rid = -1").select(F.explode("list").alias("key")).distinct(), "often")
    if often.count() <= BROADCAST_ROWS:  # else the lists are shuffled to find which of these are hot
        often = F.broadcast(often)
    hot = stored(listed.join(often, "key").groupBy("key").agg(F.count(F.lit(1)).alias("of")).filter(F.col("of") * HEAVY > total), "hot")
    # fewer than HEAVY keys are hot; the lists of each other one meet in a shuffle
    rest = listed.join(F.broadcast(hot.select("key")), "key", "left_anti").withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("key")))
    names = ["rid", "level", "key", "of"]
    counted = stored(rest.filter("of > 1").select(*names).unionByName(listed.join(F.broadcast(hot), "key").select(*names)), "counted")
    by_list = Window.partitionBy("rid", "level")
    # keys of one list only come first in its order: as many places are taken
    place = F.row_number().over(by_list.orderBy("of", "key")) - F.count(F.lit(1)).over(by_list)
    placed = counted.join(reps, "rid", "left_semi").withColumn("place", place).withColumn(  # without the others that the filter let through
        "common", F.sum("of").over(by_list))
    home = stored(placed.join(lists.drop("list"), ["rid", "level"]).filter(
        F.col("place") + F.col("size") <= F.col("keep")).select("rid", "n", "key", "common"), "keys")
    marks = known.filter("bitmap is not null").select("rid", "n", "bitmap", "s0", "s1", "s2", "s3")
    return home, stored(marks.join(home.select("rid").distinct(), "rid", "left_semi"), "known")


def labelled(df: DataFrame, labels: DataFrame | None, rid: str, label: str) -> DataFrame:
    """``df`` with the label of column ``rid``: its own id where no link is known."""
    if labels is None:
        return df.withColumn(label, F.col(rid))
    other = labels.select(F.col("node").alias("__of"), F.col("label").alias("__label"))
    return df.join(other, df[rid] == other["__of"], "left").withColumn(
        label, F.coalesce("__label", rid)).drop("__of", "__label")


def candidates(home: DataFrame, known: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """(a, b) to compare: rows with the pivots of their tiles, or in the last round all pairs of a tile,
    where the labels differ."""
    now = labelled(home, labels, "rid", "label")
    # another order of ids, another pivot: so the keys of a large group have several
    masks = F.array(*[F.lit(random.Random(turn * ORDERS + i).getrandbits(62)) for i in range(ORDERS)])
    mask = F.element_at(masks, (F.pmod(F.xxhash64("key"), F.lit(ORDERS)) + 1).cast("int"))
    first = F.lit(0) if turn else -F.col("common")
    info = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(
        first.alias("first"), F.col("rid").bitwiseXOR(mask).alias("x"))).alias("p")).filter("lo < hi").select(
            "key", F.col("p.x").bitwiseXOR(mask).alias("b"))
    if turn < ROUNDS:
        pairs = now.join(labelled(info, labels, "b", "lb"), "key").filter("label <> lb")
        return pairs.select(F.col("rid").alias("a"), "b").distinct()
    mixed = now.join(info.select("key"), "key").join(known.select("rid", "s0", "s1", "s2", "s3"), "rid")
    return tile_pairs(mixed, percent).distinct()


def tile_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (rid, n, key, label, s0 to s3) of a tile with different labels that 256 bits allow a link. A pair may
    come from several of its tiles, but not from those before which, by ``LAST`` keys of both rows, it met in another."""
    by_row = Window.partitionBy("rid").orderBy("key")
    mixed = mixed.withColumn("last", F.collect_list("key").over(by_row.rowsBetween(-LAST, -1)))
    names = ["rid", "n", "label", "s0", "s1", "s2", "s3", "last"]
    one, two = (mixed.select("key", *[F.col(c).alias(f"{c}_{side}") for c in names]) for side in "ab")
    n_a, n_b, both = F.col("n_a"), F.col("n_b"), F.col("n_a") + F.col("n_b")
    differ = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(4)), F.lit(0))
    # n + m - differ may be odd: twice the bound is compared
    bound = F.least(both - differ, 2 * n_a, 2 * n_b) * (100 + percent) >= 2 * percent * both
    pairs = one.join(two, "key").filter((F.col("rid_a") < F.col("rid_b")) & (F.col("label_a") != F.col("label_b")) & bound & ~F.arrays_overlap(
        "last_a", "last_b"))
    return pairs.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))


def near_components(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(rid, n, label) of every row of the stored ``rows`` (rid, text): label is the same for rows of one
    component (null for rows with an empty set)."""
    sets = class_rows(rows, n)
    classes = stored(sets.filter("n > 0").groupBy("digest").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    home, known = tile_keys(rows, classes, n, percent)
    labels = None
    for turn in range(ROUNDS + 1):
        passed = bounded(candidates(home, known, labels, turn, percent), known, percent)
        if turn < ROUNDS:  # of several pivots the likeliest; the last round leaves none out
            best = Window.partitionBy("a").orderBy(F.col("slack").desc(), "b")
            passed = passed.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= TRIED)
        pairs = stored(passed.select("a", "b"), "pairs")
        if pairs.isEmpty():
            continue
        new = links(pairs, rows, n, percent)
        if not new.isEmpty():
            labels = components(new if labels is None else new.union(labels.select("node", "label")))
    whole = classes if labels is None else classes.join(labels, classes["rep"] == labels["node"], "left")
    label = F.col("rep") if labels is None else F.coalesce("label", "rep")
    whole = whole.select("digest", "copies", label.alias("label"))
    return join_counted(sets, whole, "digest", "copies", sets.count(), "left").select("rid", "n", "label")


def ngram_jaccard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80,
                  row_id: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (stored, if it has a row id): rid, doc_id, n_shingles, component_id (smallest doc_id
    of its component), kept (one row of each component; rows with an empty set all stay)."""
    task_memory(docs.sparkSession)
    if row_id:
        base = docs.select(F.col(row_id).alias("rid"), F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    else:
        base = stored(with_row_id(docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text")), "rid"), "numbered")
    rows, ids = base.select("rid", "text"), base.select("rid", "doc_id")
    all_rows = stored(near_components(rows, n, percent).join(ids, "rid"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid"))
    roots = all_rows.filter("label is not null").groupBy("label").agg(first.alias("root"), F.count(F.lit(1)).alias("members"))
    return join_counted(all_rows, stored(roots, "roots"), "label", "members", all_rows.count(), "left").select(
        "rid", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("root.doc_id")).alias("component_id"),
        (F.col("label").isNull() | (F.col("rid") == F.col("root.rid"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. Those that a Bloom filter of the dropped ones doesn't know stay
    where they are; only the others are shuffled, to join them with the ids of all that stay."""
    rid, maybe = fresh(docs, "__rid"), fresh(docs, "__maybe")
    rows = stored(with_row_id(docs, rid), "numbered")
    found = stored(ngram_jaccard(rows, doc_id, text, n, percent, rid).select("rid", "kept"), "kept")
    bits = bloom_filter(found.filter("not kept"))

    def known(first: pd.Series, second: pd.Series) -> pd.Series:
        a, b = first.to_numpy(), second.to_numpy()
        return pd.Series((bits[a >> 6] >> (a & 63)) & (bits[b >> 6] >> (b & 63)) & 1 == 1)

    hit = F.pandas_udf(known, "boolean")
    rows = rows.withColumn(maybe, hit(*[bloom_word(F.col(rid), i) for i in (1, 2)]))
    stays = found.filter("kept").select(F.col("rid").alias(rid))
    sure, open_ = rows.filter(~F.col(maybe)), rows.filter(maybe).join(stays, rid, "left_semi")
    return sure.select(*columns_of(docs)).unionByName(open_.select(*columns_of(docs)))
