"""Token ids in training order: packed sequences, a keyed permutation, fixed-stride binary shards.

1. Each scan task packs its documents' ids, an end mark after each, into sequences of ``length`` ids (the
   task's last one is padded) and stores them in compressed blocks: (part, before, n, block), ``before``
   being the task's sequences so far. Texts are encoded once.
2. The stored parts' sequence counts, added up, number all sequences 0 to n - 1.
3. A keyed Feistel network over the smallest even number of bits that holds n, walked until it falls below
   n again, sends each number to its slot: a permutation without a table or a sort of all rows.
4. Slots are range-partitioned: partition i gets slots [i * per_shard, (i + 1) * per_shard), sorts them and
   writes shard i. A record is ``length`` unsigned 16-bit ids and the number of real ids as unsigned 32 bits,
   all little-endian; its last byte is zero, which is the writer's separator. Slot s is at byte
   (s mod per_shard) * stride of shard s // per_shard, so readers go on from any slot.

Defined results: null counts as empty, and an empty text is an end mark alone; rows that repeat are all
written; an empty table gives no shards; other columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capforge.llm.common import join_per_key, mix, stored, task_memory, text_or_empty

LENGTH = 2048
PER_SHARD = 16_384
KEY = 20_240_501
ROUNDS = 4
#: Sequences in a stored block, and in a task of a reader.
BLOCK, READ = 128, 2048


def permuted(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slots of sequence numbers below ``n`` (``back``: the numbers of slots)."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key) * np.uint64(ROUNDS + 1))
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> bits, x[todo] & mask
        for k in (keys[::-1] if back else keys):
            if back:
                left, right = right ^ (mix(left + k) & mask), left
            else:
                left, right = right, left ^ (mix(right + k) & mask)
        x[todo] = left << bits | right
        todo &= x >= n
    return x.astype(np.int64)


def encoder(path: str, pattern: str):
    """A function from a text to its ids, and the end mark's id, for a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    end = max(ranks.values()) + 1
    if end > 0xFFFF:
        raise ValueError("ids need more than 16 bits")
    return model.encode_ordinary, end


def packed(docs: DataFrame, ranks: str, pattern: str, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Stored (part, before, n, block): each task's sequences in compressed blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, (encode, end) = TaskContext.get().partitionId(), encoder(ranks, pattern)
        squeeze = zstandard.ZstdCompressor(level=6)
        held, size, before = [], 0, 0

        def block(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal before
            n = len(ids) // (length + 2)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int32()),
                                              pa.array([squeeze.compress(ids.tobytes())], pa.binary())], ["part", "before", "n", "block"])
            before += n
            return out

        def full(ids: np.ndarray) -> np.ndarray:
            """Rows of ``length`` ids and their number as two 16-bit halves."""
            count = np.array([length & 0xFFFF, length >> 16], np.uint16)
            return np.hstack([ids.reshape(-1, length), np.broadcast_to(count, (len(ids) // length, 2))]).ravel()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(np.array(encode(t) + [end], np.uint16))
                size += len(held[-1])
                if size >= BLOCK * length:
                    ids = np.concatenate(held)
                    while len(ids) >= BLOCK * length:
                        yield block(full(ids[:BLOCK * length]))
                        ids = ids[BLOCK * length:]
                    held, size = [ids], len(ids)
        if size:
            ids = np.concatenate(held)
            whole = len(ids) // length * length
            last, rest = full(ids[:whole]), ids[whole:]
            if len(rest):
                pad = np.zeros(length + 2, np.uint16)
                pad[:len(rest)], pad[length], pad[length + 1] = rest, len(rest) & 0xFFFF, len(rest) >> 16
                last = np.concatenate([last, pad])
            yield block(last)

    return stored(docs.select(text_or_empty(F.col(text)).alias("text")).mapInArrow(
        pack, "part int, before long, n int, block binary"), "packed")


def write_training_order(docs: DataFrame, path: str, ranks: str, pattern: str, text: str = "text", length: int = LENGTH,
                         per_shard: int = PER_SHARD, key: int = KEY) -> int:
    """Write the shards below ``path``; the number of sequences."""
    task_memory(docs.sparkSession)
    blocks = packed(docs, ranks, pattern, text, length)
    # a row for each scan task
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    first = stored(parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), "n"), "parts")
    total = first.agg(F.sum("n")).first()[0] or 0
    if not total:
        return 0
    stride = 2 * (length + 2)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small, open_ = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            for start, n, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data, slot = open_.decompress(block), permuted(np.arange(start, start + n), total, key)
                rows = [small.compress(data[i * stride:(i + 1) * stride]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard, pa.int32()), pa.array(slot, pa.int64()),
                                                  pa.array(rows, pa.binary())], ["shard", "slot", "row"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = [open_.decompress(x)[:-1] for x in part.column(2).to_pylist()]  # the separator is the last byte
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], ["shard", "slot", "row"])

    numbered = join_per_key(blocks, first.select("part", "first"), "part").select((F.col("first") + F.col("before")).alias("start"), "n", "block")
    dealt = numbered.mapInArrow(deal, "shard int, slot long, row binary").repartitionById(-(-total // per_shard), F.col("shard"))
    dealt.mapInArrow(unpack, "shard int, slot long, row binary").sortWithinPartitions("shard", "slot").select(
        "shard", F.col("row").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\0").text(path)
    return total


def read_training_order(spark: SparkSession, path: str, length: int = LENGTH, per_shard: int = PER_SHARD,
                        first_slot: int = 0, ids: bool = True) -> DataFrame:
    """(slot, n_tokens, ids, ids_sha256) of slots from ``first_slot`` on; without ``ids`` that column is null."""
    stride = 2 * (length + 2)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", (F.col("length") / stride).cast("long").alias("n"),
        (F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long") * per_shard).alias("base"))
    todo = files.filter(F.col("base") + F.col("n") > first_slot).select(
        "path", "base", "n", F.explode(F.sequence(F.greatest(F.lit(first_slot) - F.col("base"), F.lit(0)), F.col("n") - 1, F.lit(READ))).alias("start"))
    todo = todo.repartition(max(1, todo.count()), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri, base, n, start in zip(*(batch.column(k).to_pylist() for k in range(4))):
                system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
                with system.open_input_file(name) as file:
                    file.seek(start * stride)
                    rows = np.frombuffer(file.read(min(READ, n - start) * stride), "<u2").reshape(-1, length + 2)
                counts = rows[:, length].astype(np.int64) + (rows[:, length + 1].astype(np.int64) << 16)
                real = [row[:c] for row, c in zip(rows, counts)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(base + start + np.arange(len(rows)), pa.int64()), pa.array(counts),
                    pa.array([r.astype(np.int32) for r in real] if ids else [None] * len(real), pa.list_(pa.int32())),
                    pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in real], pa.string())], ["slot", "n_tokens", "ids", "ids_sha256"])

    return todo.mapInArrow(read, "slot long, n_tokens long, ids array<int>, ids_sha256 string")
