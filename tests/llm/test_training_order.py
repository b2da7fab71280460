from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from capforge.llm import common
from capforge.llm import training_order as T

RANKS = P.path("byte_bpe_50k.tiktoken")
ROWS = [(1, None), (2, ""), (3, "a few words"), (3, "a few words"), (None, "x"), (4, "long text " * 3000), (5, "é 日本")] + [
    (10 + i, f"document number {i} " * (i % 9)) for i in range(120)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 256, 1000, 4097])
def test_permutation(n):
    slots = T.permuted(np.arange(n), n)
    assert sorted(slots) == list(range(n))
    assert (T.permuted(slots, n, back=True) == np.arange(n)).all()
    assert n < 50 or (slots != T.permuted(np.arange(n), n, key=7)).any()


def test_round_trip_and_resume(spark, frame):
    path = common.shared_path(spark, "order-test")
    n = T.write_training_order(frame(ROWS), path, RANKS, P.PATTERN, length=16, per_shard=100)
    got = {r.slot: r for r in T.read_training_order(spark, path, 16, 100).collect()}
    assert sorted(got) == list(range(n)) and n > 300
    stream = np.concatenate([got[int(s)].ids for s in T.permuted(np.arange(n), n)])
    encode, end = T.encoder(RANKS, P.PATTERN)
    docs = Counter(tuple(map(int, x[:-1])) for x in np.split(stream, np.flatnonzero(stream == end) + 1)[:-1])
    assert docs == Counter(tuple(encode(t or "")) for _, t in ROWS)
    later = T.read_training_order(spark, path, 16, 100, first_slot=250, ids=False).collect()
    assert sorted(r.slot for r in later) == list(range(250, n))
    assert all(r.ids_sha256 == got[r.slot].ids_sha256 for r in later)


def test_fixed_stride(spark, frame):
    path = common.shared_path(spark, "order-test")
    n = T.write_training_order(frame(ROWS), path, RANKS, P.PATTERN, length=16, per_shard=100)
    sizes = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").collect()]
    assert sorted(sizes) == sorted([100 * 36] * (n // 100) + [n % 100 * 36] * (n % 100 > 0))


def test_empty(spark, frame):
    assert T.write_training_order(frame(ROWS).limit(0), common.shared_path(spark, "order-test"), RANKS, P.PATTERN) == 0
