import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from capforge.llm import queries
from capforge.llm import vector_topk as V


def brute(rows, asked, k, scale=256):
    """All pairs of rows, in whole numbers."""
    ok = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)]
    out = []
    for a, (q, v) in enumerate(ok):
        if asked(q):
            others = sorted((-max(-V.LONG, min(V.LONG, sum(s * t for s, t in zip(v, w)))), i)
                            for b, (i, w) in enumerate(ok) if a != b and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(others[:k])]
    return sorted(out)


def got(spark, rows, k=5):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, rid int, c int, `a.b` int").coalesce(2)
    return sorted(tuple(r) for r in V.exact_top_k(df, lambda i: i % 3 == 0, k).collect())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.1, 0.2]), (3, [0.1, 0.2]), (3, [0.1, 0.2]), (6, [1.0, -1.0]), (9, None), (12, []), (15, [nan, 1.0]), (18, [inf, 1.0]),
            (21, [None, 1.0]), (None, [0.5, 0.5]), (24, [0.5, 0.5, 0.5]), (27, [0.4, 0.4, 0.4]), (1, [0.1, 0.2]), (2, [0.0, 0.0]), (33, [1e300, 0.0]),
            (36, [1e308, 1.0])]
    assert got(spark, rows) == brute(rows, lambda i: i % 3 == 0, 5)
    assert got(spark, []) == []


@pytest.mark.parametrize("k", [1, 5, 7])
def test_random_with_ties_and_copies(spark, monkeypatch, k):
    monkeypatch.setattr(V, "QUERY_BLOCK", 16)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 40)
    rnd = random.Random(k)
    base = [[rnd.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) if i % 2 else rnd.uniform(-1, 1) for _ in range(6)] for i in range(120)]
    rows = [(i, list(v)) for i, v in enumerate(base)] + [(200 + i, list(base[0])) for i in range(60)] + [(900, [0.0] * 6)] * 3
    rows += [(i, list(v)) for i, v in enumerate(base[:20])]  # whole rows again
    assert got(spark, rows, k) == brute(rows, lambda i: i % 3 == 0, k)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(-256, 256), st.integers(-(1 << 52), 1 << 52)), min_size=4, max_size=4), min_size=2, max_size=12))
def test_bounds_hold(vectors):
    x = np.array(vectors, float)
    made = [V.cell_codes(v) for v in x]
    lower, upper = V.bounds(x, np.array([c for _, c in made]), np.array([w for w, _ in made]))
    for i, v in enumerate(vectors):
        for j, w in enumerate(vectors):
            true = sum(a * b for a, b in zip(v, w))
            assert int(lower[i, j]) <= max(-(1 << 63), min(1 << 63, true)) <= int(upper[i, j])
            if max(map(abs, v)) < 1 << 20 and max(map(abs, w)) <= 127:
                assert lower[i, j] == upper[i, j] == true  # one byte holds the component


def test_large_components(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.uniform(-1, 1) * rnd.choice([1, 1e5, 4e6]) for _ in range(5)]) for i in range(80)] + [(90, [70000.0] * 5), (91, [-65537.0, 0.0, 0.0, 0.0, 1e6])]
    rows += [(i, [rnd.uniform(-1, 1) * 10.0 ** rnd.randrange(0, 30) for _ in range(5)]) for i in range(100, 130)]
    assert got(spark, rows) == brute(rows, lambda i: i % 3 == 0, 5)
    small = [(i, [x / 4e4 for x in v]) for i, v in rows]
    assert got(spark, small) == brute(small, lambda i: i % 3 == 0, 5)
    assert got(spark, [(0, [0.01, 0.0]), (1, [2.0 ** 25, 0.0]), (2, [1.0, 0.0])]) == [(0, 1, 1, 17179869184), (0, 2, 2, 512)]


def test_repeated_rows_are_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 1.0])]
    assert [r[2] for r in got(spark, rows)] == [1, 1, 2]


def test_against_sql(spark, tmp_path):
    """Repeated rows, large components and ties; no row is taken out."""
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, rnd.uniform(-1, 1)]) * rnd.choice([1, 1, 1, 1e5]) for _ in range(4)]) for i in range(300)]
    rows += [(i % 7 * 50, [0.5, 0.0, -1.0, 0.0]) for i in range(40)] + rows[:60] + [(None, [0.5] * 4), (1000, [2.0 ** 25, 0.0, 0.0, 0.0])]
    rows += [(50, None), (100, [float("nan")] * 4), (150, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(queries.ORACLE["op10_exact_top_k"]).fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES["op10_exact_top_k"](spark, str(tmp_path)).collect()) == sorted(want)
