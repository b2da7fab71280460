import itertools

import numpy as np
import pytest

from capforge.llm import vector_dedup as V

SCHEMA = "vec_id long, embedding array<double>, label int, rid long, c string, `a.b` int"


def made(spark, rows, **options):
    full = [(i, v, 0, 7, "x", 1) for i, v in rows]
    df = V.near_vectors(spark.createDataFrame(full, SCHEMA).repartition(3), **options)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def brute(rows, least=0.95):
    """All pairs of rows by their cosine."""
    def takes_part(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def unit(v):
        v = [x / max(map(abs, v)) for x in v]
        return np.array(v) / np.sqrt(sum(x * x for x in v))

    units = [unit(v) if takes_part(v) else None for _, v in rows]
    near = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        u, v = units[i], units[j]
        if u is not None and v is not None and len(u) == len(v) and float(u @ v) >= least:
            near[i].add(j)
            near[j].add(i)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root = min(ids) if ids else None
        out.append((vec_id, len(near[i]), root, vec_id is not None and vec_id == root))
    return sorted(out, key=repr)


def clustered(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    return [(int(i), (centres[rng.integers(len(centres))] + spread * rng.normal(size=dim)).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("dim,spread,block", [(16, 0.2, 16384), (16, 0.25, 40), (64, 0.22, 100)])
def test_equals_all_pairs(spark, dim, spread, block):
    rows = clustered(240, dim, dim, spread)
    rows += [(i + 1000, v) for i, v in rows[:40]] + rows[:5]  # copies, and whole rows again
    got = made(spark, rows, block=block)
    assert got == brute(rows) and sum(r[1] for r in got) > 100


def test_odd_vectors(spark):
    rows = [(5, None), (4, []), (3, [0.0, 0.0]), (2, [1.0, None]), (1, [float("nan"), 1.0]), (0, [float("inf"), 1.0]),
            (9, [1.0, 0.0]), (8, [1e300, 0.0]), (7, [5e-320, -0.0]), (6, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]),
            (None, [0.0, 1.0]), (None, [0.001, 1.0])]
    assert made(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert made(spark, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 48)) * 10.0 ** rng.integers(-200, 200, 200)[:, None]
    x[:50] = np.where(rng.random((50, 48)) < 0.9, 0, x[:50]) + (x[:50] == 0) * 0  # sparse ones
    x = x[np.abs(x).max(axis=1) > 0]
    q, scale, error = V.quantised(x)
    assert q.dtype == np.int8 and np.abs(q.astype(int)).max() == 127
    true = V.cosines(np.repeat(x, len(x), 0), np.tile(x, (len(x), 1))).reshape(len(x), -1)
    estimate = (q.astype(float) @ q.astype(float).T) * scale[:, None] * scale
    bound = (1 + error)[:, None] * error + error[:, None]
    assert (np.abs(true - estimate) <= bound).all()


def test_only_open_pairs_are_computed_again(monkeypatch):
    x = np.random.default_rng(1).normal(size=(600, 64))
    a = V.quantised(x)
    pairs = sum(len(i) for i, _ in V.open_pairs(a, a, 0.95))
    assert 600 <= pairs < 620  # each with itself, hardly any other
