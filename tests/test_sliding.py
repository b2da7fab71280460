import statistics
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from capforge.operators import sliding as S

GROUPS = st.lists(st.lists(st.tuples(st.integers(0, 30), st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=12), min_size=1, max_size=4)


@settings(max_examples=200, deadline=None)
@given(GROUPS, st.integers(1, 12), st.booleans())
def test_ranges_match_definition(groups, width, shifted):
    rows = [(g, t, float("nan") if v is None else float(v)) for g, some in enumerate(groups) for t, v in sorted(some, key=lambda r: r[0])]
    group, t, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    low, high = S.edges(group, t, t - width, group), np.arange(len(t)) + 1
    if shifted:
        first = np.concatenate([[True], group[1:] != group[:-1]])
        before = np.maximum(np.arange(len(t)) - 1, 0)
        low, high = np.where(first, 0, low[before]), np.where(first, 0, high[before])
    for i in range(len(t)):
        upto = i - 1 if shifted else i
        seen = [x[j] for j in range(len(t)) if upto >= 0 and group[upto] == group[i] == group[j] and j <= upto and t[j] > t[upto] - width and x[j] == x[j]]
        for fn, least, want in ((S.range_max, 1, max), (S.range_sum, 1, sum), (S.range_mean, 1, statistics.mean), (S.range_std, 2, statistics.stdev)):
            got = fn(x, low, high)[i]
            np.testing.assert_allclose(got, want(seen) if len(seen) >= least else np.nan, rtol=1e-9, atol=1e-9)
        np.testing.assert_equal(S.range_median(x, low, high)[i], statistics.median(seen) if seen else np.nan)


@pytest.mark.parametrize("shape", ["many devices", "one device", "jumping values", "few values"])
def test_median_time_follows_the_rows(shape):
    def seconds(n: int) -> float:
        rng = np.random.default_rng(0)
        group = np.arange(n) * 7500 // n if shape == "many devices" else np.zeros(n, int)
        t = np.arange(n)
        x = {"jumping values": np.where(t % 2 == 0, t, 10.0 ** 9 - t).astype(float), "few values": rng.integers(0, 3, n).astype(float)}.get(
            shape, rng.normal(size=n))
        low = S.edges(group, t, t - (28 if shape == "one device" else n // 4), group)
        best = []
        for _ in range(3):
            start = time.perf_counter()
            S.range_median(x, low, np.arange(n) + 1)
            best.append(time.perf_counter() - start)
        return min(best)

    assert seconds(100_000) < 1
    assert seconds(200_000) < 4 * seconds(50_000) * 2  # n log n, with room for a busy machine


def test_median_of_wide_ranges():
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.1, np.nan, rng.normal(size=3000))
    low = np.sort(rng.integers(0, 3000, 500))
    high = np.maximum(low, np.sort(rng.integers(0, 3001, 500)))
    with np.errstate(all="ignore"):
        want = [np.nan if np.isnan(x[a:b]).all() else np.nanmedian(x[a:b]) for a, b in zip(low, high)]
    np.testing.assert_array_equal(S.range_median(x, low, high), want)
