"""Sliding statistics over index ranges of sorted arrays, in time proportional to rows times a logarithm at most.

Helpers for tasks of the device windows: ``low`` and ``high`` are the first and one-past-last index of each
row's range; both never decrease within a group. Missing values are NaN and are left out.
"""

from __future__ import annotations

import numpy as np


def edges(group: np.ndarray, t: np.ndarray, at: np.ndarray, at_group: np.ndarray) -> np.ndarray:
    """For each (at_group, at) the first index of rows sorted by (group, t) with t > at in that group, or
    the group's end. Times are ranked first, so that no span of time is too long."""
    times = np.unique(t)
    width = len(times) + 1
    key = group.astype(np.int64) * width + np.searchsorted(times, t)
    return np.searchsorted(key, at_group.astype(np.int64) * width + np.searchsorted(times, at, side="right"), side="left")


def range_max(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest value of each range (NaN: none), from maxima over power-of-two runs."""
    out = np.full(len(low), np.nan)
    run, size = np.where(np.isnan(x), -np.inf, x), 1
    length = high - low
    while True:
        here = (length >= size) & (length < 2 * size)
        out[here] = np.maximum(run[low[here]], run[high[here] - size])
        if not (length >= 2 * size).any():
            break
        run = np.maximum(run[:-size], run[size:]) if len(run) > size else run
        size *= 2
    return np.where(np.isneginf(out), np.nan, out)


def present(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(~np.isnan(x))])
    return count[high] - count[low]


def running(x: np.ndarray) -> np.ndarray:
    """Running sums in extended precision, from zero."""
    return np.concatenate([[0], np.cumsum(np.where(np.isnan(x), 0, x).astype(np.longdouble))])


def range_sum(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = running(x)
    return np.where(present(x, low, high) > 0, (total[high] - total[low]).astype(float), np.nan)


def range_mean(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = present(x, low, high)
    return range_sum(x, low, high) / np.maximum(n, 1)


def range_std(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sample standard deviation; exactly 0 where all values are equal, NaN below two values."""
    d = x - (np.nanmean(x) if not np.isnan(x).all() else 0.0)
    n, one, two = present(x, low, high), running(d), running(d * d)
    s, q = one[high] - one[low], two[high] - two[low]
    var = (q - s * s / np.maximum(n, 1)) / np.maximum(n - 1, 1)
    same = range_max(x, low, high) == -range_max(-x, low, high)
    out = np.sqrt(np.maximum(var, 0)).astype(float)
    return np.where(n < 2, np.nan, np.where(same, 0.0, out))


def smallest(rank: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th smallest (from 0) of ``rank[low:high]`` for every range at once; ``k < high - low``.

    A wavelet matrix: bit by bit from the highest, ranks with a 0 move before those with a 1 (each half in its old
    order), and a range follows its ``k``-th rank into the half that holds it. One pass over rows and
    ranges a bit, whatever the ranges' widths and however the values jump.
    """
    found, low, high, k = np.zeros(len(low), np.int64), low.copy(), high.copy(), k.copy()
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        first, last = zeros[low], zeros[high]
        up = k >= last - first
        k = np.where(up, k - (last - first), k)
        low, high = np.where(up, zeros[-1] + low - first, first), np.where(up, zeros[-1] + high - last, last)
        found |= up.astype(np.int64) << bit
        rank = np.concatenate([rank[~one], rank[one]])
    return found


def range_median(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Median of each range, the mean of the two middle values where there are two (NaN: none)."""
    held = ~np.isnan(x)
    before = np.concatenate([[0], np.cumsum(held)])
    first, last = before[low], before[np.maximum(high, low)]
    out, some = np.full(len(low), np.nan), np.flatnonzero(last > first)
    if not len(some):
        return out
    values, rank = np.unique(x[held], return_inverse=True)
    size = (last - first)[some]
    lower = smallest(rank, first[some], last[some], (size - 1) // 2)
    upper, even = lower.copy(), np.flatnonzero(size % 2 == 0)
    upper[even] = smallest(rank, first[some][even], last[some][even], size[even] // 2)
    out[some] = (values[lower] + values[upper]) / 2
    return out
