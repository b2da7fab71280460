import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from capforge.llm import ngram_join as J


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, n):
    w = words(t)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    """(n_shingles, component id) of each row, rows being told apart by position."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    group = {}
    for i in range(len(rows)):
        group.setdefault(find(i), []).append(i)
    least = {k: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for k, g in group.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=repr)


def varied(seed, groups=12, copies=9, size=60):
    rnd, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(3, size))]
        for _ in range(rnd.randrange(1, copies)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(30)}"
            out.append(" ".join(w[:rnd.randrange(max(1, len(w) - 4), len(w) + 1)]))
    return list(enumerate(out))


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (7, "one two"), (8, "one two three"),
        (None, "one two three"), (9, "É a b c"), (10, "é a b c"), (11, "x y z w"), (12, "x y z w"), (13, "a\x1cb c d"),
        (14, "lorem " * 30_000), (15, "lorem  " * 30_001), (16, "a b c a b c a b c"), (17, "a b c a b c")]


def got(df, n, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_jaccard(df, n=n, percent=percent).collect()), key=repr)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 60)])
def test_matches_all_pairs(frame, n, percent):
    rows = varied(n) + [(1000 + (i or 0) if i is not None else None, t) for i, t in EDGE]
    assert got(frame(rows), n, percent) == brute(rows, n, percent)


def test_last_round_finds_what_pivots_miss(frame, monkeypatch):
    monkeypatch.setattr(J, "ROUNDS", 0)
    rows = varied(5)
    assert got(frame(rows), 3, 70) == brute(rows, 3, 70)


def test_chain_of_links(frame):
    w = [f"t{i}" for i in range(140)]
    rows = [(i, " ".join(w[i:i + 100])) for i in range(0, 40, 2)]  # each linked with its neighbours alone
    assert got(frame(rows), 3, 90) == brute(rows, 3, 90)


def test_stage_keeps_one_of_each(frame):
    rows = varied(8) + EDGE[:3]
    df = frame(rows)
    kept = J.keep_one_of_each(df, n=3, percent=80)
    assert kept.columns == df.columns
    want = brute(rows, 3, 80)
    assert kept.count() == len({c for _, n, c in want if n}) + sum(n == 0 for _, n, _ in want)


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_only_rows_that_a_filter_of_the_dropped_ones_knows_are_shuffled(frame, monkeypatch, bits):
    monkeypatch.setattr(J, "BLOOM_BITS", bits)  # a full filter lets all rows through, a join decides
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0 if bits == 64 else 100)
    rows = varied(8) + EDGE
    kept = J.keep_one_of_each(frame(rows), n=3, percent=80)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # before: one join of all texts
    got_ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    alone = sorted((r.doc_id for r in J.ngram_jaccard(frame(rows), n=3, percent=80).filter("kept").collect()), key=repr)
    assert got_ids == alone


def test_empty(frame):
    assert J.ngram_jaccard(frame(EDGE).limit(0)).count() == 0
    assert J.ngram_jaccard(frame(EDGE[:3])).filter("n_shingles = 0 AND component_id = doc_id AND kept").count() == 3


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2 ** 64 - 1), min_size=1, max_size=300), st.sets(st.integers(0, 2 ** 64 - 1), min_size=1, max_size=300),
       st.sets(st.integers(0, 2 ** 64 - 1), max_size=300))
def test_bitmaps_bound_the_overlap(a, b, common):
    a, b = a | common, b | common
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert len(a & b) <= (len(a) + len(b) - J.differing_bits(J.bitmap(x), J.bitmap(y))) // 2
    assert len(a & b) <= (len(a) + len(b) - int(np.bitwise_count((J.signature(x) ^ J.signature(y)).view(np.uint64)).sum())) // 2


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2 ** 64 - 1), min_size=1, max_size=80), st.integers(0, 8), st.integers(0, 8), st.sampled_from([50, 80, 90]))
def test_linked_sets_share_as_many_keys(common, drop, extra, percent):
    """Lists are the first in the order of the numbers, keys the first of a list in any other order that all share."""
    a = sorted(common)
    b = sorted(set(a[drop:]) | {2 ** 64 + i * 7919 ** 5 for i in range(extra)})
    if b and 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b)):
        for seed in range(5):
            keys, leasts = [], []
            for x in (a, b):
                size, keep, least = J.list_sizes(len(x), percent)
                assert 1 <= least <= keep <= size <= len(x)
                keys.append(set(sorted(x[:size], key=lambda v: hash((v, seed)))[:keep]))
                leasts.append(least)
            assert len(keys[0] & keys[1]) >= min(leasts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n\x0b\x0c\r Р", max_size=30), min_size=1, max_size=8), st.integers(1, 4))
def test_shingles_of_slices(texts, n):
    whole = pa.array(["pad é x"] + texts)
    sizes = [len(x) for x in J.shingle_sets(whole.slice(1), n)]
    assert sizes == [len(shingles(t, n)) for t in texts]


def spoilt(base, rnd, percent):
    """A set that is linked with ``base``, as far from it as may be."""
    other, fresh = set(base), rnd.getrandbits(64)
    while True:
        now = set(other)
        now.discard(rnd.choice(sorted(now & set(base)) or [0]))
        if rnd.random() < 0.5:
            now.add(fresh := rnd.getrandbits(64))
        if not now or not J.linked(len(now & set(base)), len(now), len(base), percent):
            return other
        other = now


@pytest.mark.parametrize("percent", [60, 80, 90])
@pytest.mark.parametrize("parts", [None, 2])
def test_linked_sets_share_a_key_of_equal_parts(monkeypatch, percent, parts):
    """Keys are the first of a list in any order that all share; with too few parts, single shingles are keys as well."""
    if parts:
        monkeypatch.setattr(J, "parts_of", lambda level, percent: (parts, 1))
    rnd = random.Random(percent)
    for size in [1, 2, 3, 5, 8, 9, 10, 11, 15, 16, 17, 30, 32, 33, 60, 64, 65, 100, 127, 128, 129, 250, 256, 257, 700, 1024, 1025]:
        base = {rnd.getrandbits(64) for _ in range(size)}
        other = spoilt(base, rnd, percent)
        if other == base:
            continue
        for seed in range(3):
            keys = []
            for x in (base, other):
                lists = J.key_lists(np.array(sorted(x), np.uint64), percent)
                assert all(1 <= keep <= len(k) for _, keep, k in lists)
                keys.append({(level, v) for level, keep, k in lists for v in sorted(k.tolist(), key=lambda v: hash((v, seed)))[:keep]})
            assert keys[0] & keys[1]


def test_shingles_that_many_texts_have_by_chance_make_no_pairs(frame):
    """Before, a tile was a single shingle: 240 texts over few words made thousands of pairs, as the square of their number."""
    rnd = random.Random(1)
    df = frame([(i, " ".join(f"w{rnd.randrange(20)}" for _ in range(200))) for i in range(240)]).selectExpr("doc_id AS rid", "text")
    home, _ = J.tile_keys(df, J.class_rows(df, 3).selectExpr("rid AS rep"), 3, 80)
    assert home.groupBy("key").count().selectExpr("coalesce(sum(count * (count - 1) / 2), 0) AS n").first().n <= 240


def test_sets_with_too_few_parts(frame, monkeypatch):
    monkeypatch.setattr(J, "parts_of", lambda level, percent: (3, 1))  # nearly all sets need single shingles
    rows = varied(11) + EDGE[:8]
    assert got(frame(rows), 3, 80) == brute(rows, 3, 80)


def test_near_copies_of_one_text_meet_its_most_typical_row(frame, monkeypatch):
    """Before, pivots were rows at random: most were too far from each other to be linked, and all pairs of the rest were made."""
    rnd, made, old = random.Random(3), [], J.candidates
    base = [f"t{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for j in range(2):
            w[rnd.randrange(200)] = f"v{i} {j}"
        rows.append((i, " ".join(w)))

    def counted(home, known, labels, turn, percent):
        out = old(home, known, labels, turn, percent)
        if turn == J.ROUNDS:
            made.append(out.count())
        return out

    monkeypatch.setattr(J, "candidates", counted)
    rnd.shuffle(rows)
    assert got(frame(rows), 3, 90) == brute(rows, 3, 90)
    assert made[0] <= 150


def test_a_pair_is_made_in_few_of_its_tiles(spark):
    """Before, each of the shared keys made it. Rows with the same keys, with some in common, and with one."""
    sets = {1: set(range(100)), 2: set(range(100)), 3: set(range(50, 150)), 4: {99, 300}, 5: {301}}
    mixed = spark.createDataFrame([(r, 100, k * 7919 % 1009, r, 0, 0, 0, 0) for r, x in sets.items() for k in x],
                                  "rid long, n long, key long, label long, s0 long, s1 long, s2 long, s3 long")
    pairs = [tuple(r) for r in J.tile_pairs(mixed, 90).collect()]
    assert set(pairs) == {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}
    assert pairs.count((1, 2)) == 1 and len(pairs) <= 20
