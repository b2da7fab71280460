import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from capforge.llm import exact_dedup as D

ROWS = [(1, "a b"), (2, "ab"), (3, "a  b "), (3, "a  b "), (4, None), (5, ""), (6, " \t"), (None, "q"), (7, "q"), (8, "é x"),
        (9, "éx"), (10, "z" * 200_000), (11, "z" * 200_000), (12, "ab\x0b"), (13, "only")]


def brute(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for k, g in groups.items():
        for n, x in enumerate(sorted(g)):
            out.append((x[3], min(g)[3], len(g), n == 0, hashlib.sha256(k.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_matches_definition(frame, monkeypatch):
    df = frame(ROWS)
    assert got(D.exact_dedup(df)) == brute(ROWS)
    monkeypatch.setattr(D, "LEAST_HEAVY", 2)  # every repeated digest takes the broadcast way
    assert got(D.exact_dedup(df, slots=20)) == brute(ROWS)


def test_skewed_group(frame, monkeypatch):
    monkeypatch.setattr(D, "LEAST_HEAVY", 8)
    rows = [(i, " ".join("hot") + " " * (i % 5)) for i in range(300)] + [(1000 + i, f"t{i % 200}") for i in range(600)]
    assert got(D.exact_dedup(frame(rows), slots=10)) == brute(rows)


def test_stage_keeps_columns_and_one_of_each(frame):
    df = frame(ROWS)
    kept = D.keep_first_copies(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k, n in brute(ROWS).items() if k[3])


def test_stage_with_frequent_and_repeated_winners(frame, monkeypatch):
    monkeypatch.setattr(D, "LEAST_HEAVY", 8)
    rows = [(i % 40, "h o t" + " " * (i % 5)) for i in range(300)] + [(7, "same row")] * 60 + [(None, "n")] * 20 + [(i, f"t{i % 50}") for i in range(200)]
    kept = [r.doc_id for r in D.keep_first_copies(frame(rows), slots=10).collect()]
    assert Counter(kept) == Counter(k[0] for k, n in brute(rows).items() for _ in range(n) if k[3])


def test_empty(frame):
    df = frame(ROWS).limit(0)
    assert D.exact_dedup(df).count() == 0 and D.keep_first_copies(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=200), st.integers(1, 6))
def test_misra_gries_bound(items, slots):
    counts = Counter()
    for i in range(0, len(items), 17):
        counts.update(items[i:i + 17])
        counts = D.shrink(counts, slots)
    true = Counter(items)
    assert len(counts) <= slots
    assert all(true[k] - len(items) / (slots + 1) <= counts[k] <= true[k] for k in true)
