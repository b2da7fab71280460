import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from capforge.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, `a.b` int"


def brute(rows, min_docs=3, top=200):
    docs = [(t or "", l or "", s or "") for t, l, s in rows]
    out = []
    for lang in {l for _, l, _ in docs}:
        counts, in_docs = defaultdict(Counter), Counter()
        for text, l, source in docs:
            if l == lang:
                words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
                counts[source].update(words)
                in_docs.update(set(words))
        kept = [w for w, n in in_docs.items() if n >= min_docs]
        v, whole = len(kept), sum(counts.values(), Counter())

        def share(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10 ** 9 * (c[w] + 1) // (total + v) for w in kept}

        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pair = [(-sum(f(p[s][w], p[o][w]) for w in kept), o) for o in p if o != s]
            term = [(-f(p[s][w], q[w]), w) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def made(spark, rows, **options):
    df = spark.createDataFrame([(i % 5, *r, 1, "x", 2) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in D.divergence_audit(df, **options).collect())


def sample(seed, n=160, sources=9):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Été", "oak", "ßx", "RIVER", "stone") for b in "abcdefghij"]
    rows = []
    for _ in range(n):
        s = f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        text = " ".join(rng.choice(words[:10 + 7 * rng.randrange(6)]) + rng.choice(["", ".", "9", "\n"]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice([None, "", text, text, text]), rng.choice(["en", "fr", None, ""]), rng.choice([s, s, s, None])))
    return rows


@pytest.mark.parametrize("options", [{}, {"source_block": 2, "term_block": 5}, {"top": 3, "term_block": 4}])
def test_equals_the_definition(spark, options):
    rows = sample(len(options))
    got = made(spark, rows, **options)
    assert got == brute(rows, top=options.get("top", 200)) and {r[2] for r in got} == {"pair", "term"}


def test_small_tables(spark):
    assert made(spark, []) == []
    assert made(spark, [("lone words", "en", "a"), (None, "en", "b"), ("", "fr", None)]) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    rows = [("same text here", "en", s) for s in "aabbcc"] + [("x " * 100000, "en", "a")] * 3
    assert made(spark, rows) == brute(rows)


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(2000):
        total = rng.randrange(1, 10 ** rng.randrange(1, 15))
        count = rng.randrange(total)
        assert int(D.shares(np.array([count]), total)[0]) == 1 + 10 ** 9 * (count + 1) // total
