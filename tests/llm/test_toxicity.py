import random
import zlib

import pytest

from capforge.llm import toxicity as T

FILLER = "the quiet river runs past old stone houses and small green gardens where people talk about weather and bread".split()
BAD = ["idiot", "moron", "scum"]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd, docs, labels = random.Random(4), [], []
    for i in range(600):
        w, bad = [rnd.choice(FILLER) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randrange(5, 60))], i % 6 == 0
        if bad:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def model(corpus):
    return T.fit(*corpus)


@pytest.mark.parametrize("sign,word", [("1diot", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("sc|_|m", "scum"), ("m.o.r.o.n", "moron"),
                                       ("idiooooot", "idiot"), ("ídïot", "idiot"), ("moron!!!", "moron"), ("mor0n,", "moron")])
def test_words_are_restored(model, sign, word):
    assert T.restored(sign, model.costs)[-1] == word


def test_clean_words_stay(model):
    assert T.restored("Gardens,", model.costs) == ["gardens"]
    assert T.restored("2024", model.costs) == [] and T.restored("--", model.costs) == []
    assert T.decode("i d i o t", model.costs) == ["idiot"]


def test_held_out_rows_are_told_apart(corpus, model):
    docs, labels = corpus
    out = T.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len(held) > 50 and sum(r.predicted != r.toxic for r in held) <= 2
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_disguised_rows_score_high(model):
    score = model.scorer()
    for text in ("you m0r0n and 1di0t there", "what i d i o t wrote this, m o r o n", "a M.O.R.O.N and a scuuuum"):
        assert score(text) >= 0.5, text
    assert score("the river runs past gardens 2024 a b c d") < 0.5


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", T.F.when(T.held_out(T.F.col("doc_id")), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")).cast("int"))
    one, two = (sorted(tuple(r) for r in T.toxicity(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_edges(spark, corpus, frame):
    docs, labels = corpus
    rows = [(1, None), (2, ""), (None, "a moron"), (3, "x " * 50_000 + "idiot scum"), (3, "x " * 50_000 + "idiot scum"), (4, "퟿\U0001f600"), (5, "1" * 300)]
    out = T.toxicity(frame(rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert T.toxicity(frame(rows).limit(0), labels).count() == 0
    assert {r.predicted for r in T.toxicity(frame(rows), labels.limit(0)).collect()} == {0}
    kept = T.drop_toxic(frame(rows + [(i, "calm words") for i in range(10)]), labels.limit(0))
    assert kept.count() == len(rows) + 10 and kept.columns == frame(rows).columns


@pytest.mark.parametrize("toxic_of_ten", [4, 5, 8])
def test_balanced_and_mostly_toxic_labels(spark, toxic_of_ten):
    rnd, docs, labels = random.Random(toxic_of_ten), [], []
    for i in range(600):
        w, bad = [rnd.choice(FILLER) for _ in range(rnd.randrange(5, 30))], i % 10 < toxic_of_ten
        w += [rnd.choice(BAD)] * bad
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = T.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert sum(r.predicted != r.toxic for r in out) <= 6
    assert abs(T.drop_toxic(docs, labels).count() - 60 * (10 - toxic_of_ten)) <= 6


@pytest.mark.parametrize("sign,words", [("mоrоn", ["moron"]), ("ıdiot", ["idiot"]), ("mørøn", ["moron"]), ("$(|_|m", ["scum"]), ("1d10t", ["idiot"]),
                                        ("«идиот»!", ["идиот"]), ("ΗΛΊΘΙΟΣ", ["ηλίθιος"]), ("मूर्ख।", ["मूर्ख"]), ("白痴", ["白痴"]), ("你白痴", ["你白痴", "你白", "白痴"]),
                                        ("12.50", []), ("$5", []), ("2024-12-03", []), ("50%", [])])
def test_other_scripts_and_lookalikes(model, sign, words):
    got = T.restored(sign, model.costs)
    assert got == words or words and got[-1] == words[-1] and words[0].isascii()


@pytest.mark.parametrize("sign,kept", [("@$$", "as"), ("4$$", "as"), ("5#17", "sit")])
def test_tokens_of_signs_are_decoded(model, sign, kept):
    costs = T.trigram_costs(T.trigram_counts("as sit " * 1000, T.symbols()))
    assert [T.DOUBLE.sub(r"\1", w) for w in T.restored(sign, costs)] == [kept]


def test_toxic_words_of_other_scripts_are_learnt(spark):
    rnd, docs, labels = random.Random(5), [], []
    calm = "тихая река течет мимо старых домов и садов".split() + ["静かな", "川が", "流れる"]
    for i in range(600):
        w, bad = [rnd.choice(calm) for _ in range(rnd.randrange(5, 30))], i % 6 == 0
        w += [rnd.choice(["дурак", "Дурак!", "お前は馬鹿だ", "馬鹿野郎"])] * bad
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = T.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert sum(r.predicted != r.toxic for r in out) <= 6


@pytest.mark.parametrize("text", ["what i  d  i  o  t wrote", "what i\nd\ni\no\nt wrote", "what i\u00a0d\u00a0i\u00a0o\u00a0t wrote", "an id iot wrote",
                                  "the mo ron wrote", "an i di ot wrote", "an i d i ot wrote", "an idi\not, wrote", "an 1d 10t wrote", "a mor on wrote", "a sc\u00a0um wrote"])
def test_spacing_is_undone(model, text):
    assert model.scorer()(text) >= 0.5
    assert model.scorer()(" ".join(text.split()[:1] + ["river wrote"])) < 0.5


def test_runs_of_three(model):
    costs = T.trigram_costs(T.trigram_counts("ass the old idiot " * 1000, T.symbols()))
    find = T.Finder(costs)
    assert "as" in find.written("an a s s wrote") and "идиот" in find.written("и д и о т")
    only = T.Finder(costs, frozenset(["idiot"]))
    assert only("id iot") == ["idiot"] and only("id 2024 iot") == []


def test_decoder_equals_enumeration():
    """The best path of a lattice is the cheapest of all its paths."""
    import itertools

    rnd = random.Random(8)
    costs = T.trigram_costs(T.trigram_counts("the quiet idiot in the old house sat on a stone " * 50, T.symbols()))

    def cost(path):
        total, s = 0.0, [0, 0]
        for symbol, price in path:
            total += price
            if symbol > 0 or symbol == 0 and s[-1]:
                total += costs[s[-2] * 729 + s[-1] * 27 + symbol]
                s.append(symbol)
        return total + (costs[s[-2] * 729 + s[-1] * 27] if s[-1] else 0.0), "".join(chr(x + 96) if x else " " for x in s[2:]).split()

    for _ in range(150):
        signs = "".join(rnd.choice("id1o0t$s -.aa") for _ in range(rnd.randrange(1, 7)))
        best = min((cost(p) for p in itertools.product(*T.lattice(signs))), key=lambda x: x[0])
        got = T.decode(signs, costs)
        mine = min((cost(p)[0] for p in itertools.product(*T.lattice(signs)) if cost(p)[1] == got))
        assert mine == pytest.approx(best[0], abs=1e-9), signs


def test_spelled_words_equal_brute_force():
    """Every way to put neighbouring tokens together, with no bound on their number or length."""
    rnd = random.Random(9)
    text = "the quiet idiot in the old house sat on a stone extraordinary " * 50
    costs = T.trigram_costs(T.trigram_counts(text, T.symbols()))
    only = frozenset(["idiot", "extraordinary", "extr*", "stone", "ston*", "house"])
    find = T.Finder(costs, only)
    for _ in range(300):
        tokens = []
        for _ in range(rnd.randrange(1, 5)):
            word = rnd.choice(["idiot", "extraordinary", "stone", "house", "quiet", "old", "sat"])
            while word:
                k = rnd.choice([1, 2, 3, 4, len(word)])
                tokens.append(word[:k])
                word = word[k:]
        want = set(find.written(" ".join(tokens)))
        for i in range(len(tokens)):
            for j in range(i + 1, len(tokens)):
                joined = "".join(tokens[i:j + 1])
                begins = all(any(f.rstrip("*").startswith(T.DOUBLE.sub(r"\1", "".join(tokens[i:m]))) for f in only) for m in range(i + 1, j + 1))
                parts = tokens[i:j + 1]
                likelier = all(T.joining_cost([a[-2:], b[:2]], costs) < 0 for a, b in zip(parts, parts[1:]) if min(len(a), len(b)) > 1)
                price = T.joining_cost(parts, costs) if any(len(p) == 1 for p in parts) else -1
                begins = begins and likelier
                if begins and price < 0:
                    want |= {f for f in T.features(joined) if f in only}
        assert set(find(" ".join(tokens))) == want, tokens
