"""Every registered query at a small size against its SQL, and the pipeline against its stages by brute force."""

import hashlib

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
import test_entry as E
import test_mixing
import test_ngram_join

import corpus_pipeline
from capforge.llm import common, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in E.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and E._norm(got) == E._norm(want)


def test_ngram_query(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op1_ngram_jaccard"](spark, SF).collect()]
    assert sorted(got, key=repr) == test_ngram_join.brute(rows, 3, 90)


@pytest.mark.parametrize("name", ["op3_training_order", "op5_token_counts", "op6_piece_codec", "op8_toxicity"])
def test_other_queries_cover_the_table(spark, name):
    n = queries.QUERIES[name](spark, SF).count()
    assert n > 0 if name.startswith("op3") else n == common.table(spark, SF, "documents").count()


def test_pipeline_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(common.stored(stage(spark, seen[-1], SF), f"test-{name}"))
    assert all(x.columns == columns for x in seen[:5])
    texts = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    kept = {}
    for i, t in texts(seen[1]):
        key = "".join(t.split())
        kept[key] = min(kept.get(key, (1, 0)), (-len(t), i))
    assert sorted(i for i, _ in texts(seen[2])) == sorted(i for _, i in kept.values())
    groups = test_ngram_join.brute(texts(seen[2]), 5, 80)
    assert sorted(i for i, _ in texts(seen[3])) == sorted({c for _, _, c in groups})
    got, want = test_mixing.both(seen[3])
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and sum(r[4] for r in got) == sum(len(t.split()) for _, t in texts(seen[4]))
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    expected = sorted((i, hashlib.sha256(",".join(map(str, model.encode(t))).encode()).hexdigest()) for i, t in texts(seen[4]))
    assert sorted((r.doc_id, r.ids_sha256) for r in seen[5].collect()) == expected


def test_pipeline_on_an_empty_table(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


def test_pipeline_toxicity_stage(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    model = toxicity.fit(docs, common.table(spark, sf, "labels"))
    worst = [f for f in sorted(model.weight, key=model.weight.get, reverse=True) if "*" not in f][:4]
    planted = [(-1, " ".join(worst * 3)), (-2, "the river runs past old houses"), (-3, ""), (-4, None)]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    docs = common.stored(docs, "planted")
    score = toxicity.fit(docs, common.table(spark, sf, "labels")).scorer()
    want = sorted(r.doc_id for r in docs.collect() if score(r.text or "") < 0.5)
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, sf).collect())
    assert got == want and -1 not in got and {-2, -3, -4} <= set(got)
