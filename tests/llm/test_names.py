"""Other columns may have any names: those that stages use inside, dots and back-ticks."""

import pytest

import corpus_pipeline
from capforge.llm import common

SF = "/root/testdata/sf0.001"
NAMES = ["__key", "__salt", "__copy", "__rid", "__heavy", "a.b", "text.x", "back`tick", "rid", "hash", "size", "digest", "KEY", "label", "node"]


@pytest.mark.parametrize("limit", [None, 1])
def test_stages_keep_any_columns(spark, limit, monkeypatch):
    if limit:  # per-key tables beyond the limit are joined on salted keys
        monkeypatch.setattr(common.join_per_key, "__defaults__", (32, 0))
    docs = common.table(spark, SF, "documents")
    for i, name in enumerate(NAMES):
        docs = docs.withColumn(name, common.F.lit(i) if i % 2 else common.F.concat("source", common.F.lit(name)))
    columns = docs.columns
    assert columns[-len(NAMES):] == NAMES
    plain, fancy = common.table(spark, SF, "documents"), docs
    for name, stage in corpus_pipeline.STAGES:
        plain, fancy = (common.stored(stage(spark, d, SF), f"names-{name}") for d in (plain, fancy))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert fancy.columns == columns
        assert sorted(r.doc_id for r in plain.select("doc_id").collect()) == sorted(r.doc_id for r in fancy.select("doc_id").collect())
