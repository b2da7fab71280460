import duckdb
import pytest

from capforge.llm import common, mixing, queries

ROWS = [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 3 else "hot") for i in range(400)] + [
    (900, None, "s1"), (901, "", None), (902, "a b c", None), (None, "x y", "s2"), (903, "k " * 5000, "s3"), (903, "k " * 5000, "s3"),
    (904, "", "void"), (905, None, "void"), (906, "tiny", "lone")]


def both(df):
    rows = df.select("doc_id", "text", "source").toPandas()
    con = duckdb.connect()
    con.register("documents", rows.astype({"doc_id": "Int64"}))
    want = con.execute(queries.ORACLE["op7_mix_sources"]).fetchall()
    got = [tuple(r) for r in mixing.mix_sources(df).select("doc_id", "size", "source_size", "target", "taken").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(got, key=key), sorted(want, key=key)


def test_matches_sql(frame):
    got, want = both(frame(ROWS))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_targets_are_met(frame):
    df = mixing.mix_sources(frame([r for r in ROWS if r[0] not in (903,)])).toPandas()
    assert (df.taken <= 3 * df["size"]).all()
    assert df.target.groupby(df.source_size).first().sum() == pytest.approx(df["size"].sum(), rel=0.3)
    for _, g in df.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 7


def test_salted_join_gives_the_same(frame, monkeypatch):
    df = frame(ROWS)
    want, _ = both(df)
    monkeypatch.setattr(common.join_per_key, "__defaults__", (4, 0))  # nothing is small enough to broadcast
    got, _ = both(df)
    assert got == want


def test_stage_repeats_rows(frame):
    df = frame(ROWS)
    plan = {r.doc_id: r.copies for r in mixing.mix_sources(df).collect() if r.doc_id not in (903,)}
    out = mixing.take_mix(df)
    assert out.columns == df.columns
    n = out.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert all(n.get(k, 0) == v for k, v in plan.items() if k is not None)


def test_empty_and_wordless(frame):
    assert mixing.mix_sources(frame(ROWS).limit(0)).count() == 0
    assert mixing.take_mix(frame(ROWS).limit(0)).count() == 0
    got = mixing.mix_sources(frame([(1, None, "a"), (2, " ", "b")])).collect()
    assert {(r.size, r.target, r.taken) for r in got} == {(0, 0.0, 0)}
