"""The driver contract, and every registered query against its DuckDB oracle at sf0.001."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from capforge.plans.checks import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
ROWS_ONLY = {"train_classifier", "train_regressor", "save_load_model", "batch_predict",
             "predict_and_record", "oot_evaluation"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "Value_target_Max" in df.columns


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY


def _norm(df):
    def cell(v):
        if v is None:
            return None
        if hasattr(v, "item") and not isinstance(v, (str, bytes)):
            v = v.item()
        if isinstance(v, float):
            if math.isnan(v):
                return None
            return str(int(v)) if v.is_integer() else repr(round(v, 6))
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        try:
            if pd.isna(v):
                return None
        except (TypeError, ValueError):
            pass
        return str(v)
    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _norm(got) == _norm(want)


def test_queries_without_the_tokenizers(tmp_path):
    """Without a package that the training-data operators import, the other queries are there."""
    import subprocess
    import sys

    code = ("import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert len(q) > 90 and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q); print(len(q))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
