"""Driver contract: entry runs on sf0.001; every oracle key is a query; column names match."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF01

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "ratio_request_messages" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["thread_features", "roc_auc", "stratified_split", "threshold_sweep", "best_split_gini"])
def test_oracle_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    df = E.queries()[name](spark, SF01)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    key = sorted(df.columns)

    def norm(rows, cols):
        idx = [cols.index(k) for k in key]
        return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in idx) for r in rows), key=repr)

    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(res.fetchall(), ocols)


def test_a_missing_library_leaves_only_its_queries_out():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as E; q = E.queries(); assert 'thread_features' in q and not any(n.startswith('op') for n in q); assert set(E.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.abspath(E.__file__)))
    assert done.returncode == 0, done.stderr
