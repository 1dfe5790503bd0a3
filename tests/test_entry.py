import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60
    if os.path.isdir(SMALL):
        assert entry.entry(spark).columns == ["repo", "path"]


def test_core_works_without_the_llm_package(tmp_path):
    code = (
        "import sys; sys.modules['fathom.llm'] = None\n"
        "import __spark_entry__ as e, fathom.api, fathom.streaming.indexer\n"
        "assert 'p3_found' in e.queries() and 'p1_found' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["p3_found", "index_incremental", "bm25", "knn_l2", "chunk_documents", "window_split", "eval_aggregate", "calibrate_best", "validate_errors", "ask_outcomes"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    rel = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols

    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    want = sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want
