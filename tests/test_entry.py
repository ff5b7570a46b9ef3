import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
SOME = ["p4_found", "F1_fuse_edges", "E10_service_names", "C13_evidence_spans", "H6_reconcile", "J10_sessions"]


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and all(f"p{n}_found" in q for n in (1, 2, 3, 4))
    assert all(callable(f) for f in q.values())


def test_import_needs_no_session_and_core_does_not_need_the_text_package():
    code = "import __spark_entry__ as e; assert e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    for path in (ROOT / "claimweave").rglob("*.py"):
        if "llm" not in path.parts:
            assert "claimweave.llm" not in path.read_text()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    df = entry.queries()[name](spark, DATA)
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, res.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_entry_query(spark):
    assert entry.entry(spark).count() > 0
