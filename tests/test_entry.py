"""The registered queries: names, oracles, and a few of them against DuckDB at the smallest size."""

import os

import pytest

import __spark_entry__ as entry
from plumbline.plans import all_oracles, all_queries

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(all_oracles()) > 60 and set(all_oracles()) <= set(all_queries())


def test_only_the_corpus_subpackage_imports_itself():
    from pathlib import Path

    root = Path(entry.__file__).parent / "plumbline"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "plumbline.llm" not in path.read_text() and "from .llm" not in path.read_text()


def test_the_rest_works_without_the_corpus_subpackage(tmp_path):
    """As the driver does it: the subpackage and its tests go, the pipeline file stays or goes too."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q); assert 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "repo")}
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)
        (tmp_path / "repo/corpus_pipeline.py").unlink(missing_ok=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["rule_findings", "check_summary", "node_metrics", "confusion_grouping_sets", "flow_lattice"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    sql = con.execute(f"select {', '.join(columns)} from ({all_oracles()[name]})").fetchall()
    assert got == sorted(sql, key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
