"""Every registered query against its SQL in another engine, and the driver's contract."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from ripple.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df, columns):
    return sorted(repr([None if x is None or x != x else x for x in r]) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, con, name):
    mine, theirs = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    assert rows(mine, columns) == rows(theirs, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_subpackage(tmp_path):
    """A copy without the training-data operators and their tests: the entry point answers, the rest is collected."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    tree = tmp_path / "tree"
    skipped = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.md", "*.json")
    for also in ((), ("corpus_pipeline.py",)):
        shutil.copytree(root, tree, ignore=lambda d, names: {*skipped(d, names), *also})
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) >= 85 and set(o) <= set(q) and 'pipeline' not in q; print('fine')"], cwd=tree, capture_output=True, text=True, timeout=120)
        assert said.stdout.strip() == "fine", said.stderr[-500:]
        said = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tree, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0 and "llm" not in said.stdout, said.stdout[-500:]
        shutil.rmtree(tree)
