"""Every query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from citegrain.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return tuple(plain(x) for x in value)
    return value


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        at = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, duck, name):
    mine = catalogue.QUERIES[name](spark, sf)
    theirs = duck.sql(catalogue.ORACLES[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    left = sorted(tuple(str(plain(r[c])) for c in columns) for r in mine.collect())
    right = sorted(tuple(str(plain(v)) for v in r) for r in theirs.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_sql_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_data_operators():
    """The library and the other queries stand on their own."""
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("citegrain.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert not any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in e.queries())
assert len(e.queries()) > 60
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
