"""Queries that SQL can say, against DuckDB."""

import os

import duckdb
import pytest

from citegrain.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        at = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    mine, theirs = queries.queries()[name](spark, sf), c.sql(queries.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    left = sorted(tuple(str(r[k]) for k in columns) for r in mine.collect())
    right = sorted(tuple(map(str, r)) for r in theirs.select(*map(duckdb.ColumnExpression, columns)).fetchall())
    assert left == right
