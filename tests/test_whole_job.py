"""Queries do the whole job: all documents, all words, all rows, on tables where a cut would show."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from citegrain.plans import answer_queries, catalogue, tables
from test_catalogue import TABLES, plain


def same(spark, sf, name):
    """The query's rows are those of its SQL."""
    sql = catalogue.ORACLES[name]
    c = duckdb.connect()
    for t in TABLES:
        at = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    mine, theirs = catalogue.QUERIES[name](spark, sf), c.sql(sql)
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    left = sorted(tuple(str(plain(r[k])) for k in columns) for r in mine.collect())
    right = sorted(tuple(str(plain(v)) for v in r) for r in theirs.select(*map(duckdb.ColumnExpression, columns)).fetchall())
    assert left == right
    return left


# Answers -----------------------------------------------------------------------

def test_answers_hold_the_whole_text(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    made = {r.turn_id: r.stream for r in answer_queries._transcripts(spark, sf).collect()}
    bare = lambda x: re.sub(r"\s", "", x)
    assert made.keys() == docs.keys()
    for k, text in docs.items():
        lines = re.sub(r" \[\[p:m\d\]\]", "", made[k]).split("\n")
        kept = [lines[1], lines[3][3:], lines[4][3:], lines[5][2:], lines[6][8:], lines[9][11:], lines[10][1:]]
        assert bare("".join(kept)) == bare(text)
    blocks = answer_queries.framing_blocks(spark, sf)
    assert {r.turn_id % 2 for r in blocks.select("turn_id").distinct().collect()} == {0, 1}
    assert {r.turn_id for r in blocks.collect()} == set(docs)


# Retrieval ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def few_vectors(spark, sf, tmp_path_factory):
    """The tables with a vector for every third document alone."""
    at = tmp_path_factory.mktemp("few")
    for t in TABLES:
        if t != "embeddings":
            os.symlink(f"{sf}/{t}.parquet", at / f"{t}.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 3 = 0").write.parquet(str(at / "embeddings.parquet"))
    return str(at)


def test_index_of_every_document(spark, few_vectors):
    n = spark.read.parquet(f"{few_vectors}/documents.parquet").count()
    assert same(spark, few_vectors, "index_stats")[0][1] == str(n)
    assert len(same(spark, few_vectors, "retrieval_scope_filter")) == n
    assert same(spark, few_vectors, "device_scope")


def test_vectors_are_asked_of_the_dense_arm_alone(spark, few_vectors):
    for name in ("cosine_topk", "masked_vs_unmasked", "entry_expansion"):
        assert same(spark, few_vectors, name)
    found = catalogue.QUERIES["bm25_topk"](spark, few_vectors).collect()
    assert any(int(r.passage_id[-6:]) % 3 for r in found)
    assert {r.qid for r in found} == {r.item_id for r in spark.read.parquet(f"{few_vectors}/benchmark.parquet").collect()}


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fusion", "qualifying_sources", "hybrid_retrieve"])
def test_retrieval_of_every_document(spark, few_vectors, name):
    assert same(spark, few_vectors, name)


def test_questions_are_whole(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {r.qid: r.text for r in tables.questions(spark, sf).collect()} == items
    assert max(len(t.split()) for t in items.values()) > 12


# Inventory ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def many_suppliers(spark, sf, tmp_path_factory):
    """The tables with suppliers of the first twenty nations alone, three times over."""
    at = tmp_path_factory.mktemp("many")
    for t in TABLES:
        if t != "supplier":
            os.symlink(f"{sf}/{t}.parquet", at / f"{t}.parquet")
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    n, top = s.count(), s.selectExpr("max(s_suppkey)").first()[0]
    more = s.crossJoin(spark.range(3)).withColumn("s_suppkey", F.expr(f"s_suppkey + {top} * id").cast(s.schema["s_suppkey"].dataType))
    more = more.withColumn("s_name", F.format_string("Supplier#%09d", F.col("s_suppkey").cast("long"))).withColumn("s_nationkey", F.expr("s_suppkey % 20").cast(s.schema["s_nationkey"].dataType))
    more.drop("id").write.parquet(str(at / "supplier.parquet"))
    assert n * 3 > 20
    return str(at)


@pytest.mark.parametrize("name", ["gap_undocumented", "gap_unconfirmed", "gap_not_owned", "applied_declarations", "inventory_table"])
def test_every_supplier(spark, many_suppliers, name):
    got = same(spark, many_suppliers, name)
    assert got
    if name == "inventory_table":
        assert len(got) == spark.read.parquet(f"{many_suppliers}/supplier.parquet").count()


def test_ledger_of_every_order(spark, sf):
    assert len(same(spark, sf, "ledger_update")) > 50


# Keys --------------------------------------------------------------------------


def test_text_keys_differ_after_the_first_line(spark, tmp_path):
    texts = ["Same\nalpha 1", "Same\nbeta 1", "Same\nalpha  2"]
    spark.createDataFrame([(9 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    a, b, c = sorted(catalogue.QUERIES["text_keys"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert a.symptom != b.symptom and a.title != b.title and a.furniture != b.furniture
    assert a.symptom != c.symptom and a.title != c.title and a.furniture == c.furniture
