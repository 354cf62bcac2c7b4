"""The pipeline against its stages in plain Python, and its registration."""

from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from citegrain.llm import language_id, mixing, queries, tokens
from test_text_operators import check_pieces, components, norm, plain_sizes


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in queries.queries()}
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_feed_each_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
        if name != "packing":
            assert docs.columns == columns
    language, exact, near, mixed, packed = seen
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(language) >= ids(exact) >= ids(near) == ids(mixed) == ids(packed)
    assert len(ids(exact)) == exact.count() and len(ids(near)) < len(ids(language))
    assert len(ids(language)) > 0.95 * spark.read.parquet(f"{sf}/documents.parquet").count()
    # Each emission of a document is packed once.
    whole = Counter(r.doc_id for r in packed.where("start = 0").collect())
    assert whole == Counter(r.doc_id for r in mixed.collect())


def brute_language(spark, docs):
    """Rows that are told with a margin of a byte and of a thousandth."""
    contents = [c for _, c in language_id.learn_dictionaries(docs)]
    kept = []
    for r in docs.collect():
        if any(map(str.isalpha, r.text or "")):
            first, second = sorted(plain_sizes(r.text, contents))[:2]
            if second - first >= max(1, 0.001 * first):
                kept.append(r.doc_id)
    return Counter(kept)


def brute_exact(spark, docs):
    first = {}
    for d, t in sorted((r.doc_id, norm(r.text)) for r in docs.collect()):
        first.setdefault(t, d)
    return Counter(first.values())


def brute_near(spark, docs):
    found, _ = components([(r.doc_id, r.text) for r in docs.collect()])
    return Counter(d for d, c in found.items() if d == c)


def brute_mixing(at):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    return Counter(d for (d,) in c.sql(f"SELECT doc_id FROM ({mixing.oracle_op6()})").fetchall())


def test_every_stage_against_brute_force(spark, sf, tmp_path):
    """Each stage's rows, from its own input, are those of plain Python or SQL."""
    at = str(tmp_path / "documents")
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(at)
    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    for name, stage in corpus_pipeline.STAGES:
        docs, last = spark.read.parquet(at), at
        at = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(at)
        out = [r.asDict() for r in spark.read.parquet(at).collect()]
        if name == "packing":
            lengths = check_pieces(out, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
            assert sum(lengths) == sum(r["length"] for r in out)
            continue
        brute = {"language_id": brute_language, "exact_dedup": brute_exact, "near_dedup": brute_near}.get(name)
        want = brute(spark, docs) if brute else brute_mixing(last)
        assert Counter(r["doc_id"] for r in out) == want, name


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, 0)], [(1, "", "en", "a", 0), (1, "", "en", "a", 0), (None, "word", None, None, 4)]])
def test_run_on_odd_tables(spark, tmp_path, rows):
    """Empty, null and repeated rows go through all stages."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
