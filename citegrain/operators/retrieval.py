"""Hybrid retrieval for a table of questions: mask, dense and lexical ranks, fusion, qualification, floor and cap.

Everything is set-based: a single question is a one-row table. The mask comes
before any ranking, while document frequencies and lengths are always those of
the whole index. Scores are rounded before they are ranked, ties go by
passage_id, and so results don't depend on how the work is split.

Tables: passages(passage_id, source_id, devices, text, vector), questions(qid,
text, vector, sources, scope, excluded). ``sources``: the selected source ids;
``scope``: device ids in scope; ``excluded``: a passage_id that never answers
this question, or null.

Both arms cut before anything is fused. Dense scores are products of blocks of
questions with blocks of passages, and a pair of blocks gives each question's
best rows and one row a source; lexical scores come from the postings of the
questions' terms. What is then fused, qualified and handed on are some hundred
rows a question, whatever the number of passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..runtime import Workspace, ship


#: Terms of up to so many questions are broadcast; of more, they are shuffled.
BROADCAST_QUESTIONS = 20_000
#: Passages and questions of a block.
PASSAGE_BLOCK, QUESTION_BLOCK = 8192, 512


@dataclass(frozen=True)
class RetrievalConfig:
    depth: int = 50
    rrf_k: int = 10
    dense_threshold: float = 0.30
    rare_share: float = 0.05
    base_cap: int = 8
    narrowing_cap: int = 12
    k1: float = 1.5
    b: float = 0.75
    digits: int = 9


@dataclass
class LexicalIndex:
    """postings(term, passage_id, tf), lengths(passage_id, dl), terms(term, df), stats(n, avgdl): one row."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame


def lexical_index(passages: DataFrame, text: Column | None = None) -> LexicalIndex:
    """Terms of every passage, compounds whole and in parts. Map-side sums keep the shuffle to distinct (passage, term)."""
    listed = passages.select("passage_id", T.terms(F.col("text") if text is None else text).alias("terms"))
    # An outer explode, as the optimizer would put a filter on the terms in front of a plain one, and compute them twice.
    postings = listed.select("passage_id", F.explode_outer("terms").alias("term")).where("term IS NOT NULL").groupBy("passage_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    lengths = listed.select("passage_id", F.size("terms").cast("long").alias("dl"))
    return LexicalIndex(
        postings,
        lengths,
        postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")),
        lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")),
    )


def write_lexical_index(index: LexicalIndex, path: str) -> None:
    """Postings are clustered by term, so that a query's terms prune most files' row groups."""
    index.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    index.terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_lexical_index(spark, path: str) -> LexicalIndex:
    return LexicalIndex(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "terms", "stats")])


def _few(questions: DataFrame) -> bool:
    return questions.limit(BROADCAST_QUESTIONS + 1).count() <= BROADCAST_QUESTIONS


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, term, times): a repeated term counts as often."""
    return questions.select("qid", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def in_device_scope(devices: Column, scope: Column) -> Column:
    """A passage that names no device passes; else one of its devices must be in scope. Never null."""
    named = F.coalesce(F.size(devices), F.lit(0)) > 0
    return ~named | F.coalesce(F.arrays_overlap(devices, scope), F.lit(False))


def device_scope(sources: DataFrame, selected: DataFrame, undocumented: DataFrame) -> DataFrame:
    """(qid, scope): devices of the selected manuals, or of all manuals if none is selected, and the undocumented ones.

    sources(source_id, kind, device), selected(qid, sources), undocumented(device_id).
    """
    manuals = sources.where("kind = 'vendor-manual'").select("source_id", "device")
    every = manuals.agg(F.array_sort(F.collect_set("device")).alias("every"))
    gaps = undocumented.agg(F.collect_set("device_id").alias("gaps"))
    mine = selected.select("qid", F.explode_outer("sources").alias("source_id")).join(manuals, "source_id", "left").groupBy("qid").agg(F.collect_set("device").alias("mine"))
    return mine.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(gaps)).select("qid", F.array_sort(F.array_union(F.when(F.size("mine") > 0, F.col("mine")).otherwise(F.col("every")), "gaps")).alias("scope"))


def dot(a: Column, b: Column, dimension: int | None = None, digits: int = 9) -> Column:
    """Inner product in double; with a known dimension as one generated expression, else a fold."""
    if dimension:
        terms = [F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double") for i in range(dimension)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
    else:
        total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.round(total, digits)


def normalised(v: Column) -> Column:
    """A vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def lexical_scores(index: LexicalIndex, questions: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(qid, passage_id, bm25, rare) of passages that share a term: Okapi scores over whole-index statistics.

    rare: the passage holds a question's term that is in at most rare_share of
    all passages. Only the questions' terms are read from the postings.
    """
    asked = question_terms(questions)
    # Semi-joins on the grouping key go below the index's own sums, so other terms are never counted.
    wanted = asked.select("term").distinct()
    if _few(questions):
        wanted = F.broadcast(wanted)
    postings, terms = (t.join(wanted, "term", "left_semi") for t in (index.postings, index.terms))
    known = asked.join(terms, "term").crossJoin(F.broadcast(index.stats))
    weighed = known.select("qid", "term", (F.col("times") * idf(F.col("n"), F.col("df"))).alias("weight"), (F.col("df") <= config.rare_share * F.col("n")).alias("rare"))
    # What a term adds to a passage is worked out once, before the questions multiply the postings.
    tf = F.col("tf") / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl")))
    impact = postings.join(index.lengths, "passage_id").crossJoin(F.broadcast(index.stats.select("avgdl"))).select("term", "passage_id", tf.alias("impact"))
    hits = impact.join(weighed, "term")
    return hits.groupBy("qid", "passage_id").agg(F.round(F.sum(F.col("weight") * F.col("impact")), config.digits).alias("bm25"), F.max("rare").alias("rare"))


def ranked(scores: DataFrame, score: str, name: str, depth: int, *more: str) -> DataFrame:
    """Rows up to a depth by falling score, ties by passage_id. A rank's limit also bounds what each task sends."""
    by = Window.partitionBy("qid", *more).orderBy(F.desc(score), "passage_id")
    return scores.withColumn(name, F.row_number().over(by)).where(F.col(name) <= depth)


def rrf(rankings: list[DataFrame], config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(qid, passage_id, fused): reciprocal ranks summed over rankings (qid, passage_id, rank)."""
    union = rankings[0].select("qid", "passage_id", "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select("qid", "passage_id", "rank"))
    return union.groupBy("qid", "passage_id").agg(F.round(F.sum(1.0 / (config.rrf_k + F.col("rank"))), config.digits).alias("fused"))


def fuse(rankings: list[DataFrame], config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(F.desc("fused"), "passage_id")
    return rrf(rankings, config).withColumn("fused_rank", F.row_number().over(by))


def _by_dimension(vectors: pa.Array) -> dict[int, np.ndarray]:
    """Rows by the length of their vector; rows without one are in none."""
    size = np.array([-1 if n is None else n for n in pc.list_value_length(vectors).to_pylist()])
    return {int(d): np.flatnonzero(size == d) for d in np.unique(size) if d >= 0}


def _matrix(vectors: pa.Array, rows: np.ndarray, dimension: int) -> np.ndarray:
    return np.asarray(vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), "<f8").reshape(len(rows), dimension)


_PASSAGES = "dimension int, passage_ids array<string>, source_ids array<string>, devices array<array<string>>, vectors binary"


def _blocks(size: int, columns: tuple[str, ...]):
    """Packs a partition's rows (columns..., vector) into blocks of at most so many rows of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def close(d: int) -> pa.RecordBatch:
            parts = held.pop(d)
            lists = [pa.concat_arrays([p[i] for p in parts]) for i in range(len(columns))]
            listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            packed = np.concatenate([p[-1] for p in parts]).astype("<f8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *listed, pa.array([packed], pa.binary())], names=["dimension", *columns, "vectors"])

        for batch in batches:
            vectors = batch.column(len(columns))
            for d, rows in _by_dimension(vectors).items():
                for at in range(0, len(rows), size):
                    some = rows[at : at + size]
                    held.setdefault(d, []).append((*(batch.column(i).take(pa.array(some)) for i in range(len(columns))), _matrix(vectors, some, d)))
                    if sum(len(p[-1]) for p in held[d]) >= size:
                        yield close(d)
        for d in list(held):
            yield close(d)

    return run


def _score(depth: int, threshold: float, digits: int, schema: pa.Schema):
    """Rows of a block of passages with a block of questions: each question's best, and of each source its best and how many are near."""

    def allowed(wanted: list, present: list) -> np.ndarray:
        return np.array([[p in w for p in present] for w in wanted], bool).reshape(len(wanted), len(present))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[row]
                d = get("dimension").as_py()
                if d != get("query_dimension").as_py():
                    continue
                ids, qids = np.array(get("passage_ids").as_py(), object), get("qids").values
                p = np.frombuffer(get("vectors").as_buffer(), "<f8").reshape(len(ids), d)
                q = np.frombuffer(get("query_vectors").as_buffer(), "<f8").reshape(len(qids), d)
                order = np.argsort(ids)  # equal scores go by passage_id
                ids, p = ids[order], p[order]
                names, source = np.unique(np.array(get("source_ids").as_py(), object)[order], return_inverse=True)
                devices = [tuple(x or ()) for x in get("devices").as_py()]
                kinds = {k: n for n, k in enumerate(dict.fromkeys(devices))}
                kind = np.array([kinds[x] for x in devices])[order]
                scopes = [set(x or ()) for x in get("scopes").as_py()]
                in_scope = np.array([[not k or not sc.isdisjoint(k) for k in kinds] for sc in scopes], bool).reshape(len(scopes), len(kinds))
                ok = allowed([set(x or ()) for x in get("sources").as_py()], list(names))[:, source] & in_scope[:, kind]
                for n, own in enumerate(get("excluded").as_py()):
                    if own is not None:
                        ok[n] &= ids != own
                scores = np.where(ok, np.round(q @ p.T, digits), -np.inf)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :depth]
                at, nth = np.nonzero(np.isfinite(np.take_along_axis(scores, best, 1)))
                rows = [(at, best[at, nth], np.zeros(len(at), np.int64), np.ones(len(at), bool))]
                for n in range(len(names)):
                    mine = np.flatnonzero(source == n)
                    top = mine[scores[:, mine].argmax(axis=1)]
                    who = np.flatnonzero(np.isfinite(scores[np.arange(len(q)), top]))
                    rows.append((who, top[who], (scores[who][:, mine] >= threshold).sum(axis=1), np.zeros(len(who), bool)))
                at, which, near, in_top = (np.concatenate(c) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(at)), pa.array(ids[which].tolist(), pa.string()), pa.array(names[source[which]].tolist(), pa.string()), pa.array(scores[at, which]), pa.array(near.astype(np.int64)), pa.array(in_top)], schema=schema)

    return run


def dense_rows(passages: DataFrame, questions: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(qid, passage_id, source_id, cosine, near, in_top) out of each pair of blocks.

    in_top: among the block's best for the question, to the depth. Else a
    source's best row of the block, and near: how many of the source's rows
    reach the threshold. Vectors of other dimensions aren't compared.
    """
    spark = passages.sparkSession
    ship(spark)
    kind = dict(questions.dtypes)["qid"]
    held = passages.where("vector IS NOT NULL").select("passage_id", "source_id", "devices", "vector").mapInArrow(_blocks(PASSAGE_BLOCK, ("passage_ids", "source_ids", "devices")), _PASSAGES)
    shape = f"dimension int, qids array<{kind}>, sources array<array<string>>, scopes array<array<string>>, excluded array<string>, query_vectors binary"
    asked = questions.where("vector IS NOT NULL").select("qid", "sources", F.col("scope").alias("scopes"), "excluded", "vector").coalesce(8)
    asked = asked.mapInArrow(_blocks(QUESTION_BLOCK, ("qids", "sources", "scopes", "excluded")), shape.replace("query_vectors", "vectors")).withColumnRenamed("vectors", "query_vectors")
    # The stated questions meet every passage, block with block; few enough blocks of questions are sent round, more are not.
    asked = asked.withColumnRenamed("dimension", "query_dimension")
    pairs = held.crossJoin(F.broadcast(asked) if _few(questions) else asked)
    out = f"qid {kind}, passage_id string, source_id string, cosine double, near long, in_top boolean"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], out).schema)
    return pairs.mapInArrow(_score(config.depth, config.dense_threshold, config.digits, schema), out)


@dataclass
class Arms:
    """dense(qid, passage_id, source_id, cosine, rank), lexical(qid, passage_id, source_id, bm25, rare, rank): each arm's best; near(qid, source_id, passage_id, cosine, near): of each source its nearest passage, and how many are near; first: of each source its first by BM25; hits: every lexical score."""

    dense: DataFrame
    lexical: DataFrame
    near: DataFrame
    first: DataFrame
    hits: DataFrame


def in_mask(rows: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows (qid, passage_id) that may answer their question, with source_id."""
    known = rows.join(passages.select("passage_id", "source_id", "devices"), "passage_id").join(questions.select("qid", "sources", "scope", "excluded"), "qid")
    ok = F.array_contains("sources", F.col("source_id")) & in_device_scope(F.col("devices"), F.col("scope")) & ~F.col("passage_id").eqNullSafe(F.col("excluded"))
    return known.where(ok).drop("devices", "sources", "scope", "excluded")


def _lexical_arm(hits: DataFrame, config: RetrievalConfig) -> tuple[DataFrame, DataFrame]:
    ahead = F.struct((-F.col("bm25")).alias("s"), F.col("passage_id").alias("p"))
    first = hits.groupBy("qid", "source_id").agg(F.min_by(F.struct("passage_id", "bm25", "rare"), ahead).alias("b")).select("qid", "source_id", "b.passage_id", "b.bm25", "b.rare")
    return ranked(hits, "bm25", "rank", config.depth), first


def _nearest(rows: DataFrame) -> DataFrame:
    better = F.struct((-F.col("cosine")).alias("c"), F.col("passage_id").alias("p"))
    return rows.groupBy("qid", "source_id").agg(F.min_by(F.struct("passage_id", "cosine"), better).alias("b"), F.sum("near").alias("near")).select("qid", "source_id", "b.passage_id", "b.cosine", "near")


def arms(passages: DataFrame, questions: DataFrame, index: LexicalIndex, config: RetrievalConfig = RetrievalConfig()) -> Arms:
    """Both arms, as work tables: each is asked for its best, its best of each source, and single scores, and is made once."""
    ws = Workspace(passages.sparkSession, "retrieve")
    rows = ws.put("dense", dense_rows(passages, questions, config), codec="lz4")
    dense = ranked(rows.where("in_top").select("qid", "passage_id", "source_id", "cosine"), "cosine", "rank", config.depth)
    hits = ws.put("hits", in_mask(lexical_scores(index, questions, config).where("bm25 > 0"), passages, questions), codec="lz4")
    lexical, first = _lexical_arm(hits, config)
    return Arms(ws.put("dense-best", dense), ws.put("lexical-best", lexical), ws.put("near", _nearest(rows.where("NOT in_top"))), ws.put("first", first), hits)


def arms_of(scored: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> Arms:
    """The same from rows that are scored already and may all answer: (qid, passage_id, source_id, cosine, bm25, rare)."""
    known = scored.where("cosine IS NOT NULL").select("qid", "passage_id", "source_id", "cosine", (F.col("cosine") >= config.dense_threshold).cast("long").alias("near"))
    hits = scored.where("bm25 > 0").select("qid", "passage_id", "source_id", "bm25", "rare")
    lexical, first = _lexical_arm(hits, config)
    return Arms(ranked(known.drop("near"), "cosine", "rank", config.depth), lexical, _nearest(known), first, hits)


def pool(a: Arms, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(qid, passage_id, source_id, dense_rank, lexical_rank, fused, fused_rank): both rankings fused, a rank null beyond its depth."""
    fused = fuse([a.dense, a.lexical], config)
    dense = a.dense.select("qid", "passage_id", F.col("source_id").alias("ds"), F.col("rank").alias("dense_rank"))
    lexical = a.lexical.select("qid", "passage_id", F.col("source_id").alias("ls"), F.col("rank").alias("lexical_rank"))
    key = ["qid", "passage_id"]
    return fused.join(dense, key, "left").join(lexical, key, "left").withColumn("source_id", F.coalesce("ds", "ls")).drop("ds", "ls")


Scorer = Callable[[DataFrame], DataFrame]


def scorer(passages: DataFrame, questions: DataFrame, a: Arms, config: RetrievalConfig = RetrievalConfig(), dimension: int | None = None) -> Scorer:
    """Adds cosine and bm25 to rows (qid, passage_id): what only one arm has scored, the other scores now; some hundred rows a question."""

    def score(rows: DataFrame) -> DataFrame:
        rows = rows.join(passages.select("passage_id", "vector"), "passage_id", "left").join(questions.select("qid", F.col("vector").alias("_q")), "qid", "left")
        rows = rows.withColumn("cosine", dot(F.col("vector"), F.col("_q"), dimension, config.digits)).drop("vector", "_q")
        return rows.join(a.hits.select("qid", "passage_id", "bm25"), ["qid", "passage_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))

    return score


def finalists(a: Arms, score: Scorer, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(qid, passage_id, source_id, fused, fused_rank, cosine, bm25, qualifying): the fused pool, and of each source the row that may qualify it.

    A row qualifies if it is near enough to the question, or first by BM25 in
    its own source and holding a rare term.
    """
    key = ["qid", "passage_id"]
    pooled = pool(a, config).select(*key, "source_id", "fused", "fused_rank")
    others = a.near.where(F.col("near") > 0).select(*key, "source_id").union(a.first.where("rare").select(*key, "source_id")).distinct()
    rows = score(pooled.unionByName(others.join(pooled.select(*key), key, "left_anti"), allowMissingColumns=True))
    rows = rows.join(a.first.where("rare").select(*key, F.lit(True).alias("_lead")), key, "left")
    return rows.withColumn("qualifying", F.coalesce(F.col("cosine") >= config.dense_threshold, F.lit(False)) | F.coalesce("_lead", F.lit(False))).drop("_lead")


def qualifying_sources(passages: DataFrame, questions: DataFrame, a: Arms, config: RetrievalConfig = RetrievalConfig(), dimension: int | None = None) -> DataFrame:
    """(qid, source_id, n_qualifying, best_cosine) of each source that qualifies for a question."""
    near = a.near.where("near > 0").select("qid", "source_id", "near", F.col("cosine").alias("best"))
    lead = a.first.where("rare").join(passages.select("passage_id", "vector"), "passage_id").join(questions.select("qid", F.col("vector").alias("_q")), "qid", "left")
    lead = lead.select("qid", "source_id", dot(F.col("vector"), F.col("_q"), dimension, config.digits).alias("own"), F.lit(True).alias("lead"))
    both = near.join(lead, ["qid", "source_id"], "full_outer")
    more = F.col("lead").isNotNull() & ~F.coalesce(F.col("own") >= config.dense_threshold, F.lit(False))
    return both.select("qid", "source_id", (F.coalesce("near", F.lit(0)) + more.cast("long")).alias("n_qualifying"), F.coalesce("best", "own").alias("best_cosine"))


def supply(qualified: DataFrame, config: RetrievalConfig = RetrievalConfig(), narrowing: bool = False) -> DataFrame:
    """The passages handed on, in order: (qid, position, passage_id, source_id, cosine, bm25, fused, qualifying).

    Each qualifying source has a place: its first fused passage, or if it
    reached neither depth its nearest qualifying one, at the end. What is left
    of the cap goes by fused rank. A question for which nothing qualifies has
    no rows.
    """
    q, by_source = Window.partitionBy("qid"), Window.partitionBy("qid", "source_id")
    rows = qualified.withColumn("source_ok", F.max(F.col("qualifying").cast("int")).over(by_source) == 1)
    rows = rows.withColumn("fused_in_source", F.max(F.col("fused").isNotNull().cast("int")).over(by_source) == 1)
    nearest = F.row_number().over(by_source.orderBy(F.desc(F.col("qualifying").cast("int")), F.desc("cosine"), "passage_id")) == 1
    first = F.row_number().over(by_source.orderBy(F.col("fused_rank").asc_nulls_last(), "passage_id")) == 1
    rows = rows.withColumns({"floor": F.col("source_ok") & F.col("fused").isNotNull() & first, "extra": F.col("source_ok") & ~F.col("fused_in_source") & F.col("qualifying") & nearest})
    count = lambda c: F.sum(c.cast("int")).over(q)
    rows = rows.withColumns({"n_floor": count(F.col("floor")), "n_extra": count(F.col("extra"))})
    cap = F.greatest(F.lit(config.base_cap), F.col("n_floor") + F.col("n_extra"), F.lit(config.narrowing_cap if narrowing else 0))
    filler = F.col("fused").isNotNull() & ~F.col("floor")
    nth = F.sum(filler.cast("int")).over(q.orderBy(F.col("fused_rank").asc_nulls_last(), "passage_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("filled", filler & (nth <= cap - F.col("n_floor") - F.col("n_extra")))
    rows = rows.where((F.col("n_floor") + F.col("n_extra") > 0) & (F.col("floor") | F.col("extra") | F.col("filled")))
    order = q.orderBy(F.col("extra").cast("int"), F.when(~F.col("extra"), F.col("fused_rank")), "source_id")
    return rows.withColumn("position", F.row_number().over(order)).select("qid", "position", "passage_id", "source_id", "cosine", "bm25", F.coalesce("fused", F.lit(0.0)).alias("fused"), "qualifying")


def retrieve(passages: DataFrame, questions: DataFrame, index: LexicalIndex, config: RetrievalConfig = RetrievalConfig(), narrowing: bool = False, dimension: int | None = None) -> DataFrame:
    """What ``supply`` hands on for each question. dimension, if all vectors have it, only makes scoring quicker."""
    a = arms(passages, questions, index, config)
    return supply(finalists(a, scorer(passages, questions, a, config, dimension), config), config, narrowing)


def lexical_search(index: LexicalIndex, questions: DataFrame, limit: int, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(qid, passage_id, bm25, rank): the index alone, unmasked, positive scores only."""
    return ranked(lexical_scores(index, questions, config).where("bm25 > 0"), "bm25", "rank", limit).select("qid", "passage_id", "bm25", "rank")
