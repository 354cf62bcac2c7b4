"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word bucket has a sparse random index vector; the vector of a word is the
sum of the index vectors of the words around it in the training texts. A
document is the mean of its words' vectors. A network with one hidden layer,
trained in numpy, gives a logit, and a temperature fitted on rows kept out of
the training makes it a probability.

Training texts stay on the executors, which read them whole and piece by piece:
one pass sums contexts, whole numbers that don't depend on how rows are dealt
out, a second gives each row's mean vector. Only those reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Workspace, ship
from .worker import take_over


@dataclass(frozen=True)
class QualityConfig:
    """sample_rows: labelled rows that are learned from at most, whatever their length, those with the smallest hash of doc_id. Scoring has no bounds."""

    sample_rows: int = 3000
    buckets: int = 1 << 15
    dimension: int = 96
    nonzeros: int = 6
    around: int = 2
    hidden: int = 24
    epochs: int = 60
    seed: int = 11


#: Characters of a text whose words are looked at together.
PIECE = 1 << 15
_SPACE = re.compile(r"\s")
#: Letter runs, digit runs and runs of marks are words.
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Words(dict):
    """Bucket of a word; cleared when full, as texts may hold any number of words."""

    def __init__(self, buckets: int, most: int = 600_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > self.most:
            self.clear()
        b = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) % self.buckets
        return b

    def of(self, text: str | None) -> Iterator[np.ndarray]:
        """Buckets of a text's words, piece by piece, cut at white space, so that a very long text needs little more memory."""
        text, at = text or "", 0
        while at < len(text):
            space = _SPACE.search(text, at + PIECE)
            end = space.start() if space else len(text)
            found = _WORD.findall(text[at:end].lower())
            yield np.fromiter(map(self.__getitem__, found), np.int64, len(found))
            at = end


def index_vectors(c: QualityConfig) -> np.ndarray:
    """(buckets, dimension) int32: a few ones and minus ones a bucket."""
    rng = np.random.default_rng(c.seed)
    index = np.zeros((c.buckets, c.dimension), np.int32)
    at = rng.integers(0, c.dimension, (c.buckets, c.nonzeros))
    np.put_along_axis(index, at, rng.choice(np.array([-1, 1], np.int32), at.shape), 1)
    return index


def add_contexts(total: np.ndarray, index: np.ndarray, pieces: Iterator[np.ndarray], around: int) -> None:
    """Adds to each word's row the index vectors of its neighbours on either side, across the pieces of a text."""
    tail = np.zeros(0, np.int64)
    for piece in pieces:
        if not len(piece):
            continue
        d = np.concatenate([tail, piece])
        own, near = index[d], np.zeros((len(d), index.shape[1]), index.dtype)
        for k in range(1, around + 1):
            # Pairs within the tail were counted with the piece before.
            a = np.arange(max(k, len(tail)), len(d))
            near[a] += own[a - k]
            np.add.at(near, a - k, own[a])
        np.add.at(total, d, near)
        tail = d[-around:]


def unit_vectors(total: np.ndarray, index: np.ndarray) -> np.ndarray:
    """(buckets, dimension) float32 of length one; a word's own index vector tells it from others around the same words."""
    both = (total + index).astype(np.float32)
    return both / np.maximum(np.sqrt((both**2).sum(axis=1, keepdims=True)), 1e-9)


def pooled(vectors: np.ndarray, pieces: Iterator[np.ndarray]) -> np.ndarray:
    out, n = np.zeros(vectors.shape[1]), 0
    for words in pieces:
        out += vectors[words].sum(axis=0)
        n += len(words)
    return out / max(1, n)


@dataclass
class Model:
    """What scoring needs; about twelve megabytes at the default size, whatever the corpus."""

    config: QualityConfig
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pooled(self, pieces: Iterator[np.ndarray]) -> np.ndarray:
        """Mean vector of all words."""
        return pooled(self.vectors, pieces)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.mean) / self.scale
        logits = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -40, 40)))


def _constant(c: QualityConfig, p: float) -> Model:
    """Without both labels to learn from: the share of label 1, or one half."""
    d, p = c.dimension, min(max(p, 1e-6), 1 - 1e-6)
    zero = np.zeros
    return Model(c, zeros_like_vectors(c), zero(d), np.ones(d), zero((d, 1)), zero(1), zero(1), math.log(p / (1 - p)), 1.0)


def zeros_like_vectors(c: QualityConfig) -> np.ndarray:
    return np.zeros((c.buckets, c.dimension), np.float32)


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, c: QualityConfig) -> Model:
    """The network on mean vectors x and labels y: Adam on the cross-entropy; a fifth of the rows is kept out and sets the temperature."""
    rng = np.random.default_rng(c.seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    kept, used = order[:cut], order[cut:]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = {"w1": rng.normal(0, 1 / math.sqrt(z.shape[1]), (z.shape[1], c.hidden)), "b1": np.zeros(c.hidden), "w2": rng.normal(0, 1 / math.sqrt(c.hidden), c.hidden), "b2": np.zeros(1)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(c.epochs):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            h = np.tanh(z[part] @ p["w1"] + p["b1"])
            q = 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -40, 40)))
            d = (q - y[part]) / len(part)
            dh = np.outer(d, p["w2"]) * (1 - h**2)
            g = {"w1": z[part].T @ dh + 1e-3 * p["w1"], "b1": dh.sum(axis=0), "w2": h.T @ d + 1e-3 * p["w2"], "b2": np.array([d.sum()])}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    logits = np.tanh(z[kept] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]

    def loss(t: float) -> float:
        q = 1 / (1 + np.exp(-np.clip(logits / t, -40, 40)))
        return float(-(y[kept] * np.log(q + 1e-12) + (1 - y[kept]) * np.log(1 - q + 1e-12)).mean())

    temperature = min((2 ** (k / 4) for k in range(-8, 17)), key=loss)
    return Model(c, vectors, mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]), temperature)


def train(texts: list[str], labels: list[int], c: QualityConfig = QualityConfig()) -> Model:
    """The same from texts at hand."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return _constant(c, float(y.mean()) if len(y) else 0.5)
    words, index = Words(c.buckets), index_vectors(c)
    total = np.zeros_like(index)
    for t in texts:
        add_contexts(total, index, words.of(t), c.around)
    vectors = unit_vectors(total, index)
    return fit(np.array([pooled(vectors, words.of(t)) for t in texts]), y, vectors, c)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def learn(ws: Workspace, docs: DataFrame, labels: DataFrame, c: QualityConfig = QualityConfig()) -> Model:
    """From labelled rows that aren't held out: a bounded sample, in an order that doesn't depend on partitions."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality").withColumn("place", F.xxhash64(F.col("doc_id").cast("long")))
    chosen = known.orderBy("place", "quality").limit(c.sample_rows).select(F.col("doc_id").alias("_id"), "quality", "place")
    ids = chosen.collect()
    if not ids:
        return _constant(c, 0.5)
    if len({r.quality for r in ids}) < 2:
        return _constant(c, float(ids[0].quality))
    small = docs.sparkSession.createDataFrame(ids, chosen.schema)
    rows = ws.put("sample", docs.select("doc_id", "text").join(F.broadcast(small), F.col("doc_id") == F.col("_id")).select("place", "quality", "text"))
    index = index_vectors(c)
    total = np.zeros_like(index)
    for r in _contexts(rows, c).toLocalIterator():
        total[np.frombuffer(r.buckets, "<i4")] += np.frombuffer(r.sums, "<i4").reshape(-1, c.dimension)
    vectors = unit_vectors(total, index)
    found = sorted((r.place, r.quality, tuple(r.pooled)) for r in _means(rows, vectors, c).collect())
    if len({q for _, q, _ in found}) < 2:
        return _constant(c, float(found[0][1]) if found else 0.5)
    return fit(np.array([x for *_, x in found]), np.array([q for _, q, _ in found], float), vectors, c)


#: Tasks that sum contexts; each sends one table of sums, four bytes a number, to the driver.
CONTEXT_TASKS = 6


def _contexts(rows: DataFrame, c: QualityConfig) -> DataFrame:
    """(buckets, sums): of each task's texts, the buckets that occur and what lies around them."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality")
        words, index = Words(c.buckets), index_vectors(c)
        total = np.zeros_like(index)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                add_contexts(total, index, words.of(text), c.around)
        some = np.flatnonzero(total.any(axis=1)).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()], pa.binary()), pa.array([total[some].astype("<i4").tobytes()], pa.binary())], names=["buckets", "sums"])

    return rows.select("text").coalesce(CONTEXT_TASKS).mapInArrow(run, "buckets binary, sums binary")


def _means(rows: DataFrame, vectors: np.ndarray, c: QualityConfig) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality")
        words = Words(c.buckets)
        for batch in batches:
            means = [pooled(shared.value, words.of(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(means, pa.list_(pa.float64()))], names=["place", "quality", "pooled"])

    return rows.select("place", "quality", "text").mapInArrow(run, "place long, quality int, pooled array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of each row. No shuffle.

    Null and empty texts are scored as texts without words. Null doc_id and
    rows repeated with one doc_id: each row has its score. Empty table: no
    rows. Other columns take no part, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality")
        model = shared.value
        words = Words(model.config.buckets)
        for batch in batches:
            pooled = np.array([model.pooled(words.of(t)) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, model.config.dimension)
            p = model.probabilities(pooled) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table. Null doc_id: scored, not held out. Empty table: no rows. No labels: score one half."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(Workspace(spark, "quality"), docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
