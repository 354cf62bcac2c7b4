"""Near-duplicate detection with min-max hashing.

Under each of 64 permutations both the smallest and the largest hash of a
document's shingles are kept: 128 signature values for 64 evaluations, each
pair of values an unbiased estimate of the Jaccard similarity with less
variance than two independent minima. 32 bands of four values (two minima, two
maxima) propose candidates: two documents at similarity 0.75 meet in some band
but for 5 in a million.

Documents with equal shingle sets are one class from the start. In each bucket
of a band the member with the most company is the hub; every class is compared
with its best hub on full sets, which is linear and merges most of any group.
Buckets chain classes into clusters. In a cluster that still holds several
components, the members outside the largest one are compared with all others,
block by block, by exact overlaps from an inverted index; only links that join
components come out. So no pairs are listed, and no link is lost because a hub
doesn't lie between two others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Workspace, ship
from .bounded import to_rows
from .components import connected_components
from .shingles import forget_words, shingle_set
from .worker import take_over

PERMUTATIONS, BANDS = 64, 32
#: A link: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Shingles and rows of one block; a larger cluster is compared block by block, in separate groups.
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 18, 256
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 2**31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, PERMUTATIONS, np.uint32)

FEATURES = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def signature(hashes: np.ndarray) -> np.ndarray:
    """(64, 2) uint32: minimum and maximum under each permutation of the folded hashes."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.empty((PERMUTATIONS, 2), np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 1024):
        h = np.multiply.outer(_A, x[at : at + 1024])
        h += _B[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    out[:, 0], out[:, 1] = low, high
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, which holds the band's number too."""
    v = sig.reshape(BANDS, -1).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(v.shape[1]):
            key = (key ^ v[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """Set size, a digest of the set and band keys; nulls where the set is empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("shingles", forget_words)
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(_bands(signature(s)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("shingles", forget_words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["rep", "shingles"])

    return docs.mapInArrow(run, "rep long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= SIMILARITY * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted index of a block: distinct shingles, where each one's owners begin, and the owners."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    known, start = np.unique(every[order], return_index=True)
    return known, np.append(start, len(every)), owner[order]


def _links_of_group(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links between components of one group: rows (side, rep, component, shingles), side 0 indexed, side 1 asked.

    A query's overlaps with the whole block are counted at once from the
    inverted index, so they are exact. A link is given only if it joins what
    wasn't joined yet: at most as many as there are components.
    """
    block = [r for r in rows if r[0] == 0]
    queries = [r for r in rows if r[0] == 1]
    if not block or not queries:
        return
    known, start, owner = _postings([r[3] for r in block])
    size = np.array([len(r[3]) for r in block])
    component = np.array([r[2] for r in block])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    for _, rep, mine, s in queries:
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        hit = at[known[at] == s]
        if not len(hit):
            continue
        length = start[hit + 1] - start[hit]
        where = np.repeat(start[hit] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(owner[where], minlength=len(block))
        linked = np.flatnonzero(100 * both >= SIMILARITY * (len(s) + size - both))
        _, first = np.unique(component[linked], return_index=True)
        for j in linked[first]:
            x, y = find(mine), find(int(component[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                yield rep, int(block[j][1])


def _links_in_groups(members: DataFrame) -> DataFrame:
    """(a, b) over rows (group, side, rep, component, shingles) that lie sorted by group and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("links")
        current, rows, out = None, [], []
        for batch in batches:
            lists = batch.column(4)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (group, side, rep, component) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if group != current:
                    out += _links_of_group(rows)
                    current, rows = group, []
                rows.append((side, rep, component, values[ends[i] : ends[i + 1]]))
        out += _links_of_group(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return members.select("group", "side", "rep", "component", "shingles").mapInArrow(run, "a long, b long")


def near_duplicates(ws: Workspace, docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, kept.

    Null or empty texts are linked with nothing: component_id is their own
    doc_id. Null doc_id: the row is linked with nothing and kept, component_id
    null. Rows with one doc_id are one document, which has the links of all its
    texts; they are marked alike. Empty table: no rows. Other columns take no
    part.
    """
    feats = ws.put("features", features(docs))
    linked = feats.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = ws.put("classes", linked.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))

    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = ws.put("crowd", banded.join(shared, "bucket"))
    company = crowd.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("company"))
    place = F.struct("company", (-F.col("rep")).alias("minus"))
    hubs = crowd.join(company, "rep").groupBy("bucket").agg(F.max(place).alias("top")).select("bucket", (-F.col("top.minus")).alias("hub"))
    votes = crowd.join(hubs, "bucket").where("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("bands"))
    best = ws.put("best", votes.groupBy("rep").agg(F.max_by("hub", F.struct("bands", -F.col("hub"))).alias("hub")).select(F.col("rep").alias("a"), F.col("hub").alias("b")))

    # Texts of one row of each class that has company; the class's smallest doc_id stands for it.
    asked_for = ws.put("asked-for", crowd.select("rep").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(to_rows(asked_for), "rep", "left_semi")
    sets = ws.put("sets", _sets(texts), codec="lz4")

    links = ws.put("links-1", _confirmed(best, sets))
    merged = connected_components(ws, links, "merged").withColumnRenamed("id", "rep")
    clusters = connected_components(ws, votes.select(F.col("rep").alias("a"), F.col("hub").alias("b")), "clusters").select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    weighed = sets.select("rep", F.size("shingles").cast("long").alias("weight"))
    named = ws.put("named", clusters.join(merged, "rep", "left").join(weighed, "rep").select("rep", "cluster", F.coalesce("component", "rep").alias("component"), "weight"))
    # A block is bounded in rows and in shingles, so a cluster of many short texts is split like one of long ones.
    parts = named.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    largest = F.max(F.struct("n", (-F.col("component")).alias("minus"), "weight")).alias("top")
    mixed = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"), F.sum("weight").alias("all"), largest).where("k > 1")
    blocks = lambda w, n: F.greatest(F.ceil(w / BLOCK_SHINGLES), F.ceil(n / BLOCK_ROWS)).cast("int")
    n_block, n_ask = blocks(F.col("all"), F.col("rows")), blocks(F.col("all") - F.col("top.weight"), F.col("rows") - F.col("top.n"))
    mixed = mixed.select("cluster", (-F.col("top.minus")).alias("main"), n_block.alias("n_block"), n_ask.alias("n_ask"))
    rest = named.join(mixed, "cluster")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    indexed = rest.select("rep", "cluster", "component", own(F.col("n_block")).alias("block"), spread(F.col("n_ask")).alias("ask"), F.lit(0).alias("side"))
    asked = rest.where("component <> main").select("rep", "cluster", "component", spread(F.col("n_block")).alias("block"), own(F.col("n_ask")).alias("ask"), F.lit(1).alias("side"))
    members = indexed.unionByName(asked).join(sets, "rep").select(F.xxhash64("cluster", "block", "ask").alias("group"), "side", "rep", "component", "shingles")
    dealt = members.repartition("group").sortWithinPartitions("group", "side")
    links = links.union(ws.put("links-2", _links_in_groups(dealt)))
    found = ws.put("components", connected_components(ws, links, "linked"))

    placed = classes.join(found, F.col("rep") == F.col("id"), "left").select("set_key", F.coalesce("component", "rep").alias("found"))
    ids = F.coalesce("found", "doc_id")
    rows = feats.withColumn("set_key", F.when(F.col("doc_id").isNotNull(), F.col("set_key"))).select("doc_id", "n_shingles", "set_key")
    # One set may belong to a third of all rows: placed has one row for it, and the other side is split at run time.
    return rows.join(placed, "set_key", "left").select("doc_id", "n_shingles", ids.alias("component_id"), F.col("doc_id").eqNullSafe(ids).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table."""
    return near_duplicates(Workspace(spark, "near-dedup"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id; the columns stay as they are.

    Rows without doc_id, and those whose text is null or has no word, stay.
    """
    ws = Workspace(spark, "near-dedup")
    gone = ws.put("gone", near_duplicates(ws, docs).where("NOT kept").select("doc_id").distinct())
    return docs.join(to_rows(gone), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


ORACLE_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) AS shingle FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS reached FROM w UNION SELECT e.y, r.reached FROM r JOIN e ON e.x = r.id),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
