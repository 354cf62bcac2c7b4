"""Exact top-k by inner product: ball-tree branch and bound per shard, k-th scores shared between waves.

Vectors are turned into integers, floor(64 * x). They are dealt into shards of
neighbours: a coarse tree over a bounded sample names regions, and vectors lie
in the order of their regions. A shard has a ball: a centre, a radius and its
longest vector's length, so no vector in it scores more than ``q . c + |q| * r``
or ``|q| * |v|``.

The search goes in waves. In the first, each query goes to the shard of highest
bound; later waves take in eight shards more, and then nine times as many, but
only those whose bound reaches the query's k-th score so far. Only those pairs
travel, a block's queries together. In a shard,
queries descend its ball tree by falling bound; a query leaves out a node, and
with it all below, once its k-th score is above the node's bound. A wave's best
k are kept, and their last is the k-th score of the next.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import Workspace, ship

K, EVERY, SCALE = 20, 20, 64
#: Vectors of a shard, of a tree's leaf, and queries of a block.
SHARD, LEAF, QUERY_BLOCK = 8192, 64, 1024
#: The first wave's shards for a query are those with fewer vectors than this in front of them: one. By how much later waves are larger: each adds about k hits so many times.
FIRST_WAVE, GROWTH = 1, 8
#: Shards whose balls are held at a time (half a kilobyte each); more are searched one lot after the other.
LOT = 8192
#: The sample that the coarse tree is made of, and its leaves at most. They decide which vectors lie together, never what is found.
SAMPLE, REGIONS, REGION_ROWS = 8192, 1024, 2048
LOWEST = -(2**62)

HITS = "query_id long, vec_id long, score long"
_SHARDS = "shard long, width int, n long, radius double, longest double, largest double, centre array<double>, ids binary, vectors binary"
_ASKED = "shard long, width int, ids binary, vectors binary, kth binary, kth_id binary"


def _split(x: np.ndarray) -> np.ndarray:
    """Order of vectors along the line from one far point to the one farthest from it; equal ones can be halved as well."""
    far = x[((x - x[0]) ** 2).sum(axis=1).argmax()]
    axis = x[((x - far) ** 2).sum(axis=1).argmax()] - far
    return np.argsort(x @ axis, kind="stable")


def ball(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Centre, radius and greatest length."""
    centre = x.mean(axis=0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())), float(np.sqrt((x**2).sum(axis=1).max()))


def bounds(q: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """What no vector of each ball exceeds, by query and ball; a little more, for what floating point loses."""
    bound = np.minimum(q @ centres.T + norms[:, None] * radii, norms[:, None] * longest)
    return bound + 1e-9 * norms[:, None] * (longest + radii) + 1.0


class BallTree:
    """A binary tree over integer vectors; node 0 is the root, a leaf has no children.

    scanned counts the (query, leaf) pairs that were scored, asked those there are.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int | None = None):
        leaf = LEAF if leaf is None else leaf
        self.ids, self.whole, self.vectors = ids, vectors.astype(np.int64), vectors.astype(np.float64)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.children: list[tuple[int, int] | None] = [None]
        self.members: dict[int, np.ndarray] = {}
        self.balls = [ball(self.vectors)]
        self.scanned = self.asked = 0
        todo = [(0, np.arange(len(ids)))]
        while todo:
            node, at = todo.pop()
            if len(at) <= leaf:
                self.members[node] = at
                continue
            order = _split(self.vectors[at])
            halves = at[order[: len(at) // 2]], at[order[len(at) // 2 :]]
            self.children[node] = len(self.children), len(self.children) + 1
            for half in halves:
                todo.append((len(self.children), half))
                self.children.append(None)
                self.balls.append(ball(self.vectors[half]))

    def bound(self, node: int, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        centre, radius, longest = self.balls[node]
        return bounds(q, norms, centre[None, :], np.array([radius]), np.array([longest]))[:, 0]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, kth_id: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits (query_id, vec_id, score) that may be among a query's k best, itself left out.

        kth, kth_id: score and vec_id of a k-th candidate that is known
        already; what comes behind it isn't wanted. Scores are exact: products
        in float64 where every sum stays below 2**53, else in 64-bit integers;
        sums beyond those are an error.
        """
        q = queries.astype(np.float64)
        most = float(np.abs(q).max(initial=0)) * self.largest * q.shape[1]
        if most >= 2**62:
            raise OverflowError("an inner product may not fit 64 bits")
        left, right = (q, self.vectors) if most < 2**53 else (queries.astype(np.int64), self.whole)
        norms = np.sqrt((q**2).sum(axis=1))
        n = len(q)
        best_score = np.full((n, k), LOWEST, np.int64)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        floor, floor_id = kth.astype(np.int64), kth_id.astype(np.int64)
        self.asked += n * len(self.members)
        todo: list[tuple] = []

        def reach(node: int, who: np.ndarray) -> None:
            if len(who):
                b = self.bound(node, q[who], norms[who])
                heapq.heappush(todo, (-b.max(), node, who, b))

        reach(0, np.arange(n))
        while todo:
            _, node, who, b = heapq.heappop(todo)
            who = who[b >= floor[who]]
            if not len(who):
                continue  # and nothing below the node is looked at
            if self.children[node] is not None:
                for child in self.children[node]:
                    reach(child, who)
                continue
            at = self.members[node]
            self.scanned += len(who)
            scores = left[who] @ right[at].T
            better = (scores > floor[who, None]) | ((scores == floor[who, None]) & (self.ids[at][None, :] <= floor_id[who, None]))
            better &= query_ids[who][:, None] != self.ids[at][None, :]
            some = np.flatnonzero(better.any(axis=1))
            if not len(some):
                continue
            who = who[some]
            mine = np.where(better[some], scores[some], LOWEST).astype(np.int64)
            all_scores = np.concatenate([best_score[who], mine], axis=1)
            all_ids = np.concatenate([best_id[who], np.broadcast_to(self.ids[at], mine.shape)], axis=1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best_score[who], best_id[who] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
            last, last_id = best_score[who, -1], best_id[who, -1]
            ahead = (last > floor[who]) | ((last == floor[who]) & (last_id < floor_id[who]))
            floor[who], floor_id[who] = np.where(ahead, last, floor[who]), np.where(ahead, last_id, floor_id[who])
        keep = best_score > LOWEST
        return query_ids[np.nonzero(keep)[0]], best_id[keep], best_score[keep]


def integer_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 * x) of every component x as double.

    Null vectors, and vectors with null or non-finite components, are left out.
    """
    x = F.col("embedding")
    known = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(known & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"))


def _by_width(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, matrix) of the vectors of each length."""
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    for width in np.unique(size):
        rows = np.flatnonzero(size == width)
        yield int(width), rows, flat[at[rows][:, None] + np.arange(width)]


def coarse_centres(sample: list[tuple[int, list[int]]], regions: int) -> dict[int, np.ndarray]:
    """By length of vector: centres of a coarse tree's leaves, neighbours side by side."""
    by: dict[int, list] = defaultdict(list)
    for _, v in sorted(sample):
        by[len(v)].append(v)
    out = {}
    for width, rows in by.items():
        x, lots = np.array(rows, np.float64).reshape(len(rows), width), []
        todo, most = [np.arange(len(x))], max(8, -(-len(x) // regions))
        while todo:
            at = todo.pop()
            if len(at) <= most:
                lots.append(x[at].mean(axis=0))
            else:
                order = _split(x[at])
                todo += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]
        out[width] = np.array(lots)
    return out


def _placed(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds region, the number of the nearest centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: (c, (c**2).sum(axis=1)) for w, c in shared.value.items()}
        for batch in batches:
            region = np.zeros(batch.num_rows, np.int32)
            for width, rows, x in _by_width(batch.column(1)):
                if width in known:
                    c, squares = known[width]
                    region[rows] = (squares - 2 * (x.astype(np.float64) @ c.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=["vec_id", "v", "region"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, region int")


def _bundle(size: int):
    """Packs a partition's rows, as they come, into shards of at most so many vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = defaultdict(list)

        def close(width: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            centre, radius, longest = ball(x.astype(np.float64))
            row = [number, width, len(ids), radius, longest, float(np.abs(x).max(initial=0)), centre.tolist(), ids.astype("<i8").tobytes(), x.astype("<i8").tobytes()]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in _SHARDS.split(", ")])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for width, rows, x in _by_width(batch.column(1)):
                held[width].append((ids[rows], x))
                if sum(len(i) for i, _ in held[width]) >= size:
                    i, v = (np.concatenate(c) for c in zip(*held.pop(width)))
                    whole = len(i) // size * size
                    for at in range(0, whole, size):
                        yield close(width, i[at : at + size], v[at : at + size])
                    if whole < len(i):
                        held[width].append((i[whole:], v[whole:]))
        for width in list(held):
            yield close(width, *(np.concatenate(c) for c in zip(*held.pop(width))))

    return run


def _balls(shards: DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """By length of vector: shard numbers, counts, centres, radii, lengths of the longest. Half a kilobyte for each of a lot's shards."""
    by: dict[int, list] = defaultdict(list)
    for r in shards.select("shard", "width", "n", "radius", "longest", "centre").orderBy("shard").collect():
        by[r.width].append(r)
    return {w: (np.array([r.shard for r in rs]), np.array([r.n for r in rs]), np.array([r.centre for r in rs], np.float64).reshape(len(rs), w), np.array([r.radius for r in rs]), np.array([r.longest for r in rs])) for w, rs in by.items()}


def _route(shared, low: int, high: int, size: int):
    """Queries (vec_id, v, kth, kth_id) to the shards of their wave: those before which, by falling bound, low to high vectors lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = shared.value
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in (0, 2, 3)]
            for width, rows, x in _by_width(batch.column(1)):
                if width not in balls:
                    continue
                shard, n, centres, radii, longest = balls[width]
                for first in range(0, len(rows), size):
                    part, q = rows[first : first + size], x[first : first + size]
                    ids, kth, kth_id = (c[part] for c in columns)
                    asked: dict[int, list[np.ndarray]] = defaultdict(list)
                    for at in range(0, len(part), 64):
                        y = q[at : at + 64].astype(np.float64)
                        b = bounds(y, np.sqrt((y**2).sum(axis=1)), centres, radii, longest)
                        order = np.argsort(-b, axis=1, kind="stable")
                        before = np.cumsum(n[order], axis=1) - n[order]
                        mine = (before >= low) & (before < high) & (np.take_along_axis(b, order, 1) >= kth[at : at + 64, None])
                        who, nth = np.nonzero(mine)
                        to = order[who, nth]
                        for s in np.unique(to):
                            asked[int(s)].append(at + who[to == s])
                    for s, who in asked.items():
                        w = np.concatenate(who)
                        packed = [a.astype("<i8").tobytes() for a in (ids[w], q[w], kth[w], kth_id[w])]
                        yield pa.RecordBatch.from_arrays([pa.array([shard[s]], pa.int64()), pa.array([width], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)], names=[c.split()[0] for c in _ASKED.split(", ")])

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: a shard's vectors (kth null), or queries for it (kth present); a shard's rows lie together, its vectors first."""
    shard = tree = None
    for batch in batches:
        for number, width, ids, vectors, kth, kth_id in zip(*(batch.column(i).to_pylist() for i in range(6))):
            i, v = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8")
            v = v.reshape(len(i), width)
            if kth is None:
                shard, tree = number, BallTree(i, v)
                continue
            if number != shard:
                raise ValueError("queries without their shard")
            found = tree.search(i, v, np.frombuffer(kth, "<i8"), np.frombuffer(kth_id, "<i8"))
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])


def _ranked(hits: DataFrame) -> DataFrame:
    """Each query's k best with their rank; the rank's limit goes in front of the shuffle too."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= K)


def make_shards(ws: Workspace, vectors: DataFrame, n: int) -> DataFrame:
    """Vectors as shards of neighbours, with their balls."""
    regions = max(1, min(REGIONS, n // REGION_ROWS))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, n)).collect() if regions > 1 else []
    placed = _placed(vectors, coarse_centres([(r.vec_id, r.v) for r in sample], regions))
    # A region of any size is dealt over tasks, as the hash is part of the order.
    dealt = placed.repartitionByRange(max(1, -(-n // SHARD)), "region", F.xxhash64("vec_id")).sortWithinPartitions("region", F.xxhash64("vec_id"))
    return ws.put("shards", dealt.select("vec_id", "v").mapInArrow(_bundle(SHARD), _SHARDS))


def exact_top_k(ws: Workspace, table: DataFrame) -> DataFrame:
    """For each vec_id divisible by 20 its 20 best other rows: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id. Fewer candidates: all of them. Vectors that
    are null or hold null or non-finite components take no part, as queries or
    candidates; vectors of different lengths aren't compared. Rows repeated
    with one vec_id are candidates each, and one query, with the smallest of
    their vectors. Empty: no rows. Other columns take no part.
    """
    spark = table.sparkSession
    ship(spark)
    vectors = ws.put("vectors", integer_vectors(table))
    n = vectors.count()
    shards = make_shards(ws, vectors, n)
    queries = ws.put("queries", vectors.where(F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    lots = max(1, -(-shards.count() // LOT))
    best, wave = ws.put("best-0", spark.createDataFrame([], f"{HITS}, rank int")), 0
    for lot in range(lots):
        mine = shards.where(F.pmod(F.xxhash64("shard"), F.lit(lots)) == lot)
        balls = _balls(mine)
        shared = spark.sparkContext.broadcast(balls)
        total = max((int(b[1].sum()) for b in balls.values()), default=0)
        mean = max((-(-int(b[1].sum()) // len(b[1])) for b in balls.values()), default=1)
        low, high = 0, FIRST_WAVE
        while low < total:
            last = best.where(F.col("rank") == K).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
            informed = queries.join(last, "vec_id", "left").select("vec_id", "v", F.coalesce("kth", F.lit(LOWEST)).alias("kth"), F.coalesce("kth_id", F.lit(2**63 - 1)).alias("kth_id"))
            asked = ws.put(f"asked-{wave + 1}", informed.mapInArrow(_route(shared, low, high, QUERY_BLOCK), _ASKED), codec="lz4")
            none = F.lit(None).cast("binary")
            held = mine.join(asked.select("shard").distinct(), "shard", "left_semi").select("shard", "width", "ids", "vectors", none.alias("kth"), none.alias("kth_id"))
            parts = max(2, min(-(-n // SHARD), 2000))
            dealt = held.unionByName(asked).repartition(parts, "shard").sortWithinPartitions("shard", F.col("kth").isNotNull())
            hits = dealt.mapInArrow(_search, HITS).unionByName(best.drop("rank"))
            wave += 1
            best = ws.put(f"best-{wave}", _ranked(hits))
            ws.drop(f"asked-{wave}")
            low, high = high, high * (GROWTH + 1) if low else high + GROWTH * mean
    return best.select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of the table."""
    return exact_top_k(Workspace(spark, "topk"), spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_OP9 = """
WITH e AS (
  SELECT vec_id, [floor(CAST(x AS DOUBLE) * 64) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
