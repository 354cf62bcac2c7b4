"""Connected components by alternating large and small stars, on tables alone; of few edges in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace, ship

#: Up to so many edges (sixteen bytes each) one task joins all ends; more go in rounds over tables. The components are the same.
FEW_EDGES = 300_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of a bounded number of edges; the smaller root stays."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    ids = list(root)
    for at in range(0, len(ids), 50_000):
        some = ids[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(i) for i in some], pa.int64())], names=["id", "component"])


def connected_components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for every end of an edge (a, b); component is the smallest id reachable.

    Each round joins the edges with the smallest neighbour of each node, one
    row a node, so no neighbourhood is gathered; a node with very many
    neighbours is a skewed key of a join, which is split at run time. Rounds
    grow with the logarithm of the longest chain. Self loops are allowed and
    yield the node alone. No edges: no rows.
    """
    now = ws.put(f"{name}-0", edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        ship(now.sparkSession)
        return ws.put(f"{name}-all", now.coalesce(1).mapInArrow(_united, "id long, component long"))
    before, turn = None, 0
    while True:
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Edges now point down, so each node's smaller neighbours hang on their smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
        turn += 1
        now = ws.put(f"{name}-{turn}", small)
        ws.drop(f"{name}-{turn - 1}")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
