"""Exact deduplication against a persistent digest index, in DataFrame operations alone.

The index is a list of runs. A run is a table bucketed and sorted by digest,
with one file a bucket, so a sort-merge join reads it as it lies: no shuffle
and no sort on its side. A batch is reduced to one row for each digest and
dealt out like the buckets, once; then it meets one run after the other in
sort-merge anti-joins, and what is new becomes a run of its own. Runs of like
size are merged, so there are about as many as the logarithm of the batches,
and a row is rewritten as often at most. Texts don't take part; digests do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Workspace
from ..sources import index_store as S
from .bounded import to_rows

#: One space stands for each run of these (space and \t \n \v \f \r).
WHITE = r"[\x20\x09-\x0D]+"
#: Digests of a bucket, by which a new index chooses its number of buckets, and the fewest of them.
BUCKET_ROWS, FEWEST_BUCKETS = 1 << 20, 8


def text_sha256(text: Column) -> Column:
    """Lower-case hex digest of the text with each run of white space as one space; null as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256)


class DigestIndex:
    """Runs of (digest, keep_id) and a manifest that names them, in one folder.

    In ``spark.checkpoint.dir`` or another shared folder it outlives the
    session; a later one opens it by the same path. The number of buckets is
    fixed by the first batch, unless given. The manifest is renamed into place
    last, so a job that is lost leaves the index as it was, and a batch that
    was recorded already isn't appended again: run twice is run once. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        # Buckets of one file each are read in their order.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def manifest(self) -> dict:
        text = S.read_text(self.spark, f"{self.path}/index.json")
        return json.loads(text) if text else {"buckets": self.buckets, "runs": [], "batches": []}

    def _table(self, run: str, buckets: int) -> DataFrame:
        name = f"digest_run_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{run}').hex}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/{run}'"
        )
        return self.spark.table(name)

    def _write(self, rows: DataFrame, buckets: int) -> dict:
        run = f"run-{uuid.uuid4().hex[:12]}"
        name = f"digest_run_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{run}').hex}"
        dealt = rows.select("digest", "keep_id").repartition(buckets, "digest")
        dealt.write.bucketBy(buckets, "digest").sortBy("digest").format("parquet").option("path", f"{self.path}/{run}").saveAsTable(name)
        return {"name": run, "rows": self._table(run, buckets).count()}

    def runs(self) -> list[DataFrame]:
        m = self.manifest()
        return [self._table(r["name"], m["buckets"]) for r in m["runs"]]

    def read(self) -> DataFrame:
        """(digest, keep_id) of all runs."""
        found = self.spark.createDataFrame([], "digest string, keep_id long")
        for run in self.runs():
            found = found.unionByName(run)
        return found

    def dealt(self, groups: DataFrame) -> DataFrame:
        """Rows with a digest, one for each, dealt out as the buckets are."""
        return groups.repartition(self.manifest()["buckets"] or FEWEST_BUCKETS, "digest")

    def unknown(self, groups: DataFrame) -> DataFrame:
        """Rows whose digest no run has."""
        rest = self.dealt(groups)
        for run in self.runs():
            rest = rest.join(run.select("digest").hint("merge"), "digest", "left_anti")
        return rest

    def known(self, groups: DataFrame) -> DataFrame:
        """Adds held (whether a run has the digest) and index_id."""
        found = self.dealt(groups).withColumns({"held": F.lit(False), "index_id": F.lit(None).cast("long")})
        for run in self.runs():
            mine = run.select("digest", F.col("keep_id").alias("_id"), F.lit(True).alias("_held"))
            found = found.join(mine.hint("merge"), "digest", "left").withColumns({"index_id": F.coalesce("index_id", "_id"), "held": F.col("held") | F.coalesce("_held", F.lit(False))}).drop("_id", "_held")
        return found

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds (digest, keep_id) of digests that no earlier batch has; groups has one row for each digest."""
        m = self.manifest()
        if batch in m["batches"]:
            return
        if m["buckets"] is None:
            m["buckets"] = max(FEWEST_BUCKETS, -(-groups.count() // BUCKET_ROWS))
        runs = m["runs"] + [self._write(self.unknown(groups), m["buckets"])]
        while len(runs) > 1 and runs[-2]["rows"] <= 2 * runs[-1]["rows"]:
            a, b = (self._table(r["name"], m["buckets"]) for r in runs[-2:])
            runs[-2:] = [self._write(a.unionByName(b), m["buckets"])]
        S.write_text(self.spark, f"{self.path}/index.json", json.dumps({"buckets": m["buckets"], "runs": runs, "batches": [*m["batches"], batch]}))


def dedup_batch(ws: Workspace, docs: DataFrame, index: DigestIndex, batch: str = "first") -> DataFrame:
    """For each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest doc_id of the rows with an equal text, or the
    index's, if an earlier batch has that text. group_size counts rows of this
    batch. Null text counts as empty. Null doc_id: never keeps unless the whole
    group has none (keep_id is null then, kept true). Rows repeated with the
    kept doc_id are all marked kept. Empty table: no rows. Other columns take
    no part.
    """
    digests = ws.put("digests", docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_sha256(F.col("text")).alias("digest")))
    groups = ws.put("groups", digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    index.append(groups, batch)
    keep = index.known(groups).select("digest", F.when(F.col("held"), F.col("index_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size")
    # A copied text may be a third of all rows: its partition of the digests is split at run time, as groups has one row for it.
    found = digests.join(keep.hint("merge"), "digest")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the table, as the first batch of a new index."""
    ws = Workspace(spark, "exact-dedup")
    return dedup_batch(ws, spark.read.parquet(f"{sf_dir}/documents.parquet"), DigestIndex(spark, ws.path("index")))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the smallest doc_id; the columns stay as they are.

    Of rows repeated with one doc_id and text, one stays as well. What is to go
    is found on digests alone; it is brought to the rows, which stay where they
    are if it is few, and else are dealt out by doc_id and digest, texts and
    all.
    """
    ws = Workspace(spark, "exact-dedup")
    found = dedup_batch(ws, docs, DigestIndex(spark, ws.path("index")))
    gone = ws.put("gone", found.where("NOT kept").select(F.col("doc_id").alias("_doc"), F.col("text_sha256").alias("_sha")).distinct())
    kept = found.where("kept").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("doc_id", "text_sha256")).alias("ids")).first()
    # Rows travel as one column, so that theirs may have any names.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text_sha256(F.col("text")).alias("digest"))
    stay = held.join(to_rows(gone), held["id"].eqNullSafe(gone["_doc"]) & (held["digest"] == gone["_sha"]), "left_anti")
    if kept.n > kept.ids:  # some kept row is repeated
        stay = stay.dropDuplicates(["id", "digest"])
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE_OP4 = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
