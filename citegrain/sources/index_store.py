"""The index on storage: shards by source, immutable views, and one manifest that names the live view.

Shards are partitions of Parquet tables, replaced whole (dynamic partition
overwrite). A view is a directory that is written once; the manifest is renamed
into place last, which is the only switch a reader can see. Everything goes
through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import corpus as C
from ..operators import retrieval as R

INDEX_VERSION, INGESTION_VERSION = 1, 1
MANIFEST = "manifest.json"
PASSAGE_TABLE, META_TABLE, SIDECAR_TABLE = "shards/passages", "shards/meta", "shards/sidecar"


class VersionMismatch(RuntimeError):
    pass


class Mixed(RuntimeError):
    """Shards of different embedding models can't make one view."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    jvm, p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside, then renamed over."""
    jvm, tmp, fs = _fs(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri())
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(tmp, final, options)


def write_shards(spark: SparkSession, root: str, passages: DataFrame, meta: DataFrame, sidecar: DataFrame | None = None) -> None:
    """Replaces the shards of the sources in ``passages`` and leaves others alone; the meta rows come last.

    meta: source_id, store, kind, display_name, fingerprint, ingestion_version,
    model, dim, normalised, chunk_count, ingested_at and further source fields.
    """
    if sidecar is not None:
        sidecar.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(f"{root}/{SIDECAR_TABLE}")
    passages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(f"{root}/{PASSAGE_TABLE}")
    meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(f"{root}/{META_TABLE}")


def read_metas(spark: SparkSession, root: str) -> DataFrame | None:
    """A row for each shard; a meta file that can't be read is passed over, and its shard built again. None without any."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(f"{root}/{META_TABLE}") if exists(spark, f"{root}/{META_TABLE}") else None


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """Passages of committed shards: those whose meta row stands."""
    return spark.read.parquet(f"{root}/{PASSAGE_TABLE}").join(read_metas(spark, root).select("source_id"), "source_id", "left_semi")


def read_shard(spark: SparkSession, root: str, source_id: str) -> DataFrame:
    """Passages of one committed shard, by its partition alone; no rows if there is none."""
    return read_shards(spark, root).where(F.col("source_id") == source_id)


def remove_sources(spark: SparkSession, root: str, source_ids: list[str]) -> None:
    """Deletes whole partitions, the meta row first, so that a shard half deleted reads as none."""
    for s in source_ids:
        part = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(s)
        for t in (META_TABLE, PASSAGE_TABLE, SIDECAR_TABLE):
            _, p, fs = _fs(spark, f"{root}/{t}/source_id={part}")
            fs.delete(p, True)


def commit_view(spark: SparkSession, root: str, gaps: dict | None = None, built_at: str | None = None) -> dict:
    """Builds a view of all shards and makes it the live one; returns its manifest.

    Passages get row numbers by source and position: ranges for each source are
    summed over sources, numbers inside a source come from a window by source.
    """
    built_at = built_at or datetime.now(timezone.utc).isoformat(timespec="seconds")
    metas = read_metas(spark, root)
    models = metas.select("model", "dim", "normalised").distinct().limit(2).collect()
    if len(models) > 1:
        raise Mixed("shards hold vectors of more than one model")
    revision = C.corpus_revision(metas).first().revision
    attempt = 0
    while exists(spark, f"{root}/views/{C.view_name(revision, built_at, attempt)}"):
        attempt += 1
    view_dir = f"views/{C.view_name(revision, built_at, attempt)}"
    at = f"{root}/{view_dir}"
    passages = read_shards(spark, root)
    slices = C.source_slices(passages.groupBy("source_id").agg(F.count(F.lit(1)).alias("row_count")))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("position")) - 1
    numbered = passages.withColumn("_nth", nth).join(slices, "source_id").withColumn("row_id", F.col("row_start") + F.col("_nth")).drop("_nth", "row_start", "row_count")
    numbered.write.parquet(f"{at}/passages")
    metas.write.parquet(f"{at}/sources")
    stored = spark.read.parquet(f"{at}/passages")
    R.write_lexical_index(R.lexical_index(stored, F.concat_ws("\n", "header", "text")), f"{at}/lexical")
    if exists(spark, f"{root}/{SIDECAR_TABLE}"):
        spark.read.parquet(f"{root}/{SIDECAR_TABLE}").write.parquet(f"{at}/sidecar")
    write_text(spark, f"{at}/gaps.json", json.dumps(gaps or {"owned_but_undocumented": [], "documented_but_unconfirmed": []}))
    sources = [r.asDict() for r in slices.join(metas.select("source_id", "kind", "fingerprint", "chunk_count"), "source_id").orderBy("source_id").collect()]
    embedding = models[0].asDict() if models else None
    manifest = {"index_version": INDEX_VERSION, "view_dir": view_dir, "corpus_revision": revision, "built_at": built_at, "ingestion_version": INGESTION_VERSION, "embedding": embedding, "sources": sources}
    write_text(spark, f"{root}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False, indent=1))
    return manifest


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The live manifest; none where there is none or it isn't JSON; another index version is an error."""
    text = read_text(spark, f"{root}/{MANIFEST}")
    try:
        found = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if found is not None and found.get("index_version") != INDEX_VERSION:
        raise VersionMismatch(f"index version {found.get('index_version')}, not {INDEX_VERSION}")
    return found


def load_view(spark: SparkSession, root: str, manifest: dict) -> dict[str, DataFrame]:
    """Tables of a view, checked: as many passages as the manifest says, and as many lengths in the lexical index."""
    at = f"{root}/{manifest['view_dir']}"
    view = {"passages": spark.read.parquet(f"{at}/passages"), "sources": spark.read.parquet(f"{at}/sources")}
    if exists(spark, f"{at}/sidecar"):
        view["sidecar"] = spark.read.parquet(f"{at}/sidecar")
    rows = sum(s["row_count"] for s in manifest["sources"])
    lexical = R.read_lexical_index(spark, f"{at}/lexical")
    if not rows == view["passages"].count() == lexical.lengths.count():
        raise RuntimeError("the view's tables don't have the rows that its manifest names")
    if "sidecar" not in view and any(s["kind"] == "authored-triage" for s in manifest["sources"]):
        raise RuntimeError("a view with authored passages needs their sidecar")
    return view | {"postings": lexical.postings, "lengths": lexical.lengths, "terms": lexical.terms, "stats": lexical.stats}


def collect_views(spark: SparkSession, root: str) -> list[str]:
    """Deletes views that the live manifest doesn't name, at the start of a run; without a manifest, none."""
    manifest = read_manifest(spark, root)
    if manifest is None or not exists(spark, f"{root}/views"):
        return []
    _, p, fs = _fs(spark, f"{root}/views")
    gone = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if f"views/{name}" != manifest["view_dir"]:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def write_audit(spark: SparkSession, root: str, source_id: str, audit: dict, rejection: dict | None = None) -> str:
    """One JSON file a source; ``rejection`` is always there."""
    at = f"{root}/audits/{source_id.replace('/', '_')}.json"
    write_text(spark, at, json.dumps({**audit, "rejection": rejection}, ensure_ascii=False, indent=1))
    return at


def read_audit(spark: SparkSession, root: str, source_id: str) -> dict | None:
    text = read_text(spark, f"{root}/audits/{source_id.replace('/', '_')}.json")
    return None if text is None else json.loads(text)
