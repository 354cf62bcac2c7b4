"""Sources, stores and index versions as tables: discovery, identity, reuse, removal, inventory and gaps."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Why a source is left out at discovery.
FILENAME_INVALID, COLLISION = "filename-invalid", "source-id-collision"
NOT_APPLICABLE = "not applicable"
#: Fields of a source that only manuals have.
MANUAL_FIELDS = ("vendor", "product", "doctype", "doc_version", "lang", "page_count", "english_pages")


def classify_files(files: DataFrame) -> DataFrame:
    """(store, name, content sha or nothing) of manuals: identity, and the reason of a rejection or null.

    files(store, name). Files that aren't PDFs by their suffix, in any case,
    are passed over. A name outside the grammar is invalid; an id that several
    names of a store claim rejects all of them.
    """
    named = files.where(F.lower("name").endswith(".pdf")).withColumn("identity", T.filename_identity(F.col("name")))
    named = named.withColumn("source_id", T.identity_source_id(F.col("identity")))
    claims = F.count(F.lit(1)).over(Window.partitionBy("store", "source_id"))
    reason = F.when(F.col("identity").isNull(), FILENAME_INVALID).when(claims > 1, COLLISION)
    return named.withColumn("reason", reason).withColumn("display_name", T.identity_display_name(F.col("identity")))


def contested_ids(discovered: DataFrame) -> DataFrame:
    """(store, source_id, stores) of ids that several stores claim; each of them loses it."""
    stores = discovered.groupBy("source_id").agg(F.array_sort(F.collect_set("store")).alias("stores")).where(F.size("stores") > 1)
    return discovered.select("store", "source_id").distinct().join(stores, "source_id")


def fingerprint(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def store_fingerprint(files: DataFrame) -> DataFrame:
    """(store, fingerprint) over the sorted paths and hashes of a store's files; files(store, path, sha)."""
    lines = F.array_sort(F.collect_list(F.struct("path", "sha")))
    return files.groupBy("store").agg(F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x["path"], F.lit("\0"), x["sha"], F.lit("\n"))), ""), 256).alias("fingerprint"))


def absent_sources(committed: DataFrame, discovered: DataFrame, stores: DataFrame) -> DataFrame:
    """Committed (store, source_id) that discovery no longer holds, in stores that could be read. A missing store removes nothing."""
    readable = committed.join(stores.where("available").select("store"), "store", "left_semi")
    return readable.join(discovered.select("store", "source_id"), ["store", "source_id"], "left_anti")


def store_anomalies(discovered: DataFrame, committed: DataFrame) -> DataFrame:
    """(store, source_id, anomaly): in the store but not the index, or the reverse."""
    left = discovered.select("store", "source_id", F.lit(True).alias("in_store"))
    right = committed.select("store", "source_id", F.lit(True).alias("in_index"))
    both = left.join(right, ["store", "source_id"], "full_outer")
    return both.where(F.col("in_store").isNull() | F.col("in_index").isNull()).select("store", "source_id", F.when(F.col("in_index").isNull(), "not-indexed").otherwise("not-in-store").alias("anomaly"))


def reuse_plan(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(source_id, action): reuse if fingerprint, ingestion version and embedding are all equal, else build. Null embeddings never match.

    Both: (source_id, fingerprint, ingestion_version, model, dim, normalised).
    """
    keys = ["fingerprint", "ingestion_version", "model", "dim", "normalised"]
    old = previous.select("source_id", *[F.col(k).alias(f"old_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"old_{k}"))
    return current.join(old, "source_id", "left").select("source_id", F.when(F.coalesce(same, F.lit(False)), "reuse").otherwise("build").alias("action"))


def reuse_vectors(passages: DataFrame, previous: DataFrame) -> DataFrame:
    """Passages with the vector of an earlier run where there is one; null vectors are still to be embedded."""
    return passages.join(previous.select("passage_id", F.col("vector").alias("kept")), "passage_id", "left").withColumn("reused", F.col("kept").isNotNull())


def assign_passage_ids(passages: DataFrame, canonical: Column) -> DataFrame:
    """Adds passage_id: in a source, the k-th text with one digest, by position, gets `.k` from the second on.

    passages(source_id, position, ...). The window is by source and digest, so
    a source however large is spread over its digests.
    """
    base = T.digest_id(F.col("source_id"), canonical)
    nth = F.row_number().over(Window.partitionBy("source_id", "_base").orderBy("position"))
    return passages.withColumn("_base", base).withColumn("_nth", nth).withColumn("passage_id", F.when(F.col("_nth") > 1, F.concat_ws(".", "_base", F.col("_nth").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_nth")


def corpus_revision(sources: DataFrame) -> DataFrame:
    """One row, revision: digest of the sorted (source_id, fingerprint, chunk_count), as a compact JSON array of arrays.

    One row for each source goes through one task: sources, not passages.
    """
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    rows = F.array_sort(F.collect_list(F.struct("source_id", "fingerprint", "chunk_count")))
    lines = F.transform(rows, lambda x: F.concat(F.lit("["), quoted(x["source_id"]), F.lit(","), quoted(x["fingerprint"]), F.lit(","), x["chunk_count"].cast("string"), F.lit("]")))
    return sources.agg(F.sha2(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")), 256).alias("revision"))


def view_name(revision: str, built_at: str, attempt: int = 0) -> str:
    return hashlib.sha256(f"{revision}|{built_at}|{attempt}".encode()).hexdigest()[:16]


def source_slices(counts: DataFrame) -> DataFrame:
    """(source_id, row_start, row_count): consecutive ranges in source_id order; counts has one row a source."""
    before = F.sum("row_count").over(Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("source_id", F.coalesce(before, F.lit(0)).alias("row_start"), "row_count")


def with_applicability(sources: DataFrame, declared: DataFrame) -> DataFrame:
    """Sources with the inventory's declaration (device, revision, status) in place of the default; authored ones stay."""
    d = declared.select("source_id", *[F.col(c).alias(f"d_{c}") for c in ("device", "revision", "status")], F.lit(True).alias("declared"))
    joined = sources.join(d, "source_id", "left")
    take = F.col("declared").isNotNull() & (F.col("kind") != "authored-triage")
    return joined.withColumns({c: F.when(take, F.col(f"d_{c}")).otherwise(F.col(c)) for c in ("device", "revision", "status")}).drop("d_device", "d_revision", "d_status", "declared")


def owned_but_undocumented(devices: DataFrame, sources: DataFrame) -> DataFrame:
    """Inventory devices that no manual is about."""
    manuals = sources.where("kind = 'vendor-manual'").select(F.col("device").alias("device_id"))
    return devices.join(manuals, "device_id", "left_anti")


def documented_but_unconfirmed(devices: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources about an owned device, unless confirmed for the very revision that is owned."""
    owned = devices.select("device_id", F.col("revision").alias("owned_revision"))
    joined = sources.join(owned, F.col("device") == F.col("device_id"))
    same = T.revision_trimmed(F.col("revision")) == T.revision_trimmed(F.col("owned_revision"))
    return joined.where(~((F.col("status") == "confirmed") & same)).select("source_id", "display_name", "device_id", "status", F.col("revision").alias("declared_revision"), "owned_revision")


def indexed_but_not_owned(devices: DataFrame, sources: DataFrame) -> DataFrame:
    return sources.where("kind = 'vendor-manual'").join(devices.select(F.col("device_id").alias("device")), "device", "left_anti").select("source_id")


def inventory(sources: DataFrame) -> DataFrame:
    """Sources with `not applicable` in the fields that only manuals have."""
    only = [c for c in sources.columns if c in MANUAL_FIELDS]
    return sources.withColumns({c: F.when(F.col("kind") == "authored-triage", F.lit(NOT_APPLICABLE)).otherwise(F.col(c).cast("string")) for c in only})


def page_ranges(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, lo, hi): runs of consecutive page numbers."""
    island = F.col("page") - F.row_number().over(Window.partitionBy(*keys).orderBy("page"))
    return pages.distinct().withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).drop("_island")


def inherit_nearest(rows: DataFrame, key: str, position: str, verdict: str, default: bool = True) -> DataFrame:
    """Null verdicts take the nearest above, else below, else the default. Window by key."""
    w = Window.partitionBy(key).orderBy(position)
    above = F.last(verdict, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(verdict, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("resolved", F.coalesce(above, below, F.lit(default)))


def search_sections(passages: DataFrame, term: str, limit: int = 40) -> DataFrame:
    """One row a section whose title or text holds the term in any case, with its first excerpt and the source's count."""
    low = F.lit(term.lower())
    hits = passages.where(F.lower("section_title").contains(low) | F.lower("text").contains(low))
    first = F.row_number().over(Window.partitionBy("source_id", "section_title").orderBy("passage_id"))
    sections = hits.withColumn("_n", first).where("_n = 1").withColumn("in_source", F.count(F.lit(1)).over(Window.partitionBy("source_id")))
    return sections.select("source_id", "section_title", "passage_id", T.excerpt(F.col("text"), low).alias("excerpt"), "in_source").orderBy("source_id", "section_title").limit(limit)


def nearest_rank(values: DataFrame, key: str, value: str, share: float = 0.95) -> DataFrame:
    """(key, count, result): the value at index round-half-even(share * (n - 1)) of each group.

    Equal values are counted before they meet; a group's distinct values are
    then summed up in order, and the first that reaches the index is it.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(key).agg(F.sum("n").alias("all"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    index = F.least(F.col("all") - 1, F.bround(share * (F.col("all") - 1)).cast("long"))
    reached = counted.withColumn("upto", upto).join(totals, key).where(F.col("upto") > index)
    return reached.groupBy(key).agg(F.first("all").alias("count"), F.min(value).alias("result"))
