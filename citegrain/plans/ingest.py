"""A whole run over stores: what is new is read, chunked and embedded; what is gone is removed; one view is committed."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chunking, corpus, entries, geometry, layout, vectors
from ..runtime import Workspace
from ..sources import index_store as S
from ..sources import snapshots, stores
from . import store as E

AUTHORED = "authored/triage"
CONTESTED = "source-id-contested"


@dataclass
class Report:
    """What a run did. failures decide the exit code; rejections don't."""

    ingested: list[str] = field(default_factory=list)
    reused: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    rejected: dict[str, str] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    audits: dict[str, dict] = field(default_factory=dict)
    entries: str = ""
    entry_lines: list[str] = field(default_factory=list)
    gaps: dict = field(default_factory=dict)
    manifest: dict | None = None

    @property
    def exit_code(self) -> int:
        return 1 if self.failures else 0


@dataclass
class Manuals:
    passages: DataFrame
    rejected: DataFrame  # source_id, reason
    audits: DataFrame  # a row for each source


def read_manuals(ws: Workspace, documents: DataFrame, sources: DataFrame, detector: layout.Detector | None = None) -> Manuals:
    """Snapshots to passages, in the order that matters: furniture, glyphs, sections, language, units.

    documents carry the source_id as doc; sources(source_id, display_name, lang).
    """
    raw = layout.lines_of(documents)
    has_text = layout.has_text_layer(raw)  # before furniture is marked
    lines = ws.put("lines", layout.mark_furniture(raw))
    glyphs = ws.put("glyphs", layout.glyph_audit(lines))
    none = documents.select("doc").join(has_text.where("has_text"), "doc", "left_anti").select("doc", F.lit("no-text-layer").alias("reason"))
    rejected = ws.put("rejected", glyphs.where("unreadable").select("doc", F.lit("unreadable-text").alias("reason")).unionByName(none).groupBy("doc").agg(F.max("reason").alias("reason")))
    good = layout.repaired_documents(documents.join(rejected.select("doc"), "doc", "left_anti"))
    # The repaired text takes the place of what was read, where furniture stands already.
    marks = lines.where("furniture").select("doc", "page", "block", "line", F.lit(True).alias("_f"))
    clean = layout.lines_of(good).join(marks, ["doc", "page", "block", "line"], "left").withColumn("furniture", F.col("furniture") | F.coalesce("_f", F.lit(False))).drop("_f")
    clean = ws.put("clean", clean)
    several = sources.where("lang = 'multi'").select(F.col("source_id").alias("doc"))
    blocks = ws.put("blocks", layout.select_english(layout.scored_blocks(clean.join(several, "doc", "left_semi"), good, detector)))
    units = ws.put("units", geometry.assemble_documents(good, clean, blocks.where("NOT english").select("doc", "page", "block")))
    first = lambda c: F.first(c).alias(c)
    regions = units.groupBy("source_id", "region").agg(first("section_number"), first("section_title"), first("section_path"), F.lit(None).cast("string").alias("entry_location"))
    passages = chunking.chunk_sources(units.select("source_id", "region", "position", "text", "page_start", "page_end", "atomic", "repeats", "degraded", "has_figures"), regions, sources)
    audits = layout.audits(documents, clean, glyphs, layout.language_audit(blocks))
    sections = units.groupBy(F.col("source_id").alias("doc")).agg(F.count_distinct("region").alias("sections"), F.max("inferred").alias("sections_inferred"), F.count(F.lit(1)).alias("units"))
    return Manuals(ws.put("passages", passages), rejected.withColumnRenamed("doc", "source_id"), audits.join(sections, "doc", "left").withColumnRenamed("doc", "source_id"))


def entry_passages(spark: SparkSession, e: E.Evaluation) -> DataFrame:
    """Passages of the entries that are served; a region is an entry's place among the files by name."""
    number = lambda df: df.withColumn("region", F.dense_rank().over(Window.orderBy("source_file")).cast("int"))  # noqa: E731  as many rows as an owner wrote files
    places = number(e.kept.select("source_file").distinct())
    units = entries.entry_units(e.kept, E.unbacked(e)).join(places, "source_file")
    regions = e.kept.join(places, "source_file").select(F.lit(AUTHORED).alias("source_id"), "region", F.lit(None).cast("string").alias("section_number"), F.col("symptom").alias("section_title"), F.array().cast("array<string>").alias("section_path"), F.concat_ws(":", "source_file", F.col("line").cast("string")).alias("entry_location"))
    none = F.lit(None).cast("int")
    flat = units.select(F.lit(AUTHORED).alias("source_id"), "region", "position", "text", none.alias("page_start"), none.alias("page_end"), "atomic", "repeats", "unbacked")
    source = spark.createDataFrame([(AUTHORED, "Troubleshooting entries")], "source_id string, display_name string")
    return chunking.chunk_sources(flat, regions, source)


class _Run:
    def __init__(self, spark, root, encoder, dimension, model, detector, built_at):
        self.spark, self.root, self.encoder, self.dimension = spark, root, encoder, dimension
        self.model, self.detector, self.built_at = model or vectors.name_of(encoder), detector, built_at
        self.report, self.ws = Report(), Workspace(spark, "ingest")

    def keyed(self, sources: DataFrame) -> DataFrame:
        """What a shard must agree with to be reused: fingerprint, version, and the encoder by name and dimension."""
        return sources.select("source_id", "fingerprint", F.lit(S.INGESTION_VERSION).alias("ingestion_version"), F.lit(self.model).alias("model"), F.lit(self.dimension).alias("dim"), F.lit(True).alias("normalised"))

    def build(self, manuals: str, found: DataFrame, ids: list[str]) -> None:
        """Reads and commits some sources. If that fails the halves are tried apart, so that one bad source fails alone."""
        if not ids:
            return
        ws = Workspace(self.spark, "manuals")
        todo = found.join(F.broadcast(self.spark.createDataFrame([(i,) for i in ids], "source_id string")), "source_id", "left_semi")
        try:
            names = [r.file for r in todo.select("file").collect()]
            documents = snapshots.read_snapshots(self.spark, names).join(todo.select(F.col("name").alias("doc"), "source_id"), "doc").drop("doc").withColumnRenamed("source_id", "doc")
            made = read_manuals(ws, documents, todo, self.detector)
            rejected = {r.source_id: r.reason for r in made.rejected.collect()}
            limits = documents.select(F.col("doc").alias("source_id"), "page_count")
            outside = {r.source_id for r in chunking.check_pages(made.passages, limits).select("source_id").distinct().collect()}
            done = [i for i in ids if i not in rejected and i not in outside]
            self.commit(made.passages.join(F.broadcast(self.spark.createDataFrame([(i,) for i in done], "source_id string")), "source_id", "left_semi") if outside or rejected else made.passages, todo, stores.MANUALS, "vendor-manual", None)
            audits = {r.source_id: {k: v for k, v in r.asDict(recursive=True).items() if k != "source_id"} for r in made.audits.collect()}
        except Exception as error:  # whatever it is, it belongs to a source
            if len(ids) == 1:
                self.report.failures[ids[0]] = str(error).strip().splitlines()[0]
                return
            for half in (ids[: len(ids) // 2], ids[len(ids) // 2 :]):
                self.build(manuals, found, half)
            return
        self.report.rejected |= rejected
        self.report.failures |= {i: "a passage lies outside the document's pages" for i in outside}
        self.report.ingested += done
        S.remove_sources(self.spark, self.root, sorted(rejected))
        for i in ids:
            self.report.audits[i] = audits.get(i, {})
            S.write_audit(self.spark, self.root, i, audits.get(i, {}), {"reason": rejected[i]} if i in rejected else None)

    def commit(self, passages: DataFrame, sheet: DataFrame, store: str, kind: str, previous: DataFrame | None, sidecar: DataFrame | None = None) -> None:
        ordered = passages.withColumn("position", F.row_number().over(Window.partitionBy("source_id").orderBy("region", "part")) - 1)
        columns = ["source_id", "passage_id", "position", "header", "text", "section_number", "section_title", "page_start", "page_end", "degraded", "has_figures", "unbacked", "entry_location"]
        embedded = vectors.encode_missing(ordered.select(*columns), previous, self.encoder, self.dimension)
        counts = ordered.groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        meta = self.keyed(sheet).join(sheet.select("source_id", "display_name"), "source_id").join(counts, "source_id").select("source_id", F.lit(store).alias("store"), F.lit(kind).alias("kind"), "display_name", "fingerprint", "ingestion_version", "model", "dim", "normalised", "chunk_count", F.lit(self.built_at).alias("ingested_at"))
        S.write_shards(self.spark, self.root, embedded, meta, sidecar)


def manual_passages(spark: SparkSession, root: str) -> DataFrame:
    """Committed passages of manuals; none where nothing has been committed."""
    if not S.exists(spark, f"{root}/{S.META_TABLE}"):
        return spark.createDataFrame([], "source_id string, passage_id string, section_number string, section_title string, position long, text string")
    return S.read_shards(spark, root).where(F.col("source_id") != AUTHORED).select("source_id", "passage_id", "section_number", "section_title", "position", "text")


def ingest(spark: SparkSession, root: str, manuals: str, entry_store: str, inventory: str, encoder: vectors.Encoder, dimension: int, built_at: str | None = None, detector: layout.Detector | None = None, model: str | None = None) -> Report:
    """Manuals come as span snapshots named by the manual grammar (``*.pdf.json``); entries as Markdown.

    A source whose fingerprint, ingestion version and embedding (model, by
    default the encoder's name, and dimension) haven't changed is left as it
    is. Entries are always read again, after the manuals. An id that both
    stores claim is lost to both. One source's failure leaves the others alone.
    """
    run = _Run(spark, root, encoder, dimension, model, detector, built_at or datetime.now(timezone.utc).isoformat(timespec="seconds"))
    report, ws = run.report, run.ws
    S.collect_views(spark, root)
    devices, declared = stores.load_inventory(spark, inventory)
    metas = S.read_metas(spark, root)
    metas = None if metas is None else ws.put("metas", metas)  # partitions of the table itself come and go below
    available, scanned = stores.scan_manuals(spark, manuals, ".json")
    found = spark.createDataFrame([], "source_id string, name string, file string, display_name string, lang string, fingerprint string")
    if available:
        scanned = ws.put("scanned", scanned.select("source_id", "name", "file", "display_name", F.col("identity.lang").alias("lang"), "fingerprint", "reason"))
        report.rejected |= {r.name: r.reason for r in scanned.where("reason IS NOT NULL").select("name", "reason").collect()}
        found = scanned.where("reason IS NULL").drop("reason")
    has_entries, entry_files, skipped = stores.scan_entries(spark, entry_store)
    if has_entries:
        report.skipped = sorted(r.path for r in skipped.collect())
    has_files = has_entries and not entry_files.isEmpty()
    here = found.select(F.lit(stores.MANUALS).alias("store"), "source_id")
    if has_files:
        here = here.union(spark.createDataFrame([(stores.ENTRIES, AUTHORED)], "store string, source_id string"))
    contested = {r.source_id for r in corpus.contested_ids(here).select("source_id").distinct().collect()}
    report.rejected |= {i: CONTESTED for i in contested}
    has_files = has_files and AUTHORED not in contested
    for i in contested:
        found, here = found.where(F.col("source_id") != i), here.where(F.col("source_id") != i)
    if metas is not None:
        open_ = spark.createDataFrame([(stores.MANUALS, available), (stores.ENTRIES, has_entries)], "store string, available boolean")
        report.removed = sorted(r.source_id for r in corpus.absent_sources(metas.select("store", "source_id"), here, open_).collect())
        S.remove_sources(spark, root, report.removed)
    now = run.keyed(found)
    plan = now.select("source_id", F.lit("build").alias("action")) if metas is None else corpus.reuse_plan(now, metas)
    actions = {r.source_id: r.action for r in plan.collect()}  # one row a source, as the report names them
    report.reused = sorted(s for s, a in actions.items() if a == "reuse")
    run.build(manuals, found, sorted(s for s, a in actions.items() if a == "build"))
    report.ingested.sort()
    if has_files:
        ledger_path = f"{entry_store}/.pointer-ledger.jsonl"
        ledger, missing = stores.read_ledger(spark, ledger_path)
        indexed = declared.select(F.col("device").alias("device_id")).union(found.select("source_id")).distinct()
        e = E.evaluate(Workspace(spark, "entries"), entry_files, manual_passages(spark, root), indexed, devices, ledger)
        passages = ws.put("entry-passages", entry_passages(spark, e))
        stored = S.read_shards(spark, root).where(F.col("source_id") == AUTHORED) if S.exists(spark, f"{root}/{S.META_TABLE}") else None
        same = metas is not None and not metas.where((F.col("source_id") == AUTHORED) & (F.col("model") == run.model) & (F.col("dim") == dimension)).isEmpty()
        old = ws.put("old-vectors", stored.select("passage_id", "vector")) if stored is not None and same else None
        sheet = stores.entries_fingerprint(entry_files).select(F.lit(AUTHORED).alias("source_id"), F.lit("Troubleshooting entries").alias("display_name"), "fingerprint")
        ids = passages.select(F.regexp_replace("entry_location", ":[0-9]+$", "").alias("source_file"), "passage_id")
        side = entries.sidecar(e.kept, ids).withColumn("source_id", F.lit(AUTHORED))
        run.commit(passages, sheet, stores.ENTRIES, "authored-triage", old, side)
        done = e.checked.where("state = 'ok'").join(e.kept.select("source_file"), "source_file", "left_semi")
        stores.write_ledger(ws.put("ledger", entries.update_ledger(ledger, done, run.built_at)), ledger_path)
        report.entries, report.entry_lines = E.counts(e), E.store_lines(e, missing)
        report.ingested.append(AUTHORED)
        report.audits[AUTHORED] = entries.store_report(e.parsed, e.kept, e.checked).first().asDict()
        S.write_audit(spark, root, AUTHORED, {"report": report.audits[AUTHORED]})
    sources = S.read_metas(spark, root)
    if sources is not None:
        applied = corpus.with_applicability(sources.withColumns({"device": F.col("source_id"), "revision": F.lit(None).cast("string"), "status": F.lit("assumed")}), declared)
        report.gaps = {
            "owned_but_undocumented": [r.asDict() for r in corpus.owned_but_undocumented(devices, applied).orderBy("position").collect()],
            "documented_but_unconfirmed": [r.asDict() for r in corpus.documented_but_unconfirmed(devices, applied).orderBy("source_id").collect()],
        }
        report.manifest = S.commit_view(spark, root, report.gaps, run.built_at)
    return report


def _open(spark: SparkSession, root: str) -> tuple[dict | None, str | None]:
    try:
        manifest = S.read_manifest(spark, root)
    except S.VersionMismatch as error:
        return None, f"{root}: {error}"
    return manifest, None if manifest is not None else f"{root}: no manifest, nothing has been committed here"


def _evaluated(spark: SparkSession, root: str, entry_store: str, inventory: str) -> tuple[E.Evaluation | None, DataFrame, bool]:
    """The store against the committed index, read only; none where the store can't be read."""
    devices, declared = stores.load_inventory(spark, inventory)
    available, files, _ = stores.scan_entries(spark, entry_store)
    if not available:
        return None, devices, False
    ledger, missing = stores.read_ledger(spark, f"{entry_store}/.pointer-ledger.jsonl")
    metas = S.read_metas(spark, root)
    indexed = declared.select(F.col("device").alias("device_id")).union(metas.where(F.col("source_id") != AUTHORED).select("source_id")).distinct()
    return E.evaluate(Workspace(spark, "evaluate"), files, manual_passages(spark, root), indexed, devices, ledger), devices, missing


def validate(spark: SparkSession, root: str, entry_store: str | None = None, inventory: str | None = None) -> tuple[int, list[str]]:
    """(exit code, lines): the view reads back and its rows add up; then the entry store, without writing to it.

    1 for an index that can't be read, a refused entry, or a term that no cited
    section prints.
    """
    manifest, fault = _open(spark, root)
    if fault:
        return 1, [fault]
    try:
        S.load_view(spark, root, manifest)
    except Exception as error:  # reported, whatever it is
        return 1, [f"{manifest['view_dir']}: {error}"]
    rows, model = sum(s["row_count"] for s in manifest["sources"]), manifest["embedding"] or {}
    lines = [f"{manifest['view_dir']}  {len(manifest['sources'])} sources, {rows} passages", f"corpus_revision {manifest['corpus_revision']}", f"embedding {model.get('model')} ({model.get('dim')})"]
    if entry_store is None:
        return 0, lines
    try:
        e, _, missing = _evaluated(spark, root, entry_store, inventory or "")
    except stores.Malformed as error:
        return 1, [*lines, f"failed: {error}"]
    if e is None:
        return 0, [*lines, "the entry store isn't there: nothing to validate"]
    return (1 if e.term_missed() or not e.rejections.isEmpty() else 0), lines + E.store_lines(e, missing)


def run_coverage(spark: SparkSession, root: str, entry_store: str, inventory: str) -> tuple[int, list[str]]:
    """(exit code, lines) of the coverage report. It judges nothing: 1 only if index, inventory or ledger can't be read."""
    _, fault = _open(spark, root)
    if fault:
        return 1, [fault]
    try:
        e, devices, _ = _evaluated(spark, root, entry_store, inventory)
    except stores.Malformed as error:
        return 1, [f"failed: {error}"]
    return 0, ["the entry store isn't there: nothing to report"] if e is None else E.coverage_lines(e, devices)


def inventory_lines(spark: SparkSession, root: str) -> DataFrame:
    manifest = S.read_manifest(spark, root)
    return corpus.inventory(S.load_view(spark, root, manifest)["sources"])
