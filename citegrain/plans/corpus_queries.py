"""Queries over sources, texts, pointers and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.words import canonical
from ..operators import chunking, corpus, entries, layout
from . import tables as X


def _docs(spark, sf_dir):
    return X.table(spark, sf_dir, "documents")


# Texts and ids -----------------------------------------------------------------


def passage_ids(spark, sf_dir):
    """Ids by language as the source, so that equal texts meet and get suffixes."""
    docs = _docs(spark, sf_dir).select(F.col("lang").alias("source_id"), F.col("doc_id").alias("position"), "text")
    return corpus.assign_passage_ids(docs, canonical(F.col("text"))).select(F.col("position").alias("doc_id"), "passage_id")


def citation_header(spark, sf_dir):
    d = _docs(spark, sf_dir)
    number = F.when(F.col("doc_id") % 3 > 0, F.concat((F.col("doc_id") % 7).cast("string"), F.lit("."), (F.col("doc_id") % 5).cast("string")))
    path = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("lang"), F.col("source"))).otherwise(F.array(F.col("lang")))
    return d.select("doc_id", T.citation_header(F.initcap("source"), number, path, F.col("text"), F.col("doc_id") % 4 > 0).alias("header"))


def text_keys(spark, sf_dir):
    """Three of the normal forms side by side: symptom over the whole text, title and furniture over every line, one digest for all lines."""
    lines = F.split("text", "\n")
    number = F.concat((F.col("doc_id") % 9).cast("string"), F.lit(".2 "))
    digest = lambda key: F.sha2(F.array_join(F.transform(lines, key), "\n"), 256)
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.symptom_key(F.col("text")), 256).alias("symptom"), digest(lambda x: T.title_key(F.concat(number, x))).alias("title"), digest(T.furniture_key).alias("furniture"))


def entry_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.entry_key(F.col("text"), F.array("source", "lang", "source")).alias("entry_key"))


def first_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


def section_numbers(spark, sf_dir):
    shape = F.concat(F.when(F.col("p_partkey") % 4 == 0, F.lit("")).when(F.col("p_partkey") % 4 == 1, F.concat((F.col("p_size") % 30).cast("string"), F.lit(".1 "))).otherwise(F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(".2.3) "))), F.col("p_name"))
    return X.table(spark, sf_dir, "part").select("p_partkey", T.section_number(shape).alias("s")).select("p_partkey", F.coalesce("s.number", F.lit("none")).alias("number"), "s.title")


def contents_lines(spark, sf_dir):
    line = F.concat((F.col("p_size") % 9).cast("string"), F.lit(".1 "), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.lit(" ...... ")), F.col("p_size").cast("string"))
    return X.table(spark, sf_dir, "part").select("p_partkey", T.contents_line(line).alias("c")).where("c IS NOT NULL").select("p_partkey", "c.number", "c.title", "c.page")


def filename_grammar(spark, sf_dir):
    """Names made of parts: some break the grammar, some claim one id."""
    brand, kind = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lower(F.replace("p_type", F.lit(" "), F.lit("-")))
    good = F.concat(brand, F.lit("_"), kind, F.lit("_guide_v"), (F.col("p_size") % 4).cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string"), F.lit("_en.pdf"))
    name = F.when(F.col("p_partkey") % 11 == 0, F.upper(good)).when(F.col("p_partkey") % 13 == 0, F.replace(good, F.lit("_en"), F.lit("_eng"))).when(F.col("p_partkey") % 17 == 0, F.replace(good, F.lit(".pdf"), F.lit(".txt"))).otherwise(good)
    files = X.table(spark, sf_dir, "part").select(name.alias("name")).distinct().withColumn("store", F.lit("manuals"))
    found = corpus.classify_files(files)
    return found.select("name", F.coalesce("source_id", F.lit("none")).alias("source_id"), F.coalesce("reason", F.lit("ok")).alias("reason"), F.coalesce(T.identity_filename(F.col("identity")), F.lit("none")).alias("rebuilt"))


def term_containment(spark, sf_dir):
    """How many documents print each item's first two words as a term; items meet documents by the first of them."""
    terms = X.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 2), " ").alias("term"))
    keyed = terms.withColumn("word", F.regexp_extract("term", r"[0-9A-Za-z]+", 0))
    words = _docs(spark, sf_dir).select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z]+"), F.lit(0)))).alias("word"))
    hits = words.join(keyed, "word").where(T.contains_term(F.col("term"), F.col("text")))
    return hits.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("documents"))


def numeric_terms(spark, sf_dir):
    """Numbers in prose. RE2 has no look-behind, so there is no SQL; tests compare with Python."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.numeric_literals(F.col("text"))).alias("at", "literal"))


# Layout rules on lines of documents ------------------------------------------------


def low_text(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text", F.lit(1).alias("page_count"))
    return layout.low_text(d).select(F.col("doc").alias("doc_id"), "low")


def _printed(spark, sf_dir):
    """Documents as pages of their source, line by line: most pages have a running head, some a page number, and a line's length decides its font."""
    d = _docs(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "said"))
    text = F.when((F.col("line") == 0) & (F.col("page") % 4 > 0), F.concat(F.lit("Guide "), "doc")).when((F.col("line") == 1) & (F.col("page") % 3 == 0), F.col("page").cast("string")).otherwise(F.col("said"))
    font = F.when(F.length("text") % 7 == 0, "ABCDEF+Wingdings3").when(F.col("line") == 0, "Head").otherwise("Body")
    d = d.select("doc", "page", F.lit(1).alias("page_count"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(0).alias("block"), "line", text.alias("text"))
    d = d.withColumns({"x0": F.lit(50.0), "y0": 10.0 + 12 * F.col("line"), "x1": F.lit(300.0), "y1": 18.0 + 12 * F.col("line"), "font": font, "size": F.when(F.col("line") == 0, 14.0).otherwise(9.0), "furniture": F.lit(False)})
    return d.withColumn("spans", F.array(F.struct("text", "font", "size")))


def unmappable_ratio(spark, sf_dir):
    """The glyph audit of each source: letters of a symbol font are repaired or lost, and over two hundredths lost is unreadable."""
    a = layout.glyph_audit(_printed(spark, sf_dir))
    return a.select("doc", "spans_repaired", "spans_degraded", F.round("ratio", 9).alias("ratio"), "unreadable")


def furniture_lines(spark, sf_dir):
    """Running heads and page numbers: keys in the bands that are on most of a source's pages at one height."""
    return layout.mark_furniture(_printed(spark, sf_dir)).where("furniture").select("doc", "page", "line")


def body_style_mode_median(spark, sf_dir):
    """The style of most of a source's lines, and their median length."""
    return layout.body_style(_printed(spark, sf_dir)).select("doc", "font", "size", "line_length")


def heading_styles(spark, sf_dir):
    """The largest style above the body's that is used like headings."""
    return layout.heading_style(_printed(spark, sf_dir)).select("doc", "font", "size", "count")


def text_layers(spark, sf_dir):
    return layout.has_text_layer(_printed(spark, sf_dir)).select("doc", "has_text")


def page_ranges(spark, sf_dir):
    pages = _docs(spark, sf_dir).where("lang = 'en'").select("source", F.expr("doc_id div 20").alias("page"))
    return corpus.page_ranges(pages, "source")


def language_inherit(spark, sf_dir):
    """Short documents take the verdict of the nearest long one in their source: above first, then below."""
    verdict = F.when(F.col("n_chars") >= 400, F.col("lang") == "en")
    rows = _docs(spark, sf_dir).select("source", "doc_id", verdict.alias("verdict"))
    return corpus.inherit_nearest(rows, "source", "doc_id", "verdict").select("doc_id", "resolved")


def anchor_regions(spark, sf_dir):
    """The half-open interval join: each event of a user in the region its last click began; -1 before the first."""
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.unix_micros(F.col("ts").cast("timestamp")).alias("page"), F.lit(0.0).alias("y0"), F.col("event_id").cast("double").alias("x0"), "event_type", F.col("event_id").cast("int").alias("block"), F.lit(0).alias("line"))
    marks = e.where("event_type = 'click'").withColumn("region", F.col("block"))
    return layout.region_of_line(e, marks).select(F.col("block").cast("long").alias("event_id"), F.col("region").cast("long").alias("region"))


# Sources and versions -------------------------------------------------------------


def _sources(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("chunk_count"), F.sha2(F.concat(F.sum("n_chars").cast("string"), F.lit("|"), F.max("doc_id").cast("string")), 256).alias("fingerprint"))


def row_slices(spark, sf_dir):
    return corpus.source_slices(_sources(spark, sf_dir).select("source_id", F.col("chunk_count").alias("row_count")))


def corpus_revision(spark, sf_dir):
    return corpus.corpus_revision(_sources(spark, sf_dir))


def shard_reuse_plan(spark, sf_dir):
    """Against an earlier run in which some sources differed, some had no embedding, and some weren't there."""
    now = _sources(spark, sf_dir).select("source_id", "fingerprint", F.lit(1).alias("ingestion_version"), F.lit("m").alias("model"), F.lit(64).alias("dim"), F.lit(True).alias("normalised"))
    n = F.substring("source_id", 4, 2).cast("int")
    old = now.where(n % 5 != 0).withColumns({"fingerprint": F.when(n % 4 == 0, F.lit("changed")).otherwise(F.col("fingerprint")), "model": F.when(n % 7 != 0, F.col("model"))})
    return corpus.reuse_plan(now, old)


def _supplier_stores(spark, sf_dir):
    s = X.table(spark, sf_dir, "supplier")
    store = F.when(F.col("s_suppkey") % 2 == 0, "manuals").otherwise("triage")
    committed = s.where("s_suppkey % 5 <> 0").select(store.alias("store"), F.col("s_name").alias("source_id"))
    discovered = s.where("s_suppkey % 3 <> 0").select(store.alias("store"), F.col("s_name").alias("source_id"))
    return committed, discovered


def removed_sources(spark, sf_dir):
    """The second store can't be read, so nothing of it goes."""
    committed, discovered = _supplier_stores(spark, sf_dir)
    stores = spark.createDataFrame([("manuals", True), ("triage", False)], "store string, available boolean")
    return corpus.absent_sources(committed, discovered, stores)


def store_anomalies(spark, sf_dir):
    committed, discovered = _supplier_stores(spark, sf_dir)
    return corpus.store_anomalies(discovered, committed)


def contested_ids(spark, sf_dir):
    s = X.table(spark, sf_dir, "supplier")
    both = s.select(F.lit("manuals").alias("store"), F.concat(F.lit("id"), (F.col("s_suppkey") % 40).cast("string")).alias("source_id")).where("s_suppkey % 2 = 0").union(s.select(F.lit("triage"), F.concat(F.lit("id"), (F.col("s_suppkey") % 30).cast("string"))).where("s_suppkey % 3 = 0"))
    return corpus.contested_ids(both).select("store", "source_id", F.array_join("stores", ",").alias("stores"))


def _inventory(spark, sf_dir):
    devices = X.table(spark, sf_dir, "nation").select(F.col("n_name").alias("device_id"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" MK"), F.col("n_regionkey").cast("string"))).alias("revision"), F.initcap("n_name").alias("display_name"))
    s = X.table(spark, sf_dir, "supplier").join(X.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    device = F.when(F.col("s_suppkey") % 6 == 0, F.lit("unowned")).otherwise(F.col("n_name"))
    revision = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("mk"), F.col("n_regionkey").cast("string")))
    sources = s.select(F.col("s_name").alias("source_id"), F.col("s_name").alias("display_name"), F.when(F.col("s_suppkey") % 7 == 0, "authored-triage").otherwise("vendor-manual").alias("kind"), device.alias("device"), revision.alias("revision"), F.when(F.col("s_suppkey") % 3 == 0, "assumed").otherwise("confirmed").alias("status"))
    return devices, sources


def gap_undocumented(spark, sf_dir):
    devices, sources = _inventory(spark, sf_dir)
    return corpus.owned_but_undocumented(devices, sources).select("device_id")


def gap_unconfirmed(spark, sf_dir):
    devices, sources = _inventory(spark, sf_dir)
    found = corpus.documented_but_unconfirmed(devices, sources)
    return found.select("source_id", "device_id", "status", F.coalesce("declared_revision", F.lit("")).alias("declared"), F.coalesce("owned_revision", F.lit("")).alias("owned"))


def gap_not_owned(spark, sf_dir):
    return corpus.indexed_but_not_owned(*_inventory(spark, sf_dir))


def applied_declarations(spark, sf_dir):
    _, sources = _inventory(spark, sf_dir)
    declared = sources.where("substring(source_id, -1) IN ('1', '4', '7')").select("source_id", F.lit("declared").alias("device"), F.lit("9").alias("revision"), F.lit("confirmed").alias("status"))
    return corpus.with_applicability(sources, declared).select("source_id", "device", F.coalesce("revision", F.lit("")).alias("revision"), "status")


def inventory_table(spark, sf_dir):
    _, sources = _inventory(spark, sf_dir)
    s = sources.withColumns({"vendor": F.substring("source_id", 1, 3), "lang": F.lit("en")})
    return corpus.inventory(s).select("source_id", "kind", "vendor", "lang")


# Pointers and entries ----------------------------------------------------------------


def _sections(spark, sf_dir):
    p = X.table(spark, sf_dir, "part").where("p_partkey % 3 > 0")
    number = F.when(F.col("p_partkey") % 2 == 0, F.concat((F.col("p_partkey") % 50).cast("string"), F.lit("."), (F.col("p_size") % 6).cast("string")))
    title = F.concat(F.when(F.col("p_partkey") % 5 == 0, F.lit("3.1 ")).otherwise(F.lit("")), F.initcap("p_name"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.lit("")), F.lit("."))
    return p.select(F.lower("p_brand").alias("source_id"), number.alias("section_number"), title.alias("section_title"), F.col("p_partkey").alias("row_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("passage_id"))


def _pointers(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    source = F.when(k % 19 == 0, "authored/triage").when(k % 23 == 0, "nowhere").otherwise(F.lower("p_brand"))
    number = F.when(k % 3 == 0, F.concat((k % 50).cast("string"), F.lit("."), (F.col("p_size") % 6).cast("string")))
    title = F.when(k % 6 == 0, None).when(k % 4 == 0, F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))).when(k % 7 == 0, F.split("p_name", " ")[0]).otherwise(F.col("p_name"))
    return p.select(k.alias("pid"), source.alias("source_id"), number.alias("number"), title.alias("title"))


def pointer_resolution(spark, sf_dir):
    found = entries.resolve_pointers(_pointers(spark, sf_dir), entries.sections_of(_sections(spark, sf_dir)), suggest=False)
    return found.select("pid", F.coalesce(F.array_join("passage_ids", ","), F.lit("")).alias("passages"), F.coalesce("reason", F.lit("ok")).alias("reason"), "disagrees")


def pointer_states(spark, sf_dir):
    """Against a ledger that knows every second pointer."""
    found = entries.resolve_pointers(_pointers(spark, sf_dir), entries.sections_of(_sections(spark, sf_dir)), suggest=False)
    ledger = _pointers(spark, sf_dir).where("pid % 2 = 0 AND (number IS NOT NULL OR title IS NOT NULL)").select(T.pointer_key(F.struct("source_id", "number", "title")).alias("pointer"))
    return entries.check_pointers(found, ledger).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def ledger_update(spark, sf_dir):
    """A ledger after a run: rows move only where the passages changed, and none is lost."""
    o = X.table(spark, sf_dir, "orders")
    key = F.concat(F.lit("k"), (F.col("o_orderkey") % 500).cast("string"))
    old = o.where("o_custkey % 2 = 0").groupBy(key.alias("pointer")).agg(F.lit("t0").alias("resolved_at"), F.array(F.min("o_custkey").cast("string")).alias("passage_ids"), F.array(F.lit("e")).alias("entry_keys"))
    new = o.groupBy(key.alias("pointer")).agg(F.array(F.min("o_custkey").cast("string")).alias("passage_ids")).withColumn("entry_key", F.lit("f"))
    done = entries.update_ledger(old, new, "t1")
    return done.select("pointer", "resolved_at", F.array_join("passage_ids", ",").alias("passages"), F.array_join("entry_keys", ",").alias("entries"))


def duplicate_symptoms(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_file"), F.col("text").alias("symptom"), F.array("source", "lang").alias("device_ids"))
    return entries.duplicate_symptoms(d).select("source_file", "other", "files", F.array_join("shared", ",").alias("shared"))


def scope_findings(spark, sf_dir):
    """Entries from suppliers: devices by nation, claims on every fourth."""
    devices, _ = _inventory(spark, sf_dir)
    indexed = devices.where("device_id < 'K'").select("device_id")
    s = X.table(spark, sf_dir, "supplier").join(X.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ref = lambda i, r: F.struct(i.alias("id"), r.cast("string").alias("revision"))
    listed = F.array(ref(F.when(F.col("s_suppkey") % 5 == 0, F.lit("gone")).otherwise(F.col("n_name")), F.when(F.col("s_suppkey") % 3 == 0, F.lit("mk-1"))), ref(F.when(F.col("s_suppkey") % 10 == 0, F.lit("lost")).otherwise(F.lit("JAPAN")), F.lit(None)))
    claim = F.when(F.col("s_suppkey") % 4 == 0, F.col("n_name"))
    e = s.select(F.col("s_name").alias("source_file"), listed.alias("devices"), F.array(F.struct(claim.alias("undocumented"))).alias("causes"))
    return entries.scope_findings(e, devices, indexed)


def view_sections_search(spark, sf_dir):
    p = _docs(spark, sf_dir).select(F.col("source").alias("source_id"), F.concat(F.lit("S"), (F.col("doc_id") % 10).cast("string")).alias("section_title"), X.passage_id().alias("passage_id"), "text")
    return corpus.search_sections(p, "License")


def latency_percentiles(spark, sf_dir):
    return corpus.nearest_rank(X.table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "count", F.round("result", 6).alias("p95"))


def chunk_pack(spark, sf_dir):
    """Documents as regions, their lines as units; compared with plain Python in tests."""
    d = _docs(spark, sf_dir).select(F.col("source").alias("source_id"), F.col("doc_id").cast("int").alias("region"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    units = d.withColumns({"page_start": (F.col("region") % 9 + 1).cast("int"), "page_end": (F.col("region") % 9 + 1).cast("int"), "atomic": F.col("position") % 5 == 4, "repeats": F.col("position") == 0})
    return chunking.pack_regions(units)


_FUNCTIONS = (
    passage_ids, citation_header, text_keys, entry_keys, first_sentences, section_numbers, contents_lines, filename_grammar, term_containment, numeric_terms,
    low_text, unmappable_ratio, furniture_lines, page_ranges, language_inherit, body_style_mode_median, heading_styles, text_layers, anchor_regions, row_slices, corpus_revision, shard_reuse_plan,
    removed_sources, store_anomalies, contested_ids, gap_undocumented, gap_unconfirmed, gap_not_owned, applied_declarations, inventory_table, pointer_resolution,
    pointer_states, ledger_update, duplicate_symptoms, scope_findings, view_sections_search, latency_percentiles, chunk_pack,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_FOLD = "replace(lower({}), 'ß', 'ss')"
_WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _fold(x: str) -> str:
    return _FOLD.format(x)


def _title(x: str) -> str:
    bare = rf"regexp_replace(trim({x}), '^\d+(\.\d+)*\.?\s+', '')"
    return _fold(rf"regexp_replace({_WS.format(bare)}, '[\s.,:;!?…]+$', '')")


_SOURCES = "s AS (SELECT source AS source_id, count(*) AS chunk_count, sha256(CAST(sum(n_chars) AS VARCHAR) || '|' || CAST(max(doc_id) AS VARCHAR)) AS fingerprint FROM documents GROUP BY source)"
_STORES = """
committed AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'manuals' ELSE 'triage' END AS store, s_name AS source_id FROM supplier WHERE s_suppkey % 5 <> 0),
discovered AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'manuals' ELSE 'triage' END AS store, s_name AS source_id FROM supplier WHERE s_suppkey % 3 <> 0)"""
_INVENTORY = """
devices AS (SELECT n_name AS device_id, CASE WHEN n_nationkey % 3 = 0 THEN ' MK' || n_regionkey END AS revision FROM nation),
sources AS (
  SELECT s_name AS source_id, CASE WHEN s_suppkey % 7 = 0 THEN 'authored-triage' ELSE 'vendor-manual' END AS kind, CASE WHEN s_suppkey % 6 = 0 THEN 'unowned' ELSE n_name END AS device,
    CASE WHEN s_suppkey % 2 = 0 THEN 'mk' || n_regionkey END AS revision, CASE WHEN s_suppkey % 3 = 0 THEN 'assumed' ELSE 'confirmed' END AS status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_PRINTED = """
said AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS said, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line FROM documents),
texts AS (SELECT doc, page, line, CASE WHEN line = 0 AND page % 4 > 0 THEN 'Guide ' || doc WHEN line = 1 AND page % 3 = 0 THEN CAST(page AS VARCHAR) ELSE said END AS text FROM said),
lines AS (SELECT *, CAST(10 + 12 * line AS DOUBLE) AS y0, CAST(18 + 12 * line AS DOUBLE) AS y1, CASE WHEN length(text) % 7 = 0 THEN 'ABCDEF+Wingdings3' WHEN line = 0 THEN 'Head' ELSE 'Body' END AS font, CASE WHEN line = 0 THEN 14.0::DOUBLE ELSE 9.0 END AS size FROM texts)"""
_BODY = rf"""
styles AS (SELECT doc, font, size, count(*) AS n, min((page, line)) AS seen, median(length({_WS.format('text')})) AS line_length FROM lines WHERE trim(text) <> '' GROUP BY doc, font, size),
body AS (SELECT * FROM styles QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, seen) = 1)"""
_INITCAP = "array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split({}, ' ')], ' ')"
_POINTERS = f"""
sec0 AS (
  SELECT lower(p_brand) AS source_id, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 50) || '.' || (p_size % 6) END AS number,
    CASE WHEN p_partkey % 5 = 0 THEN '3.1 ' ELSE '' END || {_INITCAP.format('p_name')} || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_size ELSE '' END || '.' AS title, p_partkey AS row_id FROM part WHERE p_partkey % 3 > 0),
sec AS (SELECT source_id, number, title, min(row_id) AS first, string_agg('p' || row_id, ',' ORDER BY row_id) AS ids, {_title('title')} AS key FROM sec0 GROUP BY source_id, number, title),
known AS (SELECT DISTINCT source_id FROM sec),
num AS (SELECT source_id, number, arg_max(ids, first) AS ids, arg_max(title, first) AS title FROM sec WHERE number IS NOT NULL GROUP BY ALL),
ttl AS (SELECT source_id, key, count(*) AS hits, any_value(ids) AS ids FROM sec GROUP BY ALL),
ptr AS (
  SELECT p_partkey AS pid, CASE WHEN p_partkey % 19 = 0 THEN 'authored/triage' WHEN p_partkey % 23 = 0 THEN 'nowhere' ELSE lower(p_brand) END AS source_id,
    CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 50) || '.' || (p_size % 6) END AS number,
    CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN p_name || ' ' || p_size WHEN p_partkey % 7 = 0 THEN string_split(p_name, ' ')[1] ELSE p_name END AS title FROM part),
ptk AS (SELECT *, {_title('title')} AS key FROM ptr),
pre AS (SELECT pid, count(*) AS hits, any_value(sec.ids) AS ids FROM ptk JOIN sec ON sec.source_id = ptk.source_id AND starts_with(sec.key, ptk.key) WHERE ptk.number IS NULL AND NOT EXISTS (SELECT 1 FROM ttl WHERE ttl.source_id = ptk.source_id AND ttl.key = ptk.key) GROUP BY pid),
res AS (
  SELECT ptk.*, CASE WHEN ptk.source_id = 'authored/triage' THEN NULL WHEN ptk.number IS NOT NULL THEN num.ids WHEN ttl.hits = 1 THEN ttl.ids WHEN ttl.hits IS NULL AND pre.hits = 1 THEN pre.ids END AS ids,
    known.source_id IS NULL AS unknown, ttl.hits AS th, pre.hits AS ph, coalesce(ptk.number IS NOT NULL AND ptk.title IS NOT NULL AND {_title('num.title')} <> ptk.key, false) AS disagrees
  FROM ptk LEFT JOIN known USING (source_id) LEFT JOIN num ON num.source_id = ptk.source_id AND num.number = ptk.number LEFT JOIN ttl ON ttl.source_id = ptk.source_id AND ttl.key = ptk.key LEFT JOIN pre ON pre.pid = ptk.pid),
why AS (SELECT *, CASE WHEN source_id = 'authored/triage' THEN 'authored-target' WHEN unknown THEN 'unknown-source' WHEN ids IS NOT NULL THEN 'ok' WHEN number IS NULL AND (th > 1 OR ph > 1) THEN 'ambiguous-title' ELSE 'no-such-section' END AS reason FROM res)"""

ORACLES = {
    "passage_ids": r"""WITH d AS (SELECT doc_id, lang, lang || '#' || substr(sha256(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))), 1, 16) AS base FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, base ORDER BY doc_id) AS k FROM d) SELECT doc_id, CASE WHEN k > 1 THEN base || '.' || k ELSE base END AS passage_id FROM n""",
    "citation_header": """SELECT doc_id, upper(source[1]) || source[2:] || ' — ' || CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 3 > 0 THEN '§' || (doc_id % 7) || '.' || (doc_id % 5) || ' ' ELSE '' END || lang || ' › ' || CASE WHEN doc_id % 2 = 0 THEN source || ' › ' ELSE '' END ELSE '' END || text AS header FROM documents""",
    "text_keys": rf"""SELECT doc_id, sha256({_fold(_WS.format('text'))}) AS symptom, sha256(array_to_string([{_title("(doc_id % 9) || '.2 ' || line")} for line in string_split(text, chr(10))], chr(10))) AS title,
  sha256(array_to_string([regexp_replace({_fold(_WS.format('line'))}, '[0-9]+', '#', 'g') for line in string_split(text, chr(10))], chr(10))) AS furniture FROM documents""",
    "entry_keys": rf"""SELECT doc_id, sha256({_fold(_WS.format('text'))} || chr(10) || least(source, lang) || chr(10) || greatest(source, lang)) AS entry_key FROM documents""",
    "first_sentences": rf"""WITH f AS (SELECT doc_id, {_WS.format('text')} AS flat FROM documents) SELECT doc_id, CASE WHEN flat <> '' THEN CASE WHEN regexp_matches(flat, '[.!?] ') THEN regexp_extract(flat, '^(.*?[.!?]) ', 1) ELSE flat END END AS sentence FROM f""",
    "section_numbers": r"""WITH p AS (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN (p_size % 30) || '.1' ELSE p_size || '.2.3' END AS number FROM part) SELECT p_partkey, coalesce(number, 'none') AS number, p_name AS title FROM p""",
    "contents_lines": "SELECT p_partkey, (p_size % 9) || '.1' AS number, p_name AS title, p_size AS page FROM part WHERE p_partkey % 3 > 0",
    "filename_grammar": r"""WITH g AS (SELECT p_partkey, lower(replace(p_brand, '#', '-')) || '_' || lower(replace(p_type, ' ', '-')) || '_guide_v' || (p_size % 4) || '.' || (p_partkey % 3) || '_en.pdf' AS good FROM part),
n AS (SELECT DISTINCT CASE WHEN p_partkey % 11 = 0 THEN upper(good) WHEN p_partkey % 13 = 0 THEN replace(good, '_en', '_eng') WHEN p_partkey % 17 = 0 THEN replace(good, '.pdf', '.txt') ELSE good END AS name FROM g),
i AS (SELECT name, regexp_extract(name, '^([a-z0-9]+(?:-[a-z0-9]+)*_[a-z0-9]+(?:-[a-z0-9]+)*)_[a-z0-9]+(?:-[a-z0-9]+)*_v[0-9]+(?:\.[0-9]+)*_(?:[a-z]{2}|multi)\.pdf$', 1) AS ok FROM n WHERE lower(name) LIKE '%.pdf'),
c AS (SELECT *, count(*) OVER (PARTITION BY ok) AS k FROM i)
SELECT name, CASE WHEN ok = '' THEN 'none' ELSE replace(ok, '_', '/') END AS source_id, CASE WHEN ok = '' THEN 'filename-invalid' WHEN k > 1 THEN 'source-id-collision' ELSE 'ok' END AS reason, CASE WHEN ok = '' THEN 'none' ELSE name END AS rebuilt FROM c""",
    "term_containment": r"""WITH t AS (SELECT item_id, array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 2), ' ') AS term FROM benchmark),
r AS (SELECT item_id, term, '(?:^|[^0-9A-Za-z])' || array_to_string([regexp_escape(x) for x in string_split(term, ' ')], '\s+') || '(?:$|[^0-9A-Za-z])' AS pattern FROM t)
SELECT item_id, term, count(*) AS documents FROM r JOIN documents d ON regexp_matches(d.text, pattern) GROUP BY item_id, term""",
    "low_text": r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) < 50 AS low FROM documents",
    "unmappable_ratio": rf"""WITH {_PRINTED}, g AS (SELECT doc, length(text) AS chars, CASE WHEN font LIKE '%Wingdings3' THEN len(regexp_extract_all(text, '[ðñôõ]')) ELSE 0 END AS fixed,
  CASE WHEN font LIKE '%Wingdings3' THEN len(regexp_extract_all(text, '[^\x00-\x7F]')) - len(regexp_extract_all(text, '[^\x00-\x7F\p{{L}}]')) ELSE 0 END AS odd FROM lines)
SELECT doc, count(*) FILTER (fixed > 0) AS spans_repaired, count(*) FILTER (odd > fixed) AS spans_degraded, round(sum(odd - fixed) / sum(chars), 9) AS ratio, sum(odd - fixed) / sum(chars) > 0.02 AS unreadable FROM g GROUP BY doc""",
    "furniture_lines": rf"""WITH {_PRINTED}, b AS (SELECT doc, page, line, regexp_replace({_fold(_WS.format('text'))}, '[0-9]+', '#', 'g') AS key, CASE WHEN y1 <= 64 THEN y0 / 800 ELSE (800 - y1) / 800 END AS offs FROM lines WHERE trim(text) <> '' AND (y1 <= 64 OR y0 >= 736)),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM lines GROUP BY doc),
k AS (SELECT doc, key, count(DISTINCT page) AS n, max(offs) - min(offs) AS drift FROM b GROUP BY doc, key)
SELECT b.doc, b.page, b.line FROM b JOIN k ON k.doc = b.doc AND k.key = b.key JOIN p ON p.doc = b.doc WHERE n >= 2 AND (k.key = '#' OR ((n >= 0.6 * pages OR (pages <= 10 AND n >= 5)) AND drift <= 0.02))""",
    "body_style_mode_median": rf"WITH {_PRINTED}, {_BODY} SELECT doc, font, size, line_length FROM body",
    "heading_styles": rf"""WITH {_PRINTED}, {_BODY}, n AS (SELECT doc, page, dense_rank() OVER (PARTITION BY doc ORDER BY page) AS i FROM (SELECT DISTINCT doc, page FROM lines)), p AS (SELECT doc, count(*) AS pages FROM n GROUP BY doc),
t AS (SELECT l.doc, l.font, l.size, count(*) AS count, max(i) - min(i) + 1 AS spread FROM lines l JOIN body b ON b.doc = l.doc JOIN n ON n.doc = l.doc AND n.page = l.page
  WHERE trim(text) <> '' AND l.size > b.size AND length({_WS.format('text')}) < 0.6 * b.line_length AND NOT ends_with({_WS.format('text')}, '.') GROUP BY l.doc, l.font, l.size),
r AS (SELECT t.*, row_number() OVER (PARTITION BY t.doc ORDER BY size DESC, font) AS k FROM t JOIN p ON p.doc = t.doc WHERE count >= 4 AND spread >= 0.4 * pages AND count >= pages / 10)
SELECT doc, font, size, count FROM r WHERE k = 1""",
    "text_layers": rf"WITH {_PRINTED} SELECT doc, bool_or({_WS.format('text')} <> '') AS has_text FROM lines GROUP BY doc",
    "page_ranges": """WITH p AS (SELECT DISTINCT source, doc_id // 20 AS page FROM documents WHERE lang = 'en'), i AS (SELECT *, page - row_number() OVER (PARTITION BY source ORDER BY page) AS island FROM p)
SELECT source, min(page) AS lo, max(page) AS hi FROM i GROUP BY source, island""",
    "language_inherit": """WITH v AS (SELECT source, doc_id, CASE WHEN n_chars >= 400 THEN lang = 'en' END AS verdict FROM documents)
SELECT doc_id, coalesce(last_value(verdict IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(verdict IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), true) AS resolved FROM v""",
    "anchor_regions": """SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS region FROM events""",
    "row_slices": f"WITH {_SOURCES} SELECT source_id, CAST(coalesce(sum(chunk_count) OVER (ORDER BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_start, chunk_count AS row_count FROM s",
    "corpus_revision": f"""WITH {_SOURCES} SELECT sha256('[' || string_agg('["' || source_id || '","' || fingerprint || '",' || chunk_count || ']', ',' ORDER BY source_id) || ']') AS revision FROM s""",
    "shard_reuse_plan": f"WITH {_SOURCES}, n AS (SELECT *, CAST(substr(source_id, 4, 2) AS INT) AS n FROM s) SELECT source_id, CASE WHEN n % 5 <> 0 AND n % 4 <> 0 AND n % 7 <> 0 THEN 'reuse' ELSE 'build' END AS action FROM n",
    "removed_sources": f"WITH {_STORES} SELECT * FROM committed c WHERE store = 'manuals' AND NOT EXISTS (SELECT 1 FROM discovered d WHERE d.store = c.store AND d.source_id = c.source_id)",
    "store_anomalies": f"WITH {_STORES} SELECT coalesce(d.store, c.store) AS store, coalesce(d.source_id, c.source_id) AS source_id, CASE WHEN c.store IS NULL THEN 'not-indexed' ELSE 'not-in-store' END AS anomaly FROM discovered d FULL JOIN committed c ON d.store = c.store AND d.source_id = c.source_id WHERE d.store IS NULL OR c.store IS NULL",
    "contested_ids": "WITH u AS (SELECT DISTINCT 'manuals' AS store, 'id' || (s_suppkey % 40) AS source_id FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT 'triage', 'id' || (s_suppkey % 30) FROM supplier WHERE s_suppkey % 3 = 0), c AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS k FROM u) SELECT store, source_id, 'manuals,triage' AS stores FROM c WHERE k > 1",
    "gap_undocumented": f"WITH {_INVENTORY} SELECT device_id FROM devices WHERE device_id NOT IN (SELECT device FROM sources WHERE kind = 'vendor-manual')",
    "gap_unconfirmed": f"WITH {_INVENTORY} SELECT source_id, device_id, status, coalesce(s.revision, '') AS declared, coalesce(d.revision, '') AS owned FROM sources s JOIN devices d ON s.device = d.device_id WHERE NOT (status = 'confirmed' AND lower(trim(coalesce(s.revision, ''))) = lower(trim(coalesce(d.revision, ''))))",
    "gap_not_owned": f"WITH {_INVENTORY} SELECT source_id FROM sources WHERE kind = 'vendor-manual' AND device NOT IN (SELECT device_id FROM devices)",
    "applied_declarations": f"WITH {_INVENTORY}, t AS (SELECT *, kind <> 'authored-triage' AND right(source_id, 1) IN ('1', '4', '7') AS take FROM sources) SELECT source_id, CASE WHEN take THEN 'declared' ELSE device END AS device, CASE WHEN take THEN '9' ELSE coalesce(revision, '') END AS revision, CASE WHEN take THEN 'confirmed' ELSE status END AS status FROM t",
    "inventory_table": f"WITH {_INVENTORY} SELECT source_id, kind, CASE WHEN kind = 'authored-triage' THEN 'not applicable' ELSE substr(source_id, 1, 3) END AS vendor, CASE WHEN kind = 'authored-triage' THEN 'not applicable' ELSE 'en' END AS lang FROM sources",
    "pointer_resolution": f"WITH {_POINTERS} SELECT pid, coalesce(ids, '') AS passages, reason, disagrees FROM why",
    "pointer_states": f"""WITH {_POINTERS}, k AS (SELECT *, CASE WHEN number IS NOT NULL THEN source_id || ' §' || number ELSE source_id || ' "' || key || '"' END AS pointer FROM why),
l AS (SELECT DISTINCT pointer FROM k WHERE pid % 2 = 0 AND (number IS NOT NULL OR title IS NOT NULL))
SELECT CASE WHEN reason = 'ok' THEN 'ok' WHEN reason <> 'authored-target' AND l.pointer IS NOT NULL THEN 'drifted' ELSE 'rejected' END AS state, count(*) AS n FROM k LEFT JOIN l ON k.pointer = l.pointer GROUP BY 1""",
    "ledger_update": """WITH o AS (SELECT 'k' || (o_orderkey % 500) AS pointer, o_custkey FROM orders),
a AS (SELECT pointer, CAST(min(o_custkey) AS VARCHAR) AS ids FROM o WHERE o_custkey % 2 = 0 GROUP BY pointer), b AS (SELECT pointer, CAST(min(o_custkey) AS VARCHAR) AS ids FROM o GROUP BY pointer)
SELECT coalesce(a.pointer, b.pointer) AS pointer, CASE WHEN a.ids = b.ids OR b.ids IS NULL THEN 't0' ELSE 't1' END AS resolved_at, coalesce(b.ids, a.ids) AS passages, CASE WHEN a.ids = b.ids OR b.ids IS NULL THEN 'e' ELSE 'f' END AS entries FROM a FULL JOIN b ON a.pointer = b.pointer""",
    "duplicate_symptoms": rf"""WITH e AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS f, {_fold(_WS.format('text'))} AS k, unnest([source, lang]) AS device FROM documents),
g AS (SELECT k, device, count(*) AS n, min(f) AS a, max(f) AS b FROM e GROUP BY k, device HAVING count(*) > 1)
SELECT f AS source_file, min(CASE WHEN f = a THEN b ELSE a END) AS other, max(n) AS files, string_agg(device, ',' ORDER BY device) AS shared FROM e JOIN g USING (k, device) GROUP BY f""",
    "scope_findings": f"""WITH {_INVENTORY}, idx AS (SELECT device_id FROM devices WHERE device_id < 'K'),
e AS (SELECT s_name AS f, s_suppkey AS k, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT f, k, CASE WHEN k % 5 = 0 THEN 'gone' ELSE n_name END AS id, CASE WHEN k % 3 = 0 THEN 'mk-1' END AS revision FROM e UNION ALL SELECT f, k, CASE WHEN k % 10 = 0 THEN 'lost' ELSE 'JAPAN' END, NULL FROM e),
j AS (SELECT m.f, m.id, m.revision, d.device_id IS NOT NULL AS rig, d.revision AS held, i.device_id IS NOT NULL AS ind FROM m LEFT JOIN devices d ON d.device_id = m.id LEFT JOIN idx i ON i.device_id = m.id),
a AS (SELECT *, bool_and(NOT rig AND NOT ind) OVER (PARTITION BY f) AS every FROM j)
SELECT f AS source_file, CASE WHEN every THEN 'all-devices-unrecognised' ELSE 'unknown-device' END AS finding, id AS device, every AS rejects FROM a WHERE every OR (NOT rig AND NOT ind)
UNION ALL SELECT f, 'undocumented-device-scope', id, false FROM a WHERE rig AND NOT ind
UNION ALL SELECT f, 'revision-mismatch', id, false FROM a WHERE rig AND revision IS NOT NULL AND regexp_replace(lower(revision), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(coalesce(held, '')), '[^a-z0-9]', '', 'g')
UNION ALL SELECT f, 'undocumented-claim-invalid', n_name, true FROM e WHERE k % 4 = 0 AND (n_name IN (SELECT device_id FROM idx) OR n_name NOT IN (SELECT device_id FROM devices))""",
    "view_sections_search": """WITH h AS (SELECT source AS source_id, 'S' || (doc_id % 10) AS section_title, source || '#' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS passage_id, text FROM documents WHERE contains(lower(text), 'license')),
f AS (SELECT *, row_number() OVER (PARTITION BY source_id, section_title ORDER BY passage_id) AS n FROM h), s AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS in_source FROM f WHERE n = 1)
SELECT source_id, section_title, passage_id, substr(text, CAST(greatest(strpos(lower(text), 'license') - 30, 1) AS BIGINT), 90) AS excerpt, in_source FROM s ORDER BY source_id, section_title LIMIT 40""",
    "latency_percentiles": """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, n AS count, round(value, 6) AS p95 FROM v WHERE i = least(n - 1, CAST(round_even(0.95 * (n - 1), 0) AS BIGINT))""",
}
