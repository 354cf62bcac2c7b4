"""Span models of printed documents as tables of lines, and what can be said of them in plain aggregates.

A snapshot is one JSON file a document (see ``sources.snapshots``). ``lines``
has a row for each line: doc, page, page_count, width, height, block, line,
text, x0, y0, x1, y1, font, size, spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..runtime import ship

#: Language and confidence of each of some texts.
Detector = Callable[[list[str]], list[tuple[str | None, float]]]

# Bands and shares of the layout rules.
BAND, REPEAT_SHARE, SHORT_PAGES, SHORT_REPEATS, DRIFT = 0.08, 0.6, 10, 5, 0.02
UNMAPPABLE_LIMIT, LOW_WORDS = 0.02, 50
CONTENTS_LEAST, CONTENTS_SHARE, RIGHT_BAND = 5, 0.6, 0.8
HEADING_LEAST, HEADING_SPREAD, HEADING_EVERY, HEADING_LENGTH = 4, 0.4, 10, 0.6
FIGURE_SHARE, NUMBERED_SHARE = 0.02, 0.6
SCORED_WORDS, SURE = 8, 0.5
SYMBOL_FAMILIES = ("wingdings", "wingdings2", "wingdings3", "webdings", "symbol", "zapfdingbats", "dingbats")
GLYPHS = {("wingdings3", "ð"): "▲", ("wingdings3", "ñ"): "▼", ("wingdings3", "ô"): "◀", ("wingdings3", "õ"): "▶"}
REPLACEMENT = "�"


def lines_of(documents: DataFrame) -> DataFrame:
    """Exploded lines of snapshots; a line's font and size are those of its first span."""
    pages = documents.select("doc", "page_count", F.explode("pages").alias("p"))
    blocks = pages.select("doc", "page_count", F.col("p.number").alias("page"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.posexplode("p.blocks").alias("block", "b"))
    rows = blocks.select("doc", "page_count", "page", "width", "height", "block", F.posexplode("b.lines").alias("line", "l"))
    box = lambda i: F.get(F.col("l.bbox"), F.lit(i))
    return rows.select(
        "doc", "page_count", "page", "width", "height", "block", "line",
        F.array_join(F.transform("l.spans", lambda s: s["text"]), "").alias("text"),
        box(0).alias("x0"), box(1).alias("y0"), box(2).alias("x1"), box(3).alias("y1"),
        F.get(F.col("l.spans"), F.lit(0))["font"].alias("font"), F.get(F.col("l.spans"), F.lit(0))["size"].alias("size"),
        F.col("l.spans").alias("spans"), F.coalesce(F.col("l.furniture"), F.lit(False)).alias("furniture"),
    )


def printed(lines: DataFrame) -> DataFrame:
    return lines.where(T.collapse(F.col("text")) != "")


def in_band() -> Column:
    return (F.col("y1") <= F.col("height") * BAND) | (F.col("y0") >= F.col("height") - F.col("height") * BAND)


def mark_furniture(lines: DataFrame) -> DataFrame:
    """Lines with furniture set: running heads, feet and page numbers.

    A key in the bands counts from its second page on: page numbers then, other
    keys if they are on most pages at one height. The keys of a document are
    few, so what comes back is joined by key.
    """
    offset = F.when(F.col("y1") <= F.col("height") * BAND, F.col("y0") / F.col("height")).otherwise((F.col("height") - F.col("y1")) / F.col("height"))
    banded = printed(lines).where(in_band()).select("doc", "page", T.furniture_key(F.col("text")).alias("key"), offset.alias("offset"))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    keys = banded.groupBy("doc", "key").agg(F.count_distinct("page").alias("on"), (F.max("offset") - F.min("offset")).alias("drift")).join(pages, "doc")
    often = (F.col("on") >= REPEAT_SHARE * F.col("pages")) | ((F.col("pages") <= SHORT_PAGES) & (F.col("on") >= SHORT_REPEATS))
    marked = keys.where((F.col("on") >= 2) & ((F.col("key") == "#") | (often & (F.col("drift") <= DRIFT)))).select("doc", "key", F.lit(True).alias("_f"))
    keyed = lines.withColumn("_key", F.when(in_band() & (T.collapse(F.col("text")) != ""), T.furniture_key(F.col("text"))))
    joined = keyed.join(marked.withColumnRenamed("key", "_key"), ["doc", "_key"], "left")
    return joined.withColumn("furniture", F.col("furniture") | F.coalesce("_f", F.lit(False))).drop("_key", "_f")


def is_symbol_font(font: Column, families: tuple[str, ...] = ()) -> Column:
    return T.font_family(font).isin(*SYMBOL_FAMILIES, *families)


def repaired_text(font: Column, text: Column, families: tuple[str, ...] = (), names: dict | None = None) -> Column:
    """Struct (text, repaired, unmappable): letters outside ASCII in a symbol font become the glyph they print, or U+FFFD.

    names: (family, character) to character, from a font's own program; it goes
    before the table of known faults.
    """
    table = {**GLYPHS, **(names or {})}
    known = F.create_map(*[x for (fam, ch), out in table.items() for x in (F.lit(f"{fam}\0{ch}"), F.lit(out))])
    key = lambda c: F.concat(T.font_family(font), F.lit("\0"), c)
    suspect = is_symbol_font(font, families) & T.is_suspect_char(text)
    chars = F.split(text, "")
    mapped = F.transform(chars, lambda c: F.when(T.is_suspect_char(c), F.coalesce(F.element_at(known, key(c)), F.lit(REPLACEMENT))).otherwise(c))
    out = F.when(suspect, F.array_join(mapped, "")).otherwise(text)
    fixed = F.when(suspect, F.size(F.filter(chars, lambda c: T.is_suspect_char(c) & F.element_at(known, key(c)).isNotNull()))).otherwise(0)
    return F.struct(out.alias("text"), fixed.alias("repaired"), F.regexp_count(out, F.lit(REPLACEMENT)).alias("unmappable"))


def repaired_documents(documents: DataFrame, families: tuple[str, ...] = ()) -> DataFrame:
    """Snapshots whose spans hold the repaired text; a span with a character that stays unknown is unmappable."""

    def span(s: Column) -> Column:
        r = repaired_text(s["font"], s["text"], families)
        return s.withField("text", r["text"]).withField("unmappable", F.coalesce(s["unmappable"], F.lit(False)) | (r["unmappable"] > 0))

    line = lambda x: x.withField("spans", F.transform(x["spans"], span))
    block = lambda b: b.withField("lines", F.transform(b["lines"], line))
    page = lambda p: p.withField("blocks", F.transform(p["blocks"], block))
    return documents.withColumn("pages", F.transform("pages", page))


def glyph_audit(lines: DataFrame, families: tuple[str, ...] = ()) -> DataFrame:
    """(doc, spans_repaired, spans_degraded, ratio, unreadable) over lines that aren't furniture."""
    spans = lines.where(~F.col("furniture")).select("doc", F.explode("spans").alias("s"))
    r = spans.select("doc", repaired_text(F.col("s.font"), F.col("s.text"), families).alias("r"))
    sums = r.groupBy("doc").agg(F.count_if(F.col("r.repaired") > 0).alias("spans_repaired"), F.count_if(F.col("r.unmappable") > 0).alias("spans_degraded"), F.sum("r.unmappable").alias("bad"), F.sum(F.length("r.text")).alias("chars"))
    ratio = F.coalesce(F.col("bad") / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0))
    return sums.select("doc", "spans_repaired", "spans_degraded", ratio.alias("ratio"), (ratio > UNMAPPABLE_LIMIT).alias("unreadable"))


def symbol_families(lines: DataFrame, families: tuple[str, ...] = ()) -> DataFrame:
    return lines.select("doc", F.explode("spans").alias("s")).where(is_symbol_font(F.col("s.font"), families)).select("doc", T.font_family(F.col("s.font")).alias("family")).distinct()


def has_text_layer(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc").agg(F.max(~F.col("furniture") & (T.collapse(F.col("text")) != "")).alias("has_text"))


def low_text(lines: DataFrame) -> DataFrame:
    """(doc, low): fewer than fifty words a page."""
    words = lines.groupBy("doc").agg(F.sum(T.word_count(F.col("text"))).alias("words"), F.first("page_count").alias("n"))
    return words.select("doc", F.when(F.col("n") > 0, F.col("words") / F.col("n") < LOW_WORDS).otherwise(True).alias("low"))


def has_figures(documents: DataFrame) -> DataFrame:
    """(doc, page, has_figures): an image over two hundredths of the page."""
    pages = documents.select("doc", F.explode("pages").alias("p"))
    area = F.col("p.width") * F.col("p.height")
    side = lambda r, a, b: F.get(r, F.lit(b)) - F.get(r, F.lit(a))
    big = F.exists(F.col("p.images"), lambda r: side(r, 0, 2) * side(r, 1, 3) >= FIGURE_SHARE * area)
    return pages.select("doc", F.col("p.number").alias("page"), ((area > 0) & F.coalesce(big, F.lit(False))).alias("has_figures"))


def body_style(lines: DataFrame) -> DataFrame:
    """(doc, font, size, line_length): the style of most lines, and their median length. The first seen goes first among equals."""
    used = printed(lines).where(~F.col("furniture") & F.col("font").isNotNull())
    styles = used.groupBy("doc", "font", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "block", "line")).alias("seen"), F.percentile(F.length(T.collapse(F.col("text"))), 0.5).alias("line_length"))
    best = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "seen")) == 1
    return styles.withColumn("_b", best).where("_b").select("doc", "font", "size", "line_length")


def reads_as_title(text: Column, size: Column, body_size: Column, line_length: Column) -> Column:
    t = T.collapse(text)
    return (size > body_size) & (F.length(t) < HEADING_LENGTH * line_length) & ~t.endswith(".") & (t != "")


def heading_style(lines: DataFrame) -> DataFrame:
    """(doc, font, size, count): the largest style above the body's that is used like headings; no row if none is."""
    body = body_style(lines).select("doc", F.col("size").alias("body_size"), "line_length")
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    order = F.dense_rank().over(Window.partitionBy("doc").orderBy("page")) - 1
    numbered = lines.select("doc", "page").distinct().withColumn("index", order)
    rows = printed(lines).where(~F.col("furniture")).join(body, "doc").where(reads_as_title(F.col("text"), F.col("size"), F.col("body_size"), F.col("line_length"))).join(numbered, ["doc", "page"])
    styles = rows.groupBy("doc", "font", "size").agg(F.count(F.lit(1)).alias("count"), (F.max("index") - F.min("index") + 1).alias("spread")).join(pages, "doc")
    good = (F.col("count") >= HEADING_LEAST) & (F.col("spread") >= HEADING_SPREAD * F.col("pages")) & (F.col("count") >= F.col("pages") / HEADING_EVERY)
    largest = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("size"), "font")) == 1
    return styles.where(good).withColumn("_l", largest).where("_l").select("doc", "font", "size", "count")


def dot_leader_pages(lines: DataFrame) -> DataFrame:
    """(doc, page, leaders, lines) of pages that are mostly contents lines with dot leaders."""
    rows = printed(lines).where(~F.col("furniture")).withColumn("lead", T.contents_line(F.col("text")).isNotNull())
    counted = rows.groupBy("doc", "page").agg(F.count_if("lead").alias("leaders"), F.count(F.lit(1)).alias("lines"))
    return counted.where((F.col("leaders") >= CONTENTS_LEAST) & (F.col("leaders") >= CONTENTS_SHARE * F.col("lines")))


def contents_pages(lines: DataFrame) -> DataFrame:
    """(doc, page) of printed contents: dot leaders, or page numbers down the right side.

    A line counts that is a leader or a number, or stands in one row with a
    number: the one join of a page's lines with its few numbers by overlap.
    """
    text = T.collapse(F.col("text"))
    number = text.rlike(r"^\d{1,9}$") & (F.col("x0") >= F.col("width") * RIGHT_BAND) & text.try_cast("int").between(1, F.col("page_count"))
    rows = printed(lines).where(~F.col("furniture")).withColumns({"numeral": F.coalesce(number, F.lit(False)), "leader": T.contents_line(F.col("text")).isNotNull()})
    numerals = rows.where("numeral").select("doc", "page", F.col("block").alias("nb"), F.col("line").alias("nl"), F.col("y0").alias("ny0"), F.col("y1").alias("ny1"))
    touched = rows.join(numerals, ["doc", "page"]).where((F.col("y0") < F.col("ny1")) & (F.col("ny0") < F.col("y1")) & ~((F.col("block") == F.col("nb")) & (F.col("line") == F.col("nl")))).select("doc", "page", "block", "line", F.lit(True).alias("beside")).distinct()
    rows = rows.join(touched, ["doc", "page", "block", "line"], "left")
    entry = F.col("numeral") | F.col("leader") | F.coalesce("beside", F.lit(False))
    counted = rows.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n"), (F.count_if("numeral") + F.count_if("leader")).alias("marks"), F.count_if(entry).alias("entries"))
    return counted.where((F.col("n") >= CONTENTS_LEAST) & (F.col("marks") >= CONTENTS_LEAST) & (F.col("entries") >= CONTENTS_SHARE * F.col("n"))).select("doc", "page")


def select_english(blocks: DataFrame) -> DataFrame:
    """Adds english: a scored block's own verdict, else the nearest in its page, else its page's, else the nearest page's, else true.

    blocks(doc, page, block, words, lang, confidence); of documents declared
    multilingual. Short blocks and unsure verdicts are unscored.
    """
    own = F.when((F.col("words") >= SCORED_WORDS) & (F.col("confidence") >= SURE), F.col("lang") == "en")
    rows = blocks.withColumn("own", own)
    pages = rows.groupBy("doc", "page").agg(F.max("own").alias("verdict"))
    w = Window.partitionBy("doc").orderBy("page")
    near = F.coalesce(F.last("verdict", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("verdict", True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(True))
    pages = pages.select("doc", "page", near.alias("fallback"))
    p = Window.partitionBy("doc", "page").orderBy("block")
    inherited = F.coalesce(F.last("own", True).over(p.rowsBetween(Window.unboundedPreceding, 0)), F.first("own", True).over(p.rowsBetween(0, Window.unboundedFollowing)))
    return rows.withColumn("inherited", inherited).join(pages, ["doc", "page"]).withColumn("english", F.coalesce("inherited", "fallback")).drop("own", "inherited", "fallback")


def scored_blocks(lines: DataFrame, documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc, page, block, words, lang, confidence) of the lines' blocks, furniture apart.

    By the detector, which gets blocks of enough words alone; without one, by
    the language that the snapshot gives a block.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    texts = lines.where(~F.col("furniture")).groupBy("doc", "page", "block").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    texts = texts.withColumn("words", T.word_count(F.col("text")))
    if detector is None:
        pages = documents.select("doc", F.explode("pages").alias("p"))
        given = pages.select("doc", F.col("p.number").alias("page"), F.posexplode("p.blocks").alias("block", "b")).select("doc", "page", "block", F.col("b.lang").alias("lang"))
        return texts.join(given, ["doc", "page", "block"], "left").select("doc", "page", "block", "words", "lang", F.when(F.col("lang").isNotNull(), 1.0).otherwise(0.0).alias("confidence"))
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, found = b.column(3).to_pylist(), [(None, 0.0)] * b.num_rows
            long = [i for i, n in enumerate(words) if n >= SCORED_WORDS]
            for i, verdict in zip(long, detector([b.column(4)[i].as_py() for i in long])):
                found[i] = verdict
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array([x for x, _ in found], pa.string()), pa.array([float(c) for _, c in found], pa.float64())], names=["doc", "page", "block", "words", "lang", "confidence"])

    return texts.select("doc", F.col("page").cast("int").alias("page"), F.col("block").cast("int").alias("block"), F.col("words").cast("int").alias("words"), "text").mapInArrow(run, "doc string, page int, block int, words int, lang string, confidence double")


def audits(documents: DataFrame, lines: DataFrame, glyphs: DataFrame, languages: DataFrame) -> DataFrame:
    """A row for each document: what a run found out about it.

    page_count, furniture_lines, low_text, body and heading style, glyph
    counts, symbol families, pages with figures, contents pages, and of
    documents in several languages the pages left out or taken in part.
    """
    gather = lambda df, name: df.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("page").cast("int"))).alias(name))
    parts = [
        lines.groupBy("doc").agg(F.count_if("furniture").alias("furniture_lines"), F.count(F.lit(1)).alias("lines")),
        low_text(lines).withColumnRenamed("low", "low_text"),
        body_style(lines).select("doc", F.col("font").alias("body_font"), F.col("size").alias("body_size")),
        heading_style(lines).select("doc", F.col("font").alias("heading_font"), F.col("size").alias("heading_size"), F.col("count").alias("headings")),
        glyphs.select("doc", "spans_repaired", "spans_degraded", F.round("ratio", 6).alias("unmappable_ratio")),
        symbol_families(lines).groupBy("doc").agg(F.array_sort(F.collect_set("family")).alias("symbol_families")),
        gather(has_figures(documents).where("has_figures"), "figure_pages"),
        gather(contents_pages(lines), "contents_pages"),
        gather(languages.where("NOT included"), "foreign_pages"),
        gather(languages.where("partial"), "partial_pages"),
    ]
    out = documents.select("doc", "page_count")
    for part in parts:
        out = out.join(part, "doc", "left")
    return out


def language_audit(blocks: DataFrame) -> DataFrame:
    """(doc, page, included, partial) from blocks with english."""
    pages = blocks.groupBy("doc", "page").agg(F.max("english").alias("included"), F.min("english").alias("whole"))
    return pages.select("doc", "page", "included", (F.col("included") & ~F.col("whole")).alias("partial"))


def region_of_line(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """Lines with their region: the last anchor at or before them in reading order; -1 before the first.

    The half-open interval join as one pass over the union, so no pairs arise.
    """
    position = lambda a, b, c: F.struct(F.col(a).alias("page"), F.col(b).alias("y"), F.col(c).alias("x"))
    marks = anchors.select("doc", position("page", "y0", "x0").alias("at"), F.col("region").alias("mark"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("int").alias("line"))
    rows = lines.select("doc", position("page", "y0", "x0").alias("at"), F.lit(None).cast("int").alias("mark"), F.lit(1).alias("kind"), "block", "line")
    w = Window.partitionBy("doc").orderBy("at", "kind", "mark").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumn("region", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(-1)))
    return both.where("kind = 1").select("doc", F.col("at.page").alias("page"), "block", "line", "region")
