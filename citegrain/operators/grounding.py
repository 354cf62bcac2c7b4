"""Which statements of an answer rest on which passages, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.words import fact_shaped

CITATION = ("passage_id", "source_id", "display_name", "kind", "hardware_applicability", "doc_version", "section_number", "section_title", "page", "entry_location", "unbacked", "degraded", "has_figures")


def block_texts(answers: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, pos, type, text): the direct answer at -1, then blocks, a conflict's readings in its text's place after it."""
    b = F.col("b")
    blocks = answers.select(key, F.explode("blocks").alias("b")).select(key, b["pos"].alias("pos"), b["type"].alias("type"), F.concat_ws("\n", b["text"], F.array_join(b["readings"], "\n")).alias("text"))
    direct = answers.where("direct_answer IS NOT NULL").select(key, F.lit(-1).alias("pos"), F.lit("direct").alias("type"), F.col("direct_answer").alias("text"))
    return direct.unionByName(blocks)


def marker_uses(texts: DataFrame, supplied: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, pos, nth, passage_id, known) of every marker; supplied(key, passage_id)."""
    used = texts.select(key, "pos", F.posexplode(T.markers(F.col("text"))).alias("nth", "passage_id"))
    return used.join(supplied.select(key, "passage_id", F.lit(True).alias("known")), [key, "passage_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def citations(uses: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, number, passage_id): known passages by first appearance."""
    first = uses.where("known").groupBy(key, "passage_id").agg(F.min(F.struct("pos", "nth")).alias("first"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("first")).alias("number"), "passage_id")


def numbered_citations(cited: DataFrame, extra: DataFrame, key: str = "turn_id") -> DataFrame:
    """Citations that no marker names are numbered after those that one does; extra(key, passage_id, at)."""
    rest = extra.join(cited.select(key, "passage_id"), [key, "passage_id"], "left_anti")
    last = cited.groupBy(key).agg(F.max("number").alias("last"))
    behind = rest.join(last, key, "left").select(key, (F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy("at", "passage_id"))).alias("number"), "passage_id")
    return cited.unionByName(behind)


def stripped(uses: DataFrame, key: str = "turn_id") -> DataFrame:
    return uses.groupBy(key).agg(F.count_if(~F.col("known")).alias("stripped"))


def clean_texts(texts: DataFrame, supplied: DataFrame, key: str = "turn_id") -> DataFrame:
    """Texts without the markers that nothing supplied answers to; supplied lists are a turn's dozen passages."""
    known = supplied.groupBy(key).agg(F.collect_set("passage_id").alias("known"))
    joined = texts.join(known, key, "left").withColumn("c", T.keep_known_markers(F.col("text"), F.coalesce("known", F.array().cast("array<string>"))))
    return joined.select(key, "pos", "type", F.col("c.text").alias("text"), F.col("c.stripped").alias("stripped"))


def ungrounded_blocks(texts: DataFrame, uses: DataFrame, key: str = "turn_id") -> DataFrame:
    """Blocks without a known citation that are a step or look factual."""
    backed = uses.where("known").select(key, "pos").distinct()
    loose = texts.where("pos >= 0").join(backed, [key, "pos"], "left_anti")
    return loose.where((F.col("type") == "step") | fact_shaped(T.without_markers(F.col("text"))))


def build_citations(cited: DataFrame, passages: DataFrame, sources: DataFrame, unbacked: DataFrame | None = None, key: str = "turn_id") -> DataFrame:
    """The fields of each citation; passages and sources join by id, and what they don't have is null. unbacked(key, passage_id): causes without a fix this turn."""
    for name in ("hardware_applicability", "doc_version"):
        if name not in sources.columns:
            sources = sources.withColumn(name, F.lit(None).cast("string"))
    rows = cited.join(passages, "passage_id").join(sources.select("source_id", "display_name", "kind", "hardware_applicability", "doc_version"), "source_id")
    if unbacked is not None:
        rows = rows.join(unbacked.select(key, "passage_id", F.lit(True).alias("_mark")), [key, "passage_id"], "left").withColumn("unbacked", F.col("unbacked") | F.coalesce("_mark", F.lit(False))).drop("_mark")
    return rows.withColumn("page", F.col("page_start")).select(key, "number", *CITATION)


def resolve_devices(names: DataFrame, undocumented: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, device, display_name, filename): a name that the gap report knows by id or display name, else as it is.

    Each device is listed under both of its names, so that one equi-join finds
    it; an id goes before a display name, and of equal names the first id.
    """
    known = undocumented.select("device_id", F.col("display_name").alias("known_name"))
    listed = known.select(T.folded(F.col("device_id")).alias("_name"), F.lit(0).alias("_place"), "device_id", "known_name")
    listed = listed.unionByName(known.where("known_name IS NOT NULL").select(T.folded(F.col("known_name")).alias("_name"), F.lit(1).alias("_place"), "device_id", "known_name"))
    one = listed.groupBy("_name").agg(F.min(F.struct("_place", "device_id", "known_name")).alias("_d")).select("_name", "_d.device_id", "_d.known_name")
    found = names.withColumn("_name", T.folded(F.trim("device"))).join(one, "_name", "left")
    return found.select(key, F.coalesce("device_id", "device").alias("device"), F.col("known_name").alias("display_name"), F.when(F.col("device_id").isNotNull(), T.placeholder_filename(F.col("device_id"))).alias("filename"))


def suggested_sources(answers: DataFrame, sources: DataFrame, limit: int = 3, key: str = "turn_id") -> DataFrame:
    """(key, rank, source_id, display_name): suggestions that exist, the first three."""
    asked = answers.select(key, F.posexplode("suggestions").alias("at", "source_id"))
    found = asked.join(sources.select("source_id", "display_name"), "source_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("rank") <= limit).select(key, "rank", "source_id", "display_name")


def fold_events(events: DataFrame, key: str = "turn_id") -> DataFrame:
    """A turn's events (seq, name, payload) as one row: the last value of each field, body in order, whether it is complete."""
    last = lambda n: F.max_by(F.when(F.col("name") == n, F.col("payload")), F.when(F.col("name") == n, F.col("seq"))).alias(n)
    deltas = F.array_sort(F.collect_list(F.when(F.col("name") == "body_delta", F.struct("seq", "payload"))))
    body = F.array_join(F.transform(deltas, lambda d: d["payload"]), "")
    return events.groupBy(key).agg(last("outcome"), last("direct_answer"), body.alias("body"), F.max(F.col("name") == "done").alias("complete"))


def sse_frames(stream: DataFrame, key: str = "turn_id", text: str = "stream") -> DataFrame:
    """(key, seq, event, data) of an event stream: frames end with a blank line; without data, or cut short, they go."""
    frames = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n\n")
    whole = F.slice(frames, 1, F.greatest(F.size(frames) - 1, F.lit(0)))
    rows = stream.select(key, F.posexplode(whole).alias("seq", "frame"))
    data = F.regexp_extract_all("frame", F.lit(r"(?m)^data:\x20?(.*)$"), F.lit(1))
    event = F.regexp_extract("frame", r"(?m)^event:\x20?(.*)$", 1)
    return rows.withColumn("lines", data).where(F.size("lines") > 0).select(key, "seq", F.when(event == "", "message").otherwise(event).alias("event"), F.array_join("lines", "\n").alias("data"))
