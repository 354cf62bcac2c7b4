"""Turns replayed as a batch: questions, retrieval, entry expansion, transcripts, grounding, outcome, and the events a client would have seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import framing, grounding, narrowing, outcomes
from ..operators import retrieval as R
from ..runtime import Workspace

#: Events of a turn, in their order.
EVENTS = ("outcome", "direct_answer", "body_delta", "citation", "cause", "contributing_sources", "uncovered_parts", "suggested_sources", "narrowing", "required_device", "required_manual", "ungrounded", "framing", "done")
SUGGESTIONS = 3
#: Outcomes under which no source is suggested.
UNSUGGESTED = ("out-of-domain", "no-manual-for-device")
_STRINGS = "array<string>"


def _passages(view: dict[str, DataFrame]) -> DataFrame:
    if "sidecar" not in view:
        return view["passages"].withColumn("devices", F.lit(None).cast(_STRINGS))
    return view["passages"].join(view["sidecar"].select("passage_id", F.col("devices.id").alias("devices")), "passage_id", "left")


def replay(view: dict[str, DataFrame], questions: DataFrame, gates: DataFrame, transcripts: DataFrame, config: R.RetrievalConfig = R.RetrievalConfig(), undocumented: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of each turn's result: one for each kind of event, and turns, supplied and stripped.

    questions as for retrieval; gates(qid, gate, flight) as for ``outcomes``;
    transcripts(qid, stream): what the provider sent, null where nothing came;
    undocumented(device_id, display_name): gear without a manual. The provider
    itself is never called from a task.
    """
    spark = questions.sparkSession
    ws = Workspace(spark, "turns")  # what several tables are made of is made once
    passages = _passages(view)
    index = R.LexicalIndex(view["postings"], view["lengths"], view["terms"], view["stats"])
    supplied = ws.put("supplied", R.retrieve(passages, questions, index, config))
    covered = supplied.groupBy("qid").agg(F.count(F.lit(1)).alias("n_supplied"))
    answers = ws.put("answers", framing.parse_answers(transcripts.select("qid", "stream"), "qid"))
    turns = questions.select("qid", "sources").join(gates, "qid").join(answers, "qid", "left").join(covered, "qid", "left")
    turns = ws.put("turns", turns.withColumn("verdict", outcomes.classify(F.col("gate"), F.col("flight"), F.col("line_one"), F.col("n_supplied").isNotNull())))
    ended = lambda *names: turns.where(F.col("verdict.outcome").isin(*names))
    have = supplied.select("qid", "passage_id")

    expanded = {}
    if "sidecar" in view:
        matched = ws.put("matched", _fixes(narrowing.matched_entry(supplied.select("qid", "position", "passage_id"), view["sidecar"])))
        fixes = ws.put("fixes", narrowing.fix_candidates(matched, passages.select("passage_id", "devices"), questions.select("qid", "sources", "scope")))
        admitted = ws.put("admitted", narrowing.admit(fixes, have))
        have = ws.put("have", have.union(admitted.where("admitted").select("qid", "passage_id")).distinct())
        expanded = {"causes": narrowing.causes_of(matched, admitted), "narrowing": narrowing.narrowing(matched), "suggested": narrowing.suggested_sources(fixes)}
    causes = ws.put("causes", _causes(expanded.get("causes"), ended("ranked-causes"), have))
    narrowed = _narrowing(expanded.get("narrowing"), ended("needs-narrowing"))

    texts = grounding.block_texts(answers, "qid")
    uses = ws.put("uses", grounding.marker_uses(texts, have, "qid"))
    cited = grounding.citations(uses, "qid")
    # What causes cite is numbered behind what the answer does; a cause without a fix marks its own citation.
    more = causes.select("qid", "rank", F.posexplode(F.concat("cites", "fix_cites")).alias("nth", "passage_id")).join(have, ["qid", "passage_id"], "left_semi")
    more = more.groupBy("qid", "passage_id").agg(F.min(F.struct("rank", "nth")).alias("at"))
    numbered = grounding.numbered_citations(cited, more, "qid")
    bare = causes.where(F.size("fix_cites") == 0).select("qid", F.explode("cites").alias("passage_id")).distinct()
    suggested = _suggested(expanded.get("suggested"), turns, view["sources"])
    names = ended("no-manual-for-device").where("device IS NOT NULL").select("qid", "device")
    gear = undocumented if undocumented is not None else spark.createDataFrame([], "device_id string, display_name string")
    return {
        "turns": turns.select("qid", "verdict.*", "framing", "direct_answer", "uncovered", outcomes.view_of(F.col("verdict.outcome")).alias("view")),
        "supplied": supplied,
        "citations": ws.put("citations", grounding.build_citations(numbered, view["passages"], view["sources"], bare, "qid")),
        "causes": causes,
        "narrowing": narrowed,
        "suggested": suggested,
        "devices": grounding.resolve_devices(names, gear, "qid"),
        "contributing": have.join(view["passages"].select("passage_id", "source_id"), "passage_id").groupBy("qid").agg(F.array_sort(F.collect_set("source_id")).alias("sources")),
        "stripped": grounding.stripped(uses, "qid"),
        "ungrounded": grounding.ungrounded_blocks(texts, uses, "qid").select("qid").distinct(),
        "body": grounding.clean_texts(texts, have, "qid"),
    }


def _fixes(matched: DataFrame) -> DataFrame:
    """Causes with their fixes in the shape of a sidecar row; a pointer that carries no passages yet has none."""
    shaped = F.transform("causes", lambda c: F.struct(c["statement"].alias("statement"), c["check"].alias("check"), F.transform(c["fixes"], lambda f: F.struct(f["source_id"].alias("source_id"), F.coalesce(f["number"], f["title"]).alias("section"), F.array().cast(_STRINGS).alias("passage_ids"))).alias("fix")))
    return matched.withColumn("causes", shaped) if "fixes" in dict(matched.dtypes)["causes"] else matched


_CAUSE = ("qid", "rank", "statement", "check", "cites", "fix_cites", "unbacked")


def _causes(expanded: DataFrame | None, turns: DataFrame, have: DataFrame) -> DataFrame:
    """Of turns that rank causes: the entry's, else the answer's own with the citations that were supplied."""
    said = turns.select("qid", F.explode("causes").alias("c"))
    known = said.select("qid", F.col("c.rank").alias("rank"), F.posexplode("c.cites").alias("nth", "passage_id")).join(have, ["qid", "passage_id"])
    kept = known.groupBy("qid", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "passage_id"))), lambda x: x["passage_id"]).alias("cites"))
    own = said.select("qid", F.col("c.rank").alias("rank"), F.col("c.statement").alias("statement"), F.col("c.check").alias("check")).join(kept, ["qid", "rank"], "left")
    none = F.array().cast(_STRINGS)
    own = own.withColumns({"cites": F.coalesce("cites", none), "fix_cites": none, "unbacked": F.lit(False)}).select(*_CAUSE)
    if expanded is None:
        return own
    mine = expanded.join(turns.select("qid"), "qid", "left_semi").select(*_CAUSE)
    return mine.unionByName(own.join(mine.select("qid").distinct(), "qid", "left_anti"))


def _narrowing(expanded: DataFrame | None, turns: DataFrame) -> DataFrame:
    """(qid, question, candidates) of turns that narrow: the entry's, which may be none, else the answer's own."""
    own = turns.select("qid", framing.narrowing_of(F.col("narrow_question"), F.col("narrow_candidates")).alias("n")).where("n IS NOT NULL")
    own = own.select("qid", "n.question", F.transform("n.candidates", lambda c: F.struct(c.alias("label"), c.alias("value"))).alias("candidates"))
    if expanded is None:
        return own
    mine = expanded.join(turns.select("qid"), "qid", "left_semi").select("qid", "question", "candidates")
    return mine.unionByName(own.join(mine.select("qid"), "qid", "left_anti"))


def _suggested(expanded: DataFrame | None, turns: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, nth, source_id, display_name): sources outside the selection, those that hold a fix first."""
    open_ = turns.where(~F.col("verdict.outcome").isin(*UNSUGGESTED)).select("qid", "sources", "suggestions")
    said = open_.select("qid", F.lit(1).alias("kind"), F.posexplode("suggestions").alias("at", "source_id"))
    if expanded is not None:
        said = said.unionByName(expanded.select("qid", F.lit(0).alias("kind"), (F.col("nth") - 1).alias("at"), "source_id"))
    outside = said.join(open_.select("qid", "sources"), "qid").where(~F.array_contains("sources", F.col("source_id")))
    first = outside.groupBy("qid", "source_id").agg(F.min(F.struct("kind", "at")).alias("place")).join(sources.select("source_id", "display_name"), "source_id")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    return first.withColumn("nth", nth).where(F.col("nth") <= SUGGESTIONS).select("qid", "nth", "source_id", "display_name")


def events(tables: dict[str, DataFrame]) -> DataFrame:
    """(qid, seq, name, payload) in the order a client gets them, payloads as JSON; what a turn doesn't have isn't there."""
    t = tables["turns"]

    def part(df: DataFrame, name: str, payload: Column, nth: Column | None = None) -> DataFrame:
        return df.select("qid", F.lit(EVENTS.index(name)).alias("phase"), (F.lit(0) if nth is None else nth).cast("int").alias("nth"), F.lit(name).alias("name"), payload.alias("payload"))

    whole = lambda df, *without: F.to_json(F.struct(*[c for c in df.columns if c not in ("qid", *without)]))
    sources = tables["suggested"].groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "source_id", "display_name"))), lambda x: F.struct(x["source_id"].alias("source_id"), x["display_name"].alias("display_name"))).alias("s"))
    devices = tables["devices"]
    parts = [
        part(t, "outcome", F.to_json(F.struct("outcome", "reason", "detail", "retry_after"))),
        part(t.where("direct_answer IS NOT NULL"), "direct_answer", F.to_json(F.struct("direct_answer"))),
        part(tables["body"].where("pos >= 0"), "body_delta", F.to_json(F.struct("type", "text")), F.col("pos")),
        part(tables["citations"], "citation", whole(tables["citations"]), F.col("number")),
        part(tables["causes"], "cause", whole(tables["causes"]), F.col("rank")),
        part(tables["contributing"], "contributing_sources", F.to_json("sources")),
        part(t.where(F.size("uncovered") > 0), "uncovered_parts", F.to_json("uncovered")),
        part(sources, "suggested_sources", F.to_json("s")),
        part(tables["narrowing"], "narrowing", F.to_json(F.struct("question", "candidates"))),
        part(devices, "required_device", F.to_json(F.struct("device", "display_name"))),
        part(devices.where("filename IS NOT NULL"), "required_manual", F.to_json(F.struct("filename"))),
        part(tables["ungrounded"], "ungrounded", F.lit("true")),
        part(t, "framing", F.to_json(F.struct("framing"))),
        part(t, "done", F.lit('{"complete":true}')),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("qid").orderBy("phase", "nth")
    return out.select("qid", (F.row_number().over(order) - 1).alias("seq"), "name", "payload")
