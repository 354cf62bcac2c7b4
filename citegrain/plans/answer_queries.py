"""Queries over turns, answers and conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversation, entries, framing, grounding, narrowing, outcomes, prompt
from ..streaming import conversation as streaming
from . import tables as X



def _turns(spark, sf_dir):
    """Events of a user as the turns of a conversation."""
    e = X.table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_id") % 5 == 0, "needs-narrowing").when(F.col("event_id") % 7 == 0, "timeout").when(F.col("event_id") % 3 == 0, "partially-answered").when(F.col("event_id") % 11 == 0, "needs-narrowing").otherwise("answered")
    return e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("question"), outcome.alias("outcome"), F.concat(F.lit("a"), F.round("value", 1).cast("string")).alias("answer"))


def narrowing_counter(spark, sf_dir):
    return conversation.narrowing_state(_turns(spark, sf_dir)).select("conv_id", "turn", F.col("narrowing_count").cast("long").alias("narrowing_count"), "retrieval_query")


def conversation_history(spark, sf_dir):
    return conversation.history(_turns(spark, sf_dir).select("conv_id", "turn", "question", "outcome", F.col("question").alias("answer"))).select("conv_id", "turn", F.array_join("history", "|").alias("history"))


def recent_exchanges(spark, sf_dir):
    return conversation.recent_exchanges(_turns(spark, sf_dir)).select("conv_id", "turn", "nth")


def history_budget(spark, sf_dir):
    lines = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).cast("long").alias("tokens"))
    return conversation.within_budget(lines, "tokens").select("conv_id", "turn", F.col("spent").cast("long").alias("spent"))


def conversation_replay(spark, sf_dir):
    """The streaming rule over a table; equal to the window form, as tests show."""
    t = _turns(spark, sf_dir).withColumn("conv_id", F.col("conv_id").cast("string"))
    return streaming.replay(t)


def turn_supersede(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("ts").cast("timestamp").alias("started"))
    return conversation.superseded(e.withColumn("ended", F.col("started") + F.expr("INTERVAL 6 HOURS"))).select("turn", "cancelled")


def history_store(spark, sf_dir):
    kind = F.when(F.col("event_id") % 6 == 0, "cancelled").when(F.col("event_id") % 13 == 0, "error").otherwise("answered")
    r = X.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("client"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("record_id"), kind.alias("outcome"), (F.col("event_id") % 4 > 0).alias("complete"))
    return conversation.kept_history(r).select("client", "record_id", "nth", "incomplete")


def scope_pruned(spark, sf_dir):
    carried = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conv_id"), F.concat(F.lit("src"), (F.col("c_custkey") % 30).cast("string")).alias("source_id"))
    sources = X.table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    return conversation.prune_scope(carried, sources)[1]


def outcome_classify(spark, sf_dir):
    k = F.col("event_id")
    gate = F.struct(
        F.when(k % 29 == 0, 0).otherwise(5).alias("passage_count"), F.when(k % 23 == 0, F.array(F.lit("a/x"), F.lit("b/y"))).otherwise(F.array().cast("array<string>")).alias("unknown_source_ids"),
        (k % 19).alias("selected_count"), F.when(k % 17 != 0, "local").alias("provider_kind"), (k % 13 == 0).alias("requires_key"), (k % 2 == 0).alias("credential_stored"), (k % 11 == 0).alias("requires_ack"), (k % 3 == 0).alias("acknowledged"),
    )
    failure = F.when(k % 10 == 1, "unreachable").when(k % 10 == 2, "rate-limited").when(k % 10 == 3, "timeout").when(k % 10 == 4, "auth").when(k % 10 == 5, "error")
    flight = F.struct((k % 31 == 0).alias("cancelled"), (k % 7 == 0).alias("streamed"), failure.alias("failure"), F.when(k % 4 == 0, 1.5).alias("retry_after"), F.lit("prov").alias("provider"), F.when(k % 3 == 0, "why").alias("detail"))
    line = F.when(k % 8 == 6, " ranked-causes ").when(k % 8 == 7, "no such").otherwise("answered")
    c = outcomes.classify(gate, flight, line, k % 5 == 0)
    e = X.table(spark, sf_dir, "events").select("event_id", c.alias("c"))
    text = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x.split(".")[1])
    return e.select("event_id", "c.outcome", text("c.reason"), text("c.detail"), F.coalesce("c.retry_after", F.lit(0.0)).alias("retry_after"), outcomes.view_of(F.col("c.outcome")).alias("view"))


def turn_latencies(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("a"), F.col("value").alias("v"))
    end = F.when(F.col("event_id") % 4 > 0, F.timestamp_micros(F.unix_micros("a") + (F.abs("v") * 100000).cast("long")))
    ms = outcomes.latency(F.col("a"), end)
    return e.select("event_id", F.coalesce(F.round(ms, 3), F.lit(-1.0)).alias("ms"), F.coalesce(outcomes.is_slow(ms, F.col("event_id") % 2 == 0), F.lit(False)).alias("slow"))


def _transcripts(spark, sf_dir):
    """Documents as answers: an outcome, a direct answer, then lines of all kinds with markers; seven equal parts make up the whole text."""
    d = X.table(spark, sf_dir, "documents")
    size = F.ceil(F.length("text") / 7).cast("int")
    part = lambda i: F.trim(F.regexp_replace(F.substring(F.col("text"), 1 + size * i, size), r"[\n\r]", " "))
    mark = lambda i: F.concat(F.lit(" [[p:m"), ((F.col("doc_id") + i) % 9).cast("string"), F.lit("]]"))
    line = F.when(F.col("doc_id") % 10 == 0, "no outcome").otherwise("answered")
    body = F.concat_ws("\n", line, F.concat(part(0), mark(0)), F.lit("---"), F.concat(F.lit("## "), part(1)), F.concat(F.lit("1. "), part(2), mark(1)), F.concat(F.lit("- "), part(3), mark(4), mark(1)), F.concat(F.lit("!caveat "), part(4)), F.lit("  and more"), F.lit(""), F.concat(F.lit("~uncovered "), part(5)), F.concat(F.lit("x"), part(6)))
    return d.select(F.col("doc_id").alias("turn_id"), body.alias("stream"))


def framing_blocks(spark, sf_dir):
    a = framing.parse_answers(_transcripts(spark, sf_dir))
    b = F.col("b")
    return a.select("turn_id", "framing", F.explode("blocks").alias("b")).select("turn_id", "framing", b["pos"].alias("pos"), b["type"].alias("type"), b["text"].alias("text"), F.size(b["markers"]).alias("n_markers"))


def _uses(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    texts = t.select("turn_id", F.posexplode(F.split("stream", "\n")).alias("pos", "text")).withColumn("type", F.lit("paragraph"))
    supplied = t.select("turn_id", F.explode(F.array(*[F.concat(F.lit("m"), ((F.col("turn_id") + i) % 9).cast("string")) for i in (0, 1, 2)])).alias("passage_id"))
    return texts, supplied, grounding.marker_uses(texts, supplied)


def markers_grounding(spark, sf_dir):
    _, _, uses = _uses(spark, sf_dir)
    return grounding.citations(uses).join(grounding.stripped(uses), "turn_id")


def cleaned_answers(spark, sf_dir):
    texts, supplied, _ = _uses(spark, sf_dir)
    return grounding.clean_texts(texts, supplied).where("text LIKE '%[[%' OR stripped > 0").select("turn_id", "pos", "text", F.col("stripped").cast("long").alias("stripped"))


def numbered_citations(spark, sf_dir):
    _, supplied, uses = _uses(spark, sf_dir)
    return grounding.numbered_citations(grounding.citations(uses), supplied.withColumn("at", F.col("passage_id")))


def ungrounded(spark, sf_dir):
    texts, _, uses = _uses(spark, sf_dir)
    return grounding.ungrounded_blocks(texts, uses).select("turn_id", "pos")


def event_fold(spark, sf_dir):
    k = F.col("event_id")
    name = F.when(k % 9 == 0, "outcome").when(k % 9 == 1, "direct_answer").when(k % 9 == 2, "done").otherwise("body_delta")
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("turn_id"), k.alias("seq"), name.alias("name"), F.concat(F.lit("p"), k.cast("string")).alias("payload"))
    return grounding.fold_events(e).select("turn_id", F.coalesce("outcome", F.lit("")).alias("outcome"), F.coalesce("direct_answer", F.lit("")).alias("direct_answer"), "body", "complete")


def sse_frames(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    frame = F.concat(F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("event: "), F.col("role"), F.lit("\n"))), F.when(F.col("turn") % 4 == 3, F.lit(": ping")).otherwise(F.concat(F.lit("data: "), F.col("h"))), F.lit("\n\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "f"))), lambda x: x["f"]), "")
    s = c.withColumn("f", frame).groupBy(F.col("conv_id").alias("turn_id")).agg(F.concat(text, F.lit("data: cut")).alias("stream"))
    return grounding.sse_frames(s)


def required_devices(spark, sf_dir):
    names = X.table(spark, sf_dir, "supplier").join(X.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("turn_id"), F.when(F.col("s_suppkey") % 3 == 0, F.lower("n_name")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Acme/"), "n_name")).otherwise(F.lit("other thing")).alias("device"))
    gaps = X.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("acme/"), F.lower("n_name")).alias("device_id"), F.col("n_name").alias("display_name"))
    found = grounding.resolve_devices(names, gaps)
    return found.select("turn_id", "device", F.coalesce("display_name", F.lit("")).alias("display_name"), F.coalesce("filename", F.lit("")).alias("filename"))


def _entry_rows(spark, sf_dir):
    """Suppliers as entries of five causes, whose fixes are passages of sources."""
    p = X.with_vector(X.passages(spark, sf_dir)).select("passage_id", "source_id", "devices", "doc_id", "text")
    fix = lambda j: F.struct(F.concat(F.lit("src"), ((F.col("qid") + j) % 20).cast("string")).alias("source_id"), F.lit("s").alias("section"), F.array(*[F.concat(F.lit("src"), ((F.col("qid") + j) % 20).cast("string"), F.lit("#"), F.lpad((((F.col("qid") + j) % 20) + 20 * m).cast("string"), 6, "0")) for m in range(4)]).alias("passage_ids"))
    cause = lambda i: F.struct(F.concat(F.lit("cause "), F.lit(str(i))).alias("statement"), F.concat(F.lit("check "), F.lit(str(i))).alias("check"), F.array(fix(i), fix(i + 1)).alias("fix"))
    q = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    matched = q.select("qid", F.concat(F.lit("e"), F.col("qid").cast("string")).alias("passage_id"), F.concat(F.lit("sym "), F.col("qid").cast("string")).alias("symptom"), F.array(*[cause(i) for i in range(5)]).alias("causes"))
    questions = q.select("qid", F.array(*map(F.lit, X.SELECTED)).alias("sources"), F.array(*map(F.lit, X.SCOPE)).alias("scope"))
    supplied = q.select("qid", F.explode(F.array(*[F.concat(F.lit("src"), ((F.col("qid") + 2) % 20).cast("string"), F.lit("#"), F.lpad((((F.col("qid") + 2) % 20) + 20 * m).cast("string"), 6, "0")) for m in range(7)])).alias("passage_id"))
    return p, matched, questions, supplied


def entry_expansion(spark, sf_dir):
    p, matched, questions, supplied = _entry_rows(spark, sf_dir)
    fixes = narrowing.fix_candidates(matched, p, questions)
    return narrowing.causes_of(matched, narrowing.admit(fixes, supplied)).select("qid", "rank", "statement", F.array_join("fix_cites", ",").alias("fix_cites"), "unbacked")


def entry_suggestions(spark, sf_dir):
    p, matched, questions, _ = _entry_rows(spark, sf_dir)
    return narrowing.suggested_sources(narrowing.fix_candidates(matched, p, questions))


def narrowing_questions(spark, sf_dir):
    _, matched, _, _ = _entry_rows(spark, sf_dir)
    settled = matched.select("qid", F.explode(F.array(F.when(F.col("qid") % 2 == 0, "cause 0"), F.when(F.col("qid") % 3 == 0, "cause 1"), F.when(F.col("qid") % 6 == 0, "cause 2"))).alias("value")).where("value IS NOT NULL")
    n = narrowing.narrowing(matched, settled)
    return n.select("qid", "question", F.array_join(F.transform("candidates", lambda c: F.concat(c["label"], F.lit("="), c["value"])), ",").alias("candidates"))


def prompts(spark, sf_dir):
    """Digests of assembled prompts, over the passages that retrieval would supply for a source each."""
    p, _, questions, supplied = _entry_rows(spark, sf_dir)
    sources = p.select("source_id").distinct().select("source_id", F.initcap("source_id").alias("display_name"), F.lit("vendor-manual").alias("kind"), F.when(F.col("source_id") > "src3", "prod").alias("product"))
    ordered = supplied.withColumn("position", F.col("passage_id"))
    lines = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), "turn", F.concat(F.lit("Q: "), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("line"))
    q = questions.join(X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), "qid").withColumn("narrowing_count", F.col("qid") % 4)
    nothing = spark.createDataFrame([], "qid long, block string")
    out = prompt.assemble(q, prompt.passages_block(ordered, p, sources), prompt.roster_block(questions, sources), nothing, prompt.history_block(lines))
    return out.select("qid", F.sha2("prompt", 256).alias("digest"), F.length("prompt").alias("chars"))


def entry_coverage(spark, sf_dir):
    """Entries written out as Markdown from documents, parsed, and counted by outcome. No SQL parses Markdown; tests compare with Python."""
    d = X.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    head = F.concat(F.lit("---\n"), F.when(k % 7 == 0, F.lit("device: x\n")).otherwise(F.concat(F.lit("devices: ["), "source", F.lit("/"), "lang", F.lit("@mk1]\n"))), F.lit("---\n# "), F.substring_index("text", "\n", 1), F.lit("\n"))
    cause = lambda i: F.concat(F.lit(f"## Cause {i}\n"), F.when(k % 11 == i, F.lit("")).otherwise(F.lit("**Check:** see it\n")), F.when(k % 5 == i, F.lit("undocumented: a/b\n")).otherwise(F.concat(F.lit("fix: "), "source", F.lit(f" §{i}.1\n"))))
    body = F.concat(head, cause(1), F.when(k % 3 > 0, cause(2)).otherwise(F.lit("")), F.when(k % 4 == 0, F.lit("## Otherwise\nlook elsewhere\n")).otherwise(F.lit("")))
    parsed = entries.parse_entries(d.select(k.cast("string").alias("source_file"), body.cast("binary").alias("content")))
    return parsed.groupBy(F.coalesce("reason", F.lit("ingested")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("flags")).alias("flags"))


_FUNCTIONS = (
    narrowing_counter, conversation_history, recent_exchanges, history_budget, conversation_replay, turn_supersede, history_store, scope_pruned, outcome_classify, turn_latencies,
    framing_blocks, markers_grounding, cleaned_answers, numbered_citations, ungrounded, event_fold, sse_frames, required_devices, entry_expansion, entry_suggestions,
    narrowing_questions, prompts, entry_coverage,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_TURNS = """t AS (SELECT user_id AS conv_id, event_id AS turn, 'q' || event_id AS question,
  CASE WHEN event_id % 5 = 0 THEN 'needs-narrowing' WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 3 = 0 THEN 'partially-answered' WHEN event_id % 11 = 0 THEN 'needs-narrowing' ELSE 'answered' END AS outcome FROM events)"""
_ANSWERED = _TURNS.replace(" AS outcome FROM events", " AS outcome, 'a' || CAST(round(value, 1) AS VARCHAR) AS answer FROM events")
_TRANS = r"""
parts AS (SELECT doc_id AS turn_id, [trim(regexp_replace(substr(text, CAST(1 + ceil(length(text) / 7) * i AS BIGINT), CAST(ceil(length(text) / 7) AS BIGINT)), '[\n\r]', ' ', 'g')) for i in range(7)] AS p FROM documents),
lines AS (SELECT turn_id, [CASE WHEN turn_id % 10 = 0 THEN 'no outcome' ELSE 'answered' END, p[1] || ' [[p:m' || (turn_id % 9) || ']]', '---', '## ' || p[2], '1. ' || p[3] || ' [[p:m' || ((turn_id + 1) % 9) || ']]',
  '- ' || p[4] || ' [[p:m' || ((turn_id + 4) % 9) || ']] [[p:m' || ((turn_id + 1) % 9) || ']]', '!caveat ' || p[5], '  and more', '', '~uncovered ' || p[6], 'x' || p[7]] AS l FROM parts),
marks AS (SELECT turn_id, 1 AS pos, 0 AS nth, 'm' || (turn_id % 9) AS passage_id, true AS known FROM lines UNION ALL SELECT turn_id, 4, 0, 'm' || ((turn_id + 1) % 9), true FROM lines
  UNION ALL SELECT turn_id, 5, 0, 'm' || ((turn_id + 4) % 9), false FROM lines UNION ALL SELECT turn_id, 5, 1, 'm' || ((turn_id + 1) % 9), true FROM lines),
cites AS (SELECT turn_id, passage_id, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY min((pos, nth))) AS INT) AS number FROM marks WHERE known GROUP BY turn_id, passage_id)"""
_PID = "'src' || {s} || '#' || lpad(CAST({s} + 20 * {m} AS VARCHAR), 6, '0')"
_FIXES = f"""
p AS (SELECT source || '#' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS passage_id, label FROM documents JOIN embeddings ON doc_id = vec_id),
f AS (SELECT item_id AS qid, r + 1 AS rank, x AS fix, m AS nth, (item_id + r + x) % 20 AS s FROM benchmark, range(4) a(r), range(2) b(x), range(4) c(m)),
g AS (SELECT qid, rank, fix, nth, 'src' || s AS source_id, s % 2 = 0 AS selected, {_PID.format(s='s', m='nth')} AS passage_id FROM f),
u AS (SELECT g.*, g.selected AND p.passage_id IS NOT NULL AND (label = 0 OR label BETWEEN 1 AND 6) AS usable FROM g LEFT JOIN p USING (passage_id)),
h AS (SELECT item_id AS qid, {_PID.format(s='((item_id + 2) % 20)', m='m')} AS passage_id FROM benchmark, range(7) c(m)),
v AS (SELECT u.*, h.passage_id IS NOT NULL AS held, h.passage_id IS NULL AND row_number() OVER (PARTITION BY u.qid, u.passage_id ORDER BY rank, fix, nth) = 1 AS fresh FROM u LEFT JOIN h ON h.qid = u.qid AND h.passage_id = u.passage_id WHERE usable),
w AS (SELECT *, fresh AND sum(CAST(fresh AS INT)) OVER (PARTITION BY qid ORDER BY rank, fix, nth ROWS UNBOUNDED PRECEDING) <= 5 AS admitted FROM v),
c AS (SELECT *, held OR bool_or(admitted) OVER (PARTITION BY qid, passage_id) AS cited FROM w)"""

ORACLES = {
    "narrowing_counter": f"""WITH {_TURNS}, r AS (SELECT *, coalesce(sum(CASE WHEN outcome IN ('answered', 'partially-answered') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM t),
n AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'needs-narrowing' THEN 1 ELSE 0 END) OVER w, 0) AS k, first_value(CASE WHEN outcome = 'needs-narrowing' THEN question END IGNORE NULLS) OVER w AS symptom FROM r WINDOW w AS (PARTITION BY conv_id, run ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, CAST(k AS BIGINT) AS narrowing_count, CASE WHEN symptom IS NOT NULL THEN symptom || ' ' || question ELSE question END AS retrieval_query FROM n""",
    "conversation_history": f"""WITH {_TURNS}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t WHERE outcome <> 'timeout'),
l AS (SELECT t.conv_id, t.turn, (SELECT count(*) FROM c WHERE c.conv_id = t.conv_id AND c.turn < t.turn) AS k FROM t)
SELECT l.conv_id, l.turn, coalesce(string_agg('Q: ' || c.question || chr(10) || 'A: ' || c.question, '|' ORDER BY c.n), '') AS history FROM l LEFT JOIN c ON c.conv_id = l.conv_id AND c.n BETWEEN l.k - 5 AND l.k GROUP BY l.conv_id, l.turn""",
    "conversation_replay": f"""WITH {_ANSWERED}, r AS (SELECT *, coalesce(sum(CASE WHEN outcome IN ('answered', 'partially-answered') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM t),
n AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'needs-narrowing' THEN 1 ELSE 0 END) OVER w, 0) AS k, first_value(CASE WHEN outcome = 'needs-narrowing' THEN question END IGNORE NULLS) OVER w AS symptom FROM r WINDOW w AS (PARTITION BY conv_id, run ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM t WHERE outcome <> 'timeout'),
l AS (SELECT t.conv_id, t.turn, (SELECT count(*) FROM c WHERE c.conv_id = t.conv_id AND c.turn < t.turn) AS before FROM t),
h AS (SELECT l.conv_id, l.turn, CAST(least(l.before, 6) AS INT) AS history_size, coalesce(string_agg('Q: ' || c.question || chr(10) || 'A: ' || c.answer, chr(10) ORDER BY c.nth), '') AS history FROM l LEFT JOIN c ON c.conv_id = l.conv_id AND c.nth BETWEEN l.before - 5 AND l.before GROUP BY l.conv_id, l.turn, l.before)
SELECT CAST(n.conv_id AS VARCHAR) AS conv_id, n.turn, CASE WHEN symptom IS NOT NULL THEN symptom || ' ' || question ELSE question END AS retrieval_query, CAST(k AS INT) AS narrowing_count, history_size, history FROM n JOIN h ON h.conv_id = n.conv_id AND h.turn = n.turn""",
    "recent_exchanges": f"WITH {_TURNS}, r AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS nth FROM t WHERE outcome <> 'timeout') SELECT * FROM r WHERE nth <= 6",
    "history_budget": r"WITH w AS (SELECT conv_id, turn, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\S+'))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM conversations) SELECT * FROM w WHERE spent <= 720",
    "turn_supersede": "SELECT event_id AS turn, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < ts + INTERVAL 6 HOURS, false) AS cancelled FROM events",
    "history_store": "WITH r AS (SELECT user_id % 20 AS client, event_id AS record_id, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS INT) AS nth, event_id % 4 = 0 AS incomplete FROM events WHERE event_id % 6 <> 0 AND event_id % 13 <> 0) SELECT * FROM r WHERE nth <= 50",
    "scope_pruned": "SELECT 'src' || (c_custkey % 30) AS source_id, c_custkey AS conv_id FROM customer WHERE 'src' || (c_custkey % 30) NOT IN (SELECT source FROM documents)",
    "outcome_classify": """WITH e AS (SELECT event_id AS k, CASE event_id % 10 WHEN 1 THEN 'unreachable' WHEN 2 THEN 'rate-limited' WHEN 3 THEN 'timeout' WHEN 4 THEN 'auth' WHEN 5 THEN 'error' END AS failure, CASE WHEN event_id % 3 = 0 THEN 'why' END AS why FROM events),
o AS (SELECT *, CASE WHEN k % 29 = 0 THEN 'corpus-empty' WHEN k % 23 = 0 THEN 'unknown-source-id' WHEN k % 19 = 0 THEN 'no-sources-selected' WHEN k % 17 = 0 OR (k % 13 = 0 AND k % 2 <> 0) OR (k % 11 = 0 AND k % 3 <> 0) THEN 'provider-unconfigured' END AS pre FROM e),
f AS (SELECT *, CASE WHEN pre IS NOT NULL THEN NULL WHEN k % 31 = 0 THEN 'cancelled' WHEN failure IS NOT NULL AND k % 7 = 0 THEN 'incomplete' WHEN failure IS NULL THEN NULL WHEN failure IN ('unreachable', 'rate-limited') THEN 'provider-' || failure WHEN failure = 'timeout' THEN 'timeout' ELSE 'provider-error' END AS fly FROM o),
x AS (SELECT *, coalesce(pre, fly, CASE k % 8 WHEN 6 THEN 'ranked-causes' WHEN 7 THEN CASE WHEN k % 5 = 0 THEN 'answered' ELSE 'refused-not-covered' END ELSE 'answered' END) AS outcome FROM f)
SELECT k AS event_id, outcome, CASE WHEN pre = 'provider-unconfigured' THEN CASE WHEN k % 17 = 0 THEN 'no-provider-kind' WHEN k % 13 = 0 AND k % 2 <> 0 THEN 'missing-credential' ELSE 'disclosure-unacknowledged' END WHEN fly = 'provider-error' THEN CASE WHEN failure = 'auth' THEN 'authentication-failed' ELSE 'provider-rejected' END ELSE '' END AS reason,
  coalesce(CASE WHEN pre = 'unknown-source-id' THEN 'unknown source id: a/x, b/y' WHEN pre IS NOT NULL OR fly IS NULL OR fly = 'cancelled' THEN NULL WHEN fly = 'provider-unreachable' THEN 'prov: ' || coalesce(why, 'connection failed') WHEN fly = 'timeout' THEN 'prov produced no first token within 10 s' ELSE why END, '') AS detail,
  CASE WHEN fly = 'provider-rate-limited' AND k % 4 = 0 THEN 1.5::DOUBLE ELSE 0 END AS retry_after,
  CASE WHEN outcome IN ('answered', 'incomplete') THEN 'answer' WHEN outcome IN ('ranked-causes', 'cancelled') THEN outcome WHEN outcome = 'refused-not-covered' THEN 'coverage-failure' WHEN outcome = 'no-sources-selected' THEN 'empty-scope' ELSE 'error' END AS view FROM x""",
    "turn_latencies": "WITH m AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN CAST(trunc(abs(value) * 100000) AS BIGINT) / 1000 END AS ms FROM events) SELECT event_id, coalesce(round(ms, 3), -1) AS ms, coalesce(ms > CASE WHEN event_id % 2 = 0 THEN 3000 ELSE 5000 END, false) AS slow FROM m",
    "markers_grounding": f"WITH {_TRANS} SELECT turn_id, number, passage_id, CAST(1 AS BIGINT) AS stripped FROM cites",
    "cleaned_answers": rf"""WITH {_TRANS}, e AS (SELECT turn_id, CAST(i AS INT) AS pos, l[i + 1] AS text FROM lines, range(11) r(i))
SELECT turn_id, pos, trim(regexp_replace(CASE WHEN pos = 5 THEN replace(text, '[[p:m' || ((turn_id + 4) % 9) || ']]', '') ELSE text END, '\s{{2,}}', ' ', 'g')) AS text, CAST(CASE WHEN pos = 5 THEN 1 ELSE 0 END AS BIGINT) AS stripped FROM e WHERE pos IN (1, 4, 5)""",
    "numbered_citations": f"WITH {_TRANS} SELECT turn_id, number, passage_id FROM cites UNION ALL SELECT turn_id, max(number) + 1, 'm' || ((turn_id + 2) % 9) FROM cites GROUP BY turn_id",
    "event_fold": """WITH e AS (SELECT user_id AS turn_id, event_id AS seq, CASE event_id % 9 WHEN 0 THEN 'outcome' WHEN 1 THEN 'direct_answer' WHEN 2 THEN 'done' ELSE 'body_delta' END AS name, 'p' || event_id AS payload FROM events)
SELECT turn_id, coalesce(arg_max(payload, seq) FILTER (name = 'outcome'), '') AS outcome, coalesce(arg_max(payload, seq) FILTER (name = 'direct_answer'), '') AS direct_answer, coalesce(string_agg(payload, '' ORDER BY seq) FILTER (name = 'body_delta'), '') AS body, bool_or(name = 'done') AS complete FROM e GROUP BY turn_id""",
    "sse_frames": "SELECT conv_id AS turn_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS seq, CASE WHEN turn % 3 = 0 THEN 'message' ELSE role END AS event, sha256(coalesce(text, '')) AS data FROM conversations QUALIFY turn % 4 <> 3",
    "required_devices": """WITH d AS (SELECT s_suppkey AS turn_id, n_name, n_nationkey % 2 = 0 AS gap, s_suppkey % 3 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT turn_id, CASE WHEN k = 2 THEN 'other thing' WHEN gap THEN 'acme/' || lower(n_name) WHEN k = 0 THEN lower(n_name) ELSE 'Acme/' || n_name END AS device, CASE WHEN gap AND k < 2 THEN n_name ELSE '' END AS display_name, CASE WHEN gap AND k < 2 THEN 'acme_' || lower(n_name) || '_<doctype>_v<version>_<lang>.pdf' ELSE '' END AS filename FROM d""",
    "entry_expansion": f"""WITH {_FIXES}, o AS (SELECT qid, rank, passage_id, min((fix, nth)) AS pl FROM c WHERE cited GROUP BY ALL), a AS (SELECT qid, rank, string_agg(passage_id, ',' ORDER BY pl) AS ids FROM o GROUP BY ALL)
SELECT b.item_id AS qid, CAST(r + 1 AS INT) AS rank, 'cause ' || r AS statement, coalesce(ids, '') AS fix_cites, ids IS NULL AS unbacked FROM benchmark b CROSS JOIN range(4) x(r) LEFT JOIN a ON a.qid = b.item_id AND a.rank = r + 1""",
    "entry_suggestions": f"WITH {_FIXES}, m AS (SELECT qid, source_id, min((rank, fix)) AS pl FROM g WHERE NOT selected GROUP BY ALL) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY pl) AS INT) AS nth, source_id FROM m",
    "narrowing_questions": """WITH c AS (SELECT item_id AS qid, r FROM benchmark, range(4) x(r) WHERE NOT (r = 0 AND item_id % 2 = 0) AND NOT (r = 1 AND item_id % 3 = 0) AND NOT (r = 2 AND item_id % 6 = 0))
SELECT qid, 'Which of these do you observe for "sym ' || qid || '"?' AS question, string_agg('check ' || r || '=cause ' || r, ',' ORDER BY r) AS candidates FROM c GROUP BY qid HAVING count(*) >= 2""",
}
ORACLES["sse_frames"] = "SELECT * EXCLUDE (turn) FROM (" + ORACLES["sse_frames"].replace("AS data FROM", "AS data, turn FROM").replace(" QUALIFY turn % 4 <> 3", "") + ") WHERE turn % 4 <> 3"


def scope_restore(spark, sf_dir):
    """Customers as clients with stored selections of several kinds."""
    from ..operators import client

    k = F.col("c_custkey")
    ids = lambda *ns: F.array(*[F.concat(F.lit("src"), ((k + n) % 24).cast("string")) for n in ns])
    stored = X.table(spark, sf_dir, "customer").select(
        k.alias("client"), F.when(k % 9 > 0, ids(0, 3, 5)).alias("selected"), F.when(k % 4 == 0, ids(0, 3, 5)).otherwise(ids(0, 3, 5, 7)).alias("known"),
        F.when(k % 5 == 0, ids(1, 2)).alias("released"), (k % 13).alias("hours"), (k % 2 == 0).alias("same_session"),
    )
    available = F.array(*[F.lit(f"src{i}") for i in range(20)])
    out = client.restore_scope(stored, available)
    return out.select("client", F.array_join("restored", ",").alias("restored"), F.coalesce(F.array_join("released", ","), F.lit("")).alias("released"))


def sse_output(spark, sf_dir):
    from ..operators import client

    e = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("seq"), F.col("role").alias("name"), F.coalesce("text", F.lit("")).alias("payload"))
    return client.sse_stream(e).select("qid", F.sha2("stream", 256).alias("digest"))


def record_faults(spark, sf_dir):
    """Passages of which some break the rules of their kind."""
    from .. import schemas

    k = F.col("doc_id")
    p = X.table(spark, sf_dir, "documents").select(
        k, F.when(k % 5 == 0, schemas.AUTHORED_SOURCE).otherwise(F.col("source")).alias("source_id"), F.when(k % 7 == 0, "1.2").alias("section_number"),
        F.when(k % 5 > 0, k % 11).cast("int").alias("page_start"), F.when((k % 5 > 0) & (k % 17 > 0), 5).cast("int").alias("page_end"), F.when((k % 5 == 0) & (k % 3 > 0) | (k % 29 == 0), "f:1").alias("entry_location"),
    )
    return schemas.faults(p, schemas.passage_fault()).select("doc_id", "fault")


QUERIES |= {f.__name__: f for f in (scope_restore, sse_output, record_faults)}
ORACLES |= {
    "scope_restore": """WITH a AS (SELECT ['src' || i for i in range(20)] AS av), c AS (SELECT c_custkey AS client, CASE WHEN c_custkey % 9 > 0 THEN ['src' || ((c_custkey + n) % 24) for n in [0, 3, 5]] END AS selected,
  CASE WHEN c_custkey % 4 = 0 THEN ['src' || ((c_custkey + n) % 24) for n in [0, 3, 5]] ELSE ['src' || ((c_custkey + n) % 24) for n in [0, 3, 5, 7]] END AS known,
  CASE WHEN c_custkey % 5 = 0 THEN ['src' || ((c_custkey + n) % 24) for n in [1, 2]] ELSE [] END AS released, c_custkey % 13 AS hours, c_custkey % 2 = 0 AS same FROM customer),
k AS (SELECT *, [x for x in selected if list_contains(av, x)] AS kept, [x for x in known if list_contains(av, x)] AS kn FROM c, a),
r AS (SELECT *, CASE WHEN len([x for x in kn if NOT list_contains(kept, x)]) = 0 THEN av ELSE kept END AS res FROM k),
l AS (SELECT *, (NOT same OR hours > 8) AND len(res) < 20 AS lifted FROM r)
SELECT client, array_to_string(CASE WHEN selected IS NULL OR lifted THEN av ELSE res END, ',') AS restored, coalesce(array_to_string(CASE WHEN selected IS NULL THEN [] WHEN lifted THEN res ELSE [x for x in released if list_contains(av, x)] END, ','), '') AS released FROM l""",
    "sse_output": "SELECT conv_id AS qid, sha256(string_agg('event: ' || role || chr(10) || 'data: ' || replace(coalesce(text, ''), chr(10), chr(10) || 'data: ') || chr(10) || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "record_faults": """WITH p AS (SELECT doc_id, doc_id % 5 = 0 AS authored, doc_id % 7 = 0 AS numbered, CASE WHEN doc_id % 5 > 0 THEN doc_id % 11 END AS a, CASE WHEN doc_id % 5 > 0 AND doc_id % 17 > 0 THEN 5 END AS b, (doc_id % 5 = 0 AND doc_id % 3 > 0) OR doc_id % 29 = 0 AS located FROM documents),
f AS (SELECT doc_id, CASE WHEN authored AND numbered THEN 'section_number on a passage without pages' WHEN authored AND NOT located THEN 'entry_location is missing' WHEN NOT authored AND a IS NULL THEN 'page_start is missing' WHEN NOT authored AND b IS NULL THEN 'page_end is missing' WHEN NOT authored AND b < a THEN 'page_end before page_start' WHEN NOT authored AND located THEN 'entry_location on a passage with pages' END AS fault FROM p)
SELECT * FROM f WHERE fault IS NOT NULL""",
}
