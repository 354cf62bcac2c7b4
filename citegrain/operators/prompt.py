"""The text that a model is asked with, assembled by joins: passages, unselected sources, state, history, question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE_SECONDS, NARROWING_LIMIT = 60, 2
PASSAGES = "## Passages\nCite each by its marker, exactly as it stands."
ROSTER = "## Sources that are not selected\nNames alone; only these may be suggested."
STATE = "## Session state\nObserved values. They are no passages and can't be cited."
STALE = "Some of these values are from a saved file or older than a minute: say that they may be out of date."
HISTORY = "## History (for context, not to be cited)"
LIMIT = "## No more narrowing\nTwo narrowing questions were asked. Rank the candidate causes instead, most likely first."


def _block(head: str, lines, key: str, order: str, text: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return lines.groupBy(key).agg(F.concat_ws("\n", F.lit(head), F.array_join(ordered, "\n")).alias("block"))


def passages_block(supplied: DataFrame, passages: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, block) of the supplied passages in order; supplied(qid, position, passage_id)."""
    rows = supplied.join(passages.select("passage_id", "source_id", "text"), "passage_id").join(sources.select("source_id", "display_name", "kind"), "source_id")
    line = F.concat(F.lit("\n[[p:"), "passage_id", F.lit("]] "), "display_name", F.lit(" ("), "kind", F.lit(")\n"), "text")
    return _block(PASSAGES, rows.withColumn("line", line), "qid", "position", "line")


def roster_block(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, block) of sources that a question doesn't select.

    The whole list is put together once; a question takes out the lines of what
    it selects, so questions and sources never meet pair by pair.
    """
    line = F.concat(F.lit("- "), F.concat_ws(" | ", "source_id", "display_name", F.coalesce("product", F.lit("")), "kind"))
    every = sources.agg(F.array_sort(F.collect_list(F.struct("source_id", line.alias("line")))).alias("every"))
    left = F.filter("every", lambda x: ~F.array_contains("sources", x["source_id"]))
    rows = questions.select("qid", "sources").crossJoin(every).select("qid", F.transform(left, lambda x: x["line"]).alias("lines"))
    return rows.where(F.size("lines") > 0).select("qid", F.concat_ws("\n", F.lit(ROSTER), F.array_join("lines", "\n")).alias("block"))


def state_block(state: DataFrame) -> DataFrame:
    """(qid, block) of state(qid, key, value, observed_at, now, origin, origin_kind)."""
    age = F.unix_timestamp("now") - F.unix_timestamp("observed_at")
    line = F.concat(F.lit("- "), "key", F.lit(" = "), "value", F.lit(" (origin: "), "origin", F.lit(", "), "origin_kind", F.lit(", age: "), age.cast("string"), F.lit("s)"))
    rows = state.withColumn("line", line).withColumn("stale", (F.col("origin_kind") == "saved-file") | (age > STALE_SECONDS))
    block = _block(STATE, rows, "qid", "key", "line")
    late = rows.groupBy("qid").agg(F.max("stale").alias("stale"))
    return block.join(late, "qid").select("qid", F.concat_ws("\n", "block", F.when(F.col("stale"), F.lit(STALE))).alias("block"))


def history_block(lines: DataFrame) -> DataFrame:
    """(qid, block) of history(qid, turn, line), oldest first; the caller has cut it to its budget."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return lines.groupBy("qid").agg(F.concat(F.lit(HISTORY + "\n\n"), F.array_join(ordered, "\n\n")).alias("block"))


def assemble(questions: DataFrame, passages: DataFrame, roster: DataFrame, state: DataFrame, history: DataFrame) -> DataFrame:
    """(qid, prompt): the blocks that a question has, in a fixed order, its text last. questions(qid, text, narrowing_count)."""
    out = questions.select("qid", "text", "narrowing_count")
    for name, part in (("p", passages), ("r", roster), ("s", state), ("h", history)):
        out = out.join(part.select("qid", F.col("block").alias(name)), "qid", "left")
    limit = F.when(F.col("narrowing_count") >= NARROWING_LIMIT, F.lit(LIMIT))
    return out.select("qid", F.concat_ws("\n\n", F.coalesce("p", F.lit(PASSAGES)), "r", "s", "h", limit, F.concat(F.lit("## Question\n"), "text")).alias("prompt"))
