"""Conversations in batch: what each turn sees of the turns before it. The streaming form is in ``streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HISTORY_TURNS = 6
HISTORY_TOKENS = 800 * 0.9
#: Outcomes that a model chooses, and that make an exchange worth remembering.
CONTENT_OUTCOMES = ("answered", "partially-answered", "needs-narrowing", "ranked-causes", "refused-not-covered", "out-of-domain", "no-manual-for-device")
NARROWING = "needs-narrowing"


def is_content(outcome: Column) -> Column:
    return F.coalesce(outcome.isin(*CONTENT_OUTCOMES), F.lit(False))


def exchange(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Q: "), F.coalesce(question, F.lit("")), F.lit("\nA: "), F.coalesce(answer, F.lit("")))


def narrowing_state(turns: DataFrame) -> DataFrame:
    """Adds narrowing_count and symptom as they stand before each turn, and retrieval_query.

    turns(conv_id, turn, question, outcome, answer). A run of narrowing turns
    counts up; another content outcome ends it; engine outcomes leave it. The
    answer to a narrowing question is looked up behind the run's first question.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    content, narrowing = is_content(F.col("outcome")), F.coalesce(F.col("outcome") == NARROWING, F.lit(False))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumns({"_content": content, "_narrow": narrowing})
    # A run is what follows the last content turn that didn't narrow.
    rows = rows.withColumn("_run", F.coalesce(F.sum(F.when(F.col("_content") & ~F.col("_narrow"), 1).otherwise(0)).over(before), F.lit(0)))
    inside = Window.partitionBy("conv_id", "_run").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    count = F.coalesce(F.sum(F.when(F.col("_narrow"), 1).otherwise(0)).over(inside), F.lit(0))
    symptom = F.first(F.when(F.col("_narrow"), F.col("question")), ignorenulls=True).over(inside)
    rows = rows.withColumns({"narrowing_count": count, "symptom": symptom})
    return rows.withColumn("retrieval_query", F.when(F.col("symptom").isNotNull(), F.concat_ws(" ", "symptom", "question")).otherwise(F.col("question"))).drop("_content", "_narrow", "_run")


def history(turns: DataFrame, keep: int = HISTORY_TURNS) -> DataFrame:
    """Adds history: the last exchanges with content outcomes before each turn, oldest first.

    A content turn holds itself and the few before it, and every turn takes the
    last such list: no frame is gathered, however long a conversation is.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    content = turns.where(is_content(F.col("outcome"))).withColumn("_said", exchange(F.col("question"), F.col("answer")))
    lists = content.select("conv_id", "turn", F.array_compact(F.array(*[F.lag("_said", n).over(w) for n in range(keep - 1, 0, -1)], "_said")).alias("_upto"))
    before = F.last("_upto", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = turns.join(lists, ["conv_id", "turn"], "left")
    return joined.withColumn("history", F.coalesce(before, F.array().cast("array<string>"))).drop("_upto").select(*turns.columns, "history")


def recent_exchanges(turns: DataFrame, keep: int = HISTORY_TURNS) -> DataFrame:
    """(conv_id, turn, nth): the last content exchanges of each conversation, by rank, however long it is."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.where(is_content(F.col("outcome"))).withColumn("nth", back).where(F.col("nth") <= keep)


def within_budget(lines: DataFrame, tokens: str, budget: float = HISTORY_TOKENS) -> DataFrame:
    """The newest lines (conv_id, turn, tokens) that fit the budget together; the first that doesn't ends it."""
    spent = F.sum(tokens).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("spent", spent).where(F.col("spent") <= budget)


def prune_scope(carried: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Carried (conv_id, source_id) still in the corpus, and those dropped."""
    ids = sources.select("source_id")
    return carried.join(ids, "source_id", "left_semi"), carried.join(ids, "source_id", "left_anti")


def superseded(turns: DataFrame) -> DataFrame:
    """Adds cancelled: the conversation's next turn began before this one ended. turns(conv_id, started, ended)."""
    following = F.lead("started").over(Window.partitionBy("conv_id").orderBy("started", "turn"))
    return turns.withColumn("cancelled", F.coalesce(following < F.col("ended"), F.lit(False)))


def kept_history(records: DataFrame, keep: int = 50) -> DataFrame:
    """A client's list: the newest records whose outcome is worth keeping. records(client, at, outcome, complete)."""
    worth = ~F.col("outcome").isin("cancelled", "error", "empty")
    nth = F.row_number().over(Window.partitionBy("client").orderBy(F.desc("at"), F.desc("record_id")))
    return records.where(worth).withColumn("nth", nth).where(F.col("nth") <= keep).withColumn("incomplete", ~F.coalesce("complete", F.lit(False)))
