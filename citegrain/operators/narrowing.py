"""From a retrieved entry to its causes: which fixes a turn may cite, and the question that tells causes apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .retrieval import in_device_scope

CAUSES, FEWEST, CAP = 4, 2, 12


def matched_entry(supplied: DataFrame, sidecar: DataFrame) -> DataFrame:
    """(qid, passage_id, entry): of the supplied passages in order, the first that belongs to an entry."""
    first = F.row_number().over(Window.partitionBy("qid").orderBy("position"))
    return supplied.join(sidecar, "passage_id").withColumn("_n", first).where("_n = 1").drop("_n")


def fix_candidates(matched: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, rank, fix, nth, passage_id, source_id, selected, usable) of the first four causes' pointers.

    matched(qid, passage_id, causes: array of (statement, check, fix: array of
    (source_id, section, passage_ids))), passages(passage_id, devices),
    questions(qid, sources, scope).
    """
    causes = matched.select("qid", F.posexplode(F.slice("causes", 1, CAUSES)).alias("i", "c"))
    fixes = causes.select("qid", (F.col("i") + 1).alias("rank"), F.posexplode("c.fix").alias("fix", "f"))
    scoped = fixes.join(questions.select("qid", "sources", "scope"), "qid").withColumn("selected", F.array_contains("sources", F.col("f.source_id")))
    rows = scoped.select("qid", "rank", "fix", F.col("f.source_id").alias("source_id"), "selected", "scope", F.posexplode_outer("f.passage_ids").alias("nth", "passage_id"))
    known = passages.select("passage_id", "devices", F.lit(True).alias("_known"))
    joined = rows.join(known, "passage_id", "left")
    usable = F.col("selected") & F.coalesce("_known", F.lit(False)) & in_device_scope(F.col("devices"), F.col("scope"))
    return joined.select("qid", "rank", "fix", "nth", "passage_id", "source_id", "selected", usable.alias("usable"))


def admit(fixes: DataFrame, supplied: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds cited and admitted: passages supplied already are cited for nothing; others while the cap has room, in order of cause and pointer."""
    have = supplied.select("qid", "passage_id").distinct()
    room = F.greatest(F.lit(0), cap - F.count(F.lit(1)))
    budget = have.groupBy("qid").agg(room.alias("budget"))
    rows = fixes.where("usable").join(have.withColumn("held", F.lit(True)), ["qid", "passage_id"], "left").join(budget, "qid", "left")
    order = ["rank", "fix", "nth"]
    first = F.row_number().over(Window.partitionBy("qid", "passage_id").orderBy(*order)) == 1
    rows = rows.withColumn("fresh", F.col("held").isNull() & first)
    taken = F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("qid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("admitted", F.col("fresh") & (taken <= F.coalesce("budget", F.lit(cap))))
    any_in = F.max(F.col("admitted")).over(Window.partitionBy("qid", "passage_id"))
    return rows.withColumn("cited", F.col("held").isNotNull() | any_in)


def causes_of(matched: DataFrame, admitted: DataFrame) -> DataFrame:
    """(qid, rank, statement, check, cites, fix_cites, unbacked): in the entry's order; a cause without a citable fix is unbacked this turn."""
    causes = matched.select("qid", "passage_id", F.posexplode(F.slice("causes", 1, CAUSES)).alias("i", "c"))
    place = F.struct("fix", "nth")
    once = admitted.where("cited").groupBy("qid", "rank", "passage_id").agg(F.min(place).alias("at"))
    cites = once.groupBy("qid", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "passage_id"))), lambda x: x["passage_id"]).alias("fix_cites"))
    rows = causes.select("qid", (F.col("i") + 1).alias("rank"), F.col("c.statement").alias("statement"), F.col("c.check").alias("check"), F.array("passage_id").alias("cites"))
    joined = rows.join(cites, ["qid", "rank"], "left").withColumn("fix_cites", F.coalesce("fix_cites", F.array().cast("array<string>")))
    return joined.withColumn("unbacked", F.size("fix_cites") == 0)


def suggested_sources(fixes: DataFrame) -> DataFrame:
    """(qid, nth, source_id): sources outside the selection that hold a fix, by first mention."""
    first = fixes.where("NOT selected").groupBy("qid", "source_id").agg(F.min(F.struct("rank", "fix")).alias("at"))
    return first.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("nth"), "source_id")


def narrowing(matched: DataFrame, supplied_values: DataFrame | None = None) -> DataFrame:
    """(qid, question, candidates): one for each cause that session state doesn't settle; fewer than two ask nothing.

    supplied_values(qid, value): statements that state already answers.
    """
    rows = matched.select("qid", "symptom", F.posexplode(F.slice("causes", 1, CAUSES)).alias("i", "c")).select("qid", "symptom", "i", F.col("c.check").alias("label"), F.col("c.statement").alias("value"))
    if supplied_values is not None:
        rows = rows.join(supplied_values, ["qid", "value"], "left_anti")
    listed = rows.groupBy("qid", "symptom").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "label", "value"))), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))).alias("candidates"))
    question = F.concat(F.lit('Which of these do you observe for "'), F.col("symptom"), F.lit('"?'))
    return listed.where(F.size("candidates") >= FEWEST).select("qid", question.alias("question"), "candidates")
