"""The entry store evaluated against an index: what is served, what is refused and why, and what is remarked on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entries
from ..runtime import Workspace

#: Which refusal of an entry is told, if there are several.
ORDER = ("duplicate", "scope", "pointer")


@dataclass
class Evaluation:
    """parsed: every file; kept: entries that are served; rejections(source_file, reason, cause, detail); flags(source_file, name, rank, detail); checked: pointers with their state."""

    parsed: DataFrame
    kept: DataFrame
    rejections: DataFrame
    flags: DataFrame
    checked: DataFrame

    def term_missed(self) -> bool:
        return not self.flags.where("name = 'term-not-in-passage'").isEmpty()


def pointers_of(good: DataFrame) -> DataFrame:
    """A row for each pointer of each cause: pid, source_file, rank, cause, nth, entry_key, and the pointer's parts."""
    causes = good.select("source_file", "symptom", "devices", F.posexplode("causes").alias("i", "c"))
    fixes = causes.select("source_file", "symptom", "devices", (F.col("i") + 1).alias("rank"), F.col("c.statement").alias("cause"), F.posexplode("c.fixes").alias("nth", "p"))
    pid = F.concat_ws("|", "source_file", F.col("rank").cast("string"), F.col("nth").cast("string"))
    return fixes.select(pid.alias("pid"), "source_file", "rank", "cause", "nth", T.entry_key(F.col("symptom"), F.col("devices.id")).alias("entry_key"), "p.source_id", "p.number", "p.title")


def resolutions(checked: DataFrame, passages: DataFrame) -> DataFrame:
    """(source_file, rank, text) of the passages that a cause's resolved pointers lead to; passages without text say nothing."""
    led = checked.where("state = 'ok'").select("source_file", "rank", F.explode("passage_ids").alias("passage_id"))
    return led.join(passages.where("text IS NOT NULL").select("passage_id", "text"), "passage_id").select("source_file", "rank", "text")


def evaluate(ws: Workspace, files: DataFrame, passages: DataFrame, indexed: DataFrame, devices: DataFrame, ledger: DataFrame) -> Evaluation:
    """Parse, find duplicates, check scope, pointers and terms, over the whole store. Nothing is written but work tables.

    files(source_file, content), passages(source_id, passage_id,
    section_number, section_title, position, text) of the manuals' index,
    indexed(device_id), devices(device_id, display_name, revision).
    """
    parsed = ws.put("parsed", entries.parse_entries(files))
    good = parsed.where("reason IS NULL")
    doubled = entries.duplicate_symptoms(good.select("source_file", "symptom", F.col("devices.id").alias("device_ids")))
    scope = ws.put("scope", entries.scope_findings(good, devices, indexed))
    sections = entries.sections_of(passages.withColumn("row_id", F.col("position")))
    checked = ws.put("checked", entries.check_pointers(entries.resolve_pointers(pointers_of(good), sections), ledger))

    row = lambda kind, reason, cause, detail: ("source_file", F.lit(ORDER.index(kind)).alias("place"), reason.alias("reason"), cause.alias("cause"), detail.alias("detail"))
    null = F.lit(None).cast("string")
    refused = doubled.select(*row("duplicate", F.lit("duplicate-symptom"), null, F.col("other")))
    # The undocumented claim comes after the devices' own fault.
    refused = refused.unionByName(scope.where("rejects").groupBy("source_file").agg(F.min_by(F.struct("finding", "device"), F.struct(F.col("finding") != "all-devices-unrecognised", "device")).alias("f")).select(*row("scope", F.col("f.finding"), null, F.col("f.device"))))
    # Of an entry's refused pointers the first is told.
    first = checked.where("state = 'rejected'").groupBy("source_file").agg(F.min_by(F.struct("reason", "cause", "pointer", "candidates"), F.struct("rank", "nth")).alias("p"))
    named = F.when(F.col("p.reason") == "authored-target", "pointer-authored-target").otherwise("pointer-unresolved")
    told = F.concat_ws(": ", F.col("p.pointer"), F.col("p.reason"), F.when(F.size("p.candidates") > 0, F.array_join("p.candidates", ", ")))
    refused = refused.unionByName(first.select(*row("pointer", named, F.col("p.cause"), told)))
    one = refused.groupBy("source_file").agg(F.min_by(F.struct("reason", "cause", "detail"), "place").alias("r")).select("source_file", "r.reason", "r.cause", "r.detail")
    rejections = ws.put("rejections", parsed.where("reason IS NOT NULL").select("source_file", "reason", "cause", null.alias("detail")).unionByName(one))

    kept = ws.put("kept", good.join(rejections.select("source_file"), "source_file", "left_anti"))
    live = lambda df: df.join(kept.select("source_file"), "source_file", "left_semi")
    mine = live(checked)
    flag = lambda df, name, rank, detail: df.select("source_file", F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), rank.cast("int").alias("rank"), detail.alias("detail"))
    none = F.lit(None)
    split = kept.select("source_file", F.explode("flags").alias("f"))
    flags = flag(split, F.substring_index("f", ":", 1), none, F.nullif(F.expr("substring(f, length(substring_index(f, ':', 1)) + 2)"), F.lit("")))
    flags = flags.unionByName(flag(live(scope.where("NOT rejects")), F.col("finding"), none, F.col("device")))
    flags = flags.unionByName(flag(mine.where("state = 'drifted'"), "pointer-drifted", F.col("rank"), F.col("pointer")))
    flags = flags.unionByName(flag(mine.where("state = 'ok' AND disagrees"), "title-number-disagreement", F.col("rank"), F.col("pointer")))
    claims = kept.select("source_file", F.posexplode("causes").alias("i", "c")).where("c.undocumented IS NOT NULL")
    flags = flags.unionByName(flag(claims, "unbacked-cause", F.col("i") + 1, F.col("c.undocumented")))
    missed = entries.term_misses(entries.cause_terms(kept, devices), resolutions(mine, passages))
    flags = flags.unionByName(flag(missed, "term-not-in-passage", F.col("rank"), F.col("term")))
    return Evaluation(parsed, kept, rejections, ws.put("flags", flags), checked)


def unbacked(e: Evaluation) -> DataFrame:
    """(source_file, rank) of causes that no manual backs now: a pointer has drifted, or there is no manual."""
    return e.flags.where("name IN ('pointer-drifted', 'unbacked-cause')").select("source_file", "rank").distinct()


def counts(e: Evaluation) -> str:
    """The counts line: flagged counts files."""
    return entries.counts_line(e.kept.count(), e.rejections.count(), e.flags.select("source_file").distinct().count())


def store_lines(e: Evaluation, ledger_missing: bool = False) -> list[str]:
    """The counts, then each refusal and remark; a missing ledger first, as it explains the rest."""
    out = [counts(e)]
    if ledger_missing:
        out.append("  the pointer ledger is missing: a pointer that doesn't resolve now is refused, though it may have resolved before")
    for r in e.rejections.orderBy("source_file").collect():
        out.append("  " + " — ".join(x for x in (r.source_file, r.reason, r.cause and f'cause "{r.cause}"', r.detail) if x))
    for r in e.flags.orderBy("source_file", F.coalesce("rank", F.lit(0)), "name", "detail").collect():
        out.append("  " + " — ".join(x for x in (r.source_file, r["name"], r["rank"] and f"cause {r['rank']}", r.detail) if x))
    return out


def coverage(e: Evaluation, devices: DataFrame) -> dict[str, DataFrame]:
    """The coverage report's tables: entries served, refused and flagged files, gear without entries, unbacked causes, drifted pointers, orphans."""
    causes = e.kept.select("source_file", "symptom", F.explode("causes").alias("c"))
    resolved = e.checked.groupBy("source_file").agg(F.min(F.col("state") == "ok").alias("resolved"))
    served = e.kept.join(resolved, "source_file", "left")
    symptoms = e.kept.select("source_file", "symptom")
    return {
        "entries": served.select("source_file", "symptom", F.size("causes").alias("causes"), F.coalesce("resolved", F.lit(True)).alias("resolved")),
        "rejected": e.rejections,
        "flagged": e.flags,
        "uncovered": entries.uncovered_devices(devices, e.kept),
        "unbacked": causes.where("c.undocumented IS NOT NULL").select("source_file", "symptom", F.col("c.statement").alias("cause"), F.col("c.undocumented").alias("device")),
        "drifted": e.checked.where("state = 'drifted'").join(symptoms, "source_file").select("source_file", "symptom", "cause", "pointer", "source_id"),
        "orphaned": entries.orphaned_entries(e.kept, devices).select("source_file", "symptom", F.col("devices.id").alias("devices")),
    }


def coverage_lines(e: Evaluation, devices: DataFrame) -> list[str]:
    """The report as text. Parts without rows say so, as nothing found and nothing looked for are different things."""
    t = coverage(e, devices)
    said = {
        "entries": lambda r: f'{r.source_file} — "{r.symptom}"  {r.causes} causes, {"resolved" if r.resolved else "not resolved"}',
        "uncovered": lambda r: r.device_id,
        "unbacked": lambda r: f'{r.source_file} — "{r.symptom}"  cause "{r.cause}"  {r.device}',
        "drifted": lambda r: f'{r.source_file} — "{r.symptom}"  cause "{r.cause}"  {r.pointer}',
        "orphaned": lambda r: f'{r.source_file} — "{r.symptom}"  {", ".join(r.devices)}',
    }
    out = [counts(e)]
    for name, line in said.items():
        rows = t[name].collect()
        out += [f"{name}: {len(rows) or 'none'}", *sorted("  " + line(r) for r in rows)]
    return out
