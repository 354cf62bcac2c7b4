"""How a turn ends: gates before, during and after the answer, as one expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conversation import CONTENT_OUTCOMES

# Outcomes of the engine, and the reasons that refine them.
NO_KIND, NO_CREDENTIAL, NO_ACK = "no-provider-kind", "missing-credential", "disclosure-unacknowledged"
AUTH_FAILED, REJECTED = "authentication-failed", "provider-rejected"
#: The client's view for each outcome; anything else is `broken`.
VIEWS = {
    "answered": "answer", "partially-answered": "answer", "needs-narrowing": "narrowing", "ranked-causes": "ranked-causes",
    "refused-not-covered": "coverage-failure", "out-of-domain": "coverage-failure", "no-manual-for-device": "coverage-failure",
    "no-sources-selected": "empty-scope", "unknown-source-id": "error", "corpus-empty": "error", "provider-unconfigured": "error",
    "provider-unreachable": "error", "provider-rate-limited": "error", "provider-error": "error", "timeout": "error",
    "incomplete": "answer", "cancelled": "cancelled",
}


def _verdict(outcome: str, reason: str | None = None, detail: Column | None = None, retry_after: Column | None = None) -> Column:
    return F.struct(
        F.lit(outcome).alias("outcome"),
        F.lit(reason).cast("string").alias("reason"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
        (F.lit(None) if retry_after is None else retry_after).cast("double").alias("retry_after"),
    )


def _first(*rules: tuple[Column, Column]) -> Column:
    """The verdict of the first rule that holds; null conditions don't."""
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out


def pre_flight(g: Column) -> Column:
    """Verdict struct before any provider is asked, or null.

    g: passage_count, unknown_source_ids, selected_count, provider_kind,
    requires_key, credential_stored, requires_ack, acknowledged.
    """
    named = F.concat(F.lit("unknown source id: "), F.array_join(g["unknown_source_ids"], ", "))
    return _first(
        (F.coalesce(g["passage_count"], F.lit(0)) == 0, _verdict("corpus-empty")),
        (F.size(g["unknown_source_ids"]) > 0, _verdict("unknown-source-id", detail=named)),
        (F.coalesce(g["selected_count"], F.lit(0)) == 0, _verdict("no-sources-selected")),
        (g["provider_kind"].isNull(), _verdict("provider-unconfigured", NO_KIND)),
        (g["requires_key"] & ~g["credential_stored"], _verdict("provider-unconfigured", NO_CREDENTIAL)),
        (g["requires_ack"] & ~g["acknowledged"], _verdict("provider-unconfigured", NO_ACK)),
    )


def in_flight(f: Column) -> Column:
    """Verdict struct of what went wrong while streaming, or null. f: cancelled, streamed, failure, retry_after, provider, detail."""
    failed = f["failure"].isNotNull()
    return _first(
        (f["cancelled"], _verdict("cancelled")),
        (failed & f["streamed"], _verdict("incomplete", detail=f["detail"])),
        (f["failure"] == "unreachable", _verdict("provider-unreachable", detail=F.concat(f["provider"], F.lit(": "), F.coalesce(f["detail"], F.lit("connection failed"))))),
        (f["failure"] == "rate-limited", _verdict("provider-rate-limited", detail=f["detail"], retry_after=f["retry_after"])),
        (f["failure"] == "timeout", _verdict("timeout", detail=F.concat(f["provider"], F.lit(" produced no first token within 10 s")))),
        (f["failure"] == "auth", _verdict("provider-error", AUTH_FAILED, detail=f["detail"])),
        (failed, _verdict("provider-error", REJECTED, detail=f["detail"])),
    )


def classify(gate: Column, flight: Column, line_one: Column, covered: Column) -> Column:
    """One outcome for any turn: gates first, then the flight, then a valid first line, else by coverage alone."""
    token = F.trim(F.regexp_replace(line_one, r"(?U)^\s+|\s+$", ""))
    stated = _first(*[(token == o, _verdict(o)) for o in CONTENT_OUTCOMES])
    fallback = F.when(covered, _verdict("answered")).otherwise(_verdict("refused-not-covered"))
    return F.coalesce(pre_flight(gate), in_flight(flight), stated, fallback)


def view_of(outcome: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in VIEWS.items() for x in kv])
    return F.coalesce(F.element_at(known, outcome), F.lit("broken"))


def latency(start: Column, end: Column) -> Column:
    """A difference in milliseconds; absent if either end is."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000


def is_slow(ms: Column, hosted: Column) -> Column:
    return ms > F.when(hosted, 3000).otherwise(5000)
