"""What a client keeps between sessions, as set operations over its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELEASE_HOURS = 8
#: How long a turn waits for session state.
STATE_MS = 100


def restore_scope(stored: DataFrame, available: Column) -> DataFrame:
    """Adds restored, released: a client's selection against the sources that there are.

    stored(client, selected, known, released, hours, same_session); available:
    array of source ids. Ids that are gone are dropped; new sources join only a
    scope that was everything known then. A new session, or more than eight
    hours, lifts a narrowing and remembers it. No stored scope: all, nothing
    released.
    """
    kept = F.array_intersect("selected", available)
    was_all = F.size(F.array_except(F.array_intersect("known", available), kept)) == 0
    restored = F.when(was_all, available).otherwise(kept)
    fresh = ~F.col("same_session") | (F.col("hours") > RELEASE_HOURS)
    rows = stored.withColumns({"_r": restored, "_a": available})
    lifted = fresh & (F.size("_r") < F.size("_a"))
    some = lambda c: F.when(F.size(c) > 0, c)
    carried = F.array_intersect(F.coalesce("released", F.array().cast("array<string>")), F.col("_a"))
    nothing = F.col("selected").isNull()
    return rows.withColumns(
        {
            "restored": F.when(nothing | lifted, F.col("_a")).otherwise(F.col("_r")),
            "released": F.when(nothing, None).when(lifted, some(F.col("_r"))).otherwise(some(carried)),
        }
    ).drop("_r", "_a")


def sources_state(reachable: Column, count: Column) -> Column:
    return F.when(~reachable, "unreachable").when(count == 0, "corpus-empty").otherwise("ready")


def acquired(state: Column, latency_ms: Column) -> Column:
    """Session state that came in time; late or failed state is absent, never an error."""
    return F.when(latency_ms <= STATE_MS, state)


def sse_frame(name: Column, payload: Column) -> Column:
    """An event as a server-sent frame; line ends in the payload become further data lines."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.replace(payload, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))


def sse_stream(events: DataFrame, key: str = "qid") -> DataFrame:
    """(key, stream) of a turn's events (seq, name, payload)."""
    frames = F.transform(F.array_sort(F.collect_list(F.struct("seq", sse_frame(F.col("name"), F.col("payload")).alias("f")))), lambda x: x["f"])
    return events.groupBy(key).agg(F.array_join(frames, "").alias("stream"))
