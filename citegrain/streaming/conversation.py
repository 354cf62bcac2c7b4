"""Conversation state over a stream of turns.

One key is one conversation. Its state is bounded: the last six exchanges, the
narrowing counter and the symptom it began with. ``fold`` is the rule for one
turn; the streaming operator and batch replay share it, and the window form in
``operators.conversation`` gives the same results for whole tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.conversation import CONTENT_OUTCOMES, HISTORY_TURNS, NARROWING
from ..runtime import ship

STATE = "turns string, narrowing int, symptom string"
OUT = "conv_id string, turn long, retrieval_query string, narrowing_count int, history_size int, history string"


def fold(state: tuple[list, int, str | None], question: str, outcome: str, answer: str) -> tuple[list, int, str | None]:
    """State after a turn: (exchanges, narrowing count, symptom). Engine outcomes change nothing."""
    turns, count, symptom = state
    if outcome not in CONTENT_OUTCOMES:
        return state
    turns = [*turns, [question, answer]][-HISTORY_TURNS:]
    if outcome == NARROWING:
        return turns, count + 1, symptom if count else question
    return turns, 0, None


def seen_before(state: tuple[list, int, str | None], question: str) -> tuple[str, int, int, str]:
    """What a turn works with: retrieval query, narrowing count, size and text of the history."""
    turns, count, symptom = state
    query = f"{symptom} {question}" if count and symptom is not None else question
    return query, count, len(turns), "\n".join(f"Q: {q}\nA: {a}" for q, a in turns)


def _update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    if held.hasTimedOut:
        held.remove()
        return
    raw = held.get if held.exists else ("[]", 0, None)
    state = (json.loads(raw[0]), raw[1], raw[2])
    batch = pd.concat(list(frames)).sort_values("turn", kind="stable")
    rows = []
    for turn, question, outcome, answer in batch[["turn", "question", "outcome", "answer"]].itertuples(index=False):
        rows.append((key[0], turn, *seen_before(state, question or "")))
        state = fold(state, question or "", outcome, answer or "")
    held.update((json.dumps(state[0]), state[1], state[2]))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def stream_conversations(turns: DataFrame) -> DataFrame:
    """For each turn what its conversation knew before it. turns(conv_id string, turn, question, outcome, answer), a stream.

    Turns of one micro-batch are taken by number; a turn that arrives in a
    later batch than its successor is folded in when it comes. State is kept
    until it is removed; its size doesn't grow with the conversation.
    """
    ship(turns.sparkSession)
    return turns.groupBy("conv_id").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(turns: DataFrame) -> DataFrame:
    """The same for a table, one conversation a group."""
    ship(turns.sparkSession)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        state: tuple[list, int, str | None] = ([], 0, None)
        rows = []
        for turn, question, outcome, answer in group.sort_values("turn")[["turn", "question", "outcome", "answer"]].itertuples(index=False):
            rows.append((key[0], turn, *seen_before(state, question or "")))
            state = fold(state, question or "", outcome, answer or "")
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return turns.groupBy("conv_id").applyInPandas(run, OUT)


def supersede_stream(turns: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Newest turn of each conversation and window, over event time with a bound on lateness."""
    return turns.withWatermark("started", delay).groupBy(F.window("started", "1 minute"), "conv_id").agg(F.max_by("turn", "started").alias("turn"), F.count(F.lit(1)).alias("asked"))
