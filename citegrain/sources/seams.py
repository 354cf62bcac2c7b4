"""Where a run meets what isn't Spark's: session state and answers, as tables that a source or provider fills.

Nothing here is called from a task. A state source that fails or comes late
leaves a turn without state; a provider gives each prompt's stream, or none.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import client

STATE = "qid long, key string, value string, observed_at timestamp, now timestamp, origin string, origin_kind string"


class StateSource(Protocol):
    """Observed values for questions (qid): rows of STATE, and latency_ms, how long each question's came in."""

    def read(self, questions: DataFrame) -> DataFrame: ...


class Provider(Protocol):
    """Answers to prompts (qid, prompt): (qid, stream), a null stream where nothing came."""

    def answer(self, prompts: DataFrame) -> DataFrame: ...


class StateTable:
    """State that lies in a table already, by conversation or question."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def read(self, questions: DataFrame) -> DataFrame:
        return self.rows.join(questions.select("qid").distinct(), "qid", "left_semi")


class ScriptedProvider:
    """Answers from a table (qid, stream): for dry runs and tests."""

    def __init__(self, script: DataFrame):
        self.script = script

    def answer(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("qid").join(self.script.select("qid", "stream"), "qid", "left")


def acquired_state(source: StateSource | None, questions: DataFrame) -> DataFrame:
    """Rows of STATE that came in time. No source, or one that fails, gives none: a turn then rests on the manuals alone."""
    nothing = questions.sparkSession.createDataFrame([], STATE)
    if source is None:
        return nothing
    try:
        rows = source.read(questions)
        in_time = client.acquired(F.lit(True), F.col("latency_ms"))
        return rows.where(F.coalesce(in_time, F.lit(False))).select(*nothing.columns)
    except Exception:  # whatever is wrong with the state, the turn goes on
        return nothing
