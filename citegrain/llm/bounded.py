"""Broadcasts behind a count: what is few goes to the rows, what is more meets them in a shuffled join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of ids or digests that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 250_000


def few(table: DataFrame, most: int | None = None) -> bool:
    most = BROADCAST_ROWS if most is None else most
    return table.limit(most + 1).count() <= most


def to_rows(table: DataFrame, most: int | None = None) -> DataFrame:
    """The table with a hint for a join with whole rows: broadcast if it is few, so that texts stay where they are, else a sort-merge join."""
    return F.broadcast(table) if few(table, most) else table.hint("merge")
