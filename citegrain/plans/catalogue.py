"""All queries, by name."""

from __future__ import annotations

from . import answer_queries, corpus_queries, retrieval_queries

_MODULES = (retrieval_queries, corpus_queries, answer_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
