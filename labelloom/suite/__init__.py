"""Registered queries on the test tables, each with its SQL counterpart."""

from labelloom.suite import analysis, corpus, joins, sampling, storage, synthesis, text
from labelloom.suite.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analysis", "corpus", "joins", "sampling", "storage", "synthesis", "text"]
