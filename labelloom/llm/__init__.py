"""Operators for large training-data pipelines, with their registered queries."""

from labelloom.llm import alignment, bpe, chat, dedup, hosts, leaks, lm, merges, pieces, pii, quality, secrets, whitening
from labelloom.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "alignment", "bpe", "chat", "dedup", "hosts", "leaks", "lm", "merges", "pieces", "pii", "quality", "secrets", "whitening"]
