"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, chat, decontaminate, neardup, quality, sharding, substring, tokenfiles, toxicity, warc

MODULES = (neardup, sharding, chat, quality, bpe, decontaminate, substring, toxicity, tokenfiles, warc)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
