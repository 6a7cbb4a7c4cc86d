"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from geoloom.llm import decontaminate, jaccard, langid, linededup, media, quality, secrets, sentencepieces, sharding, tokencount

MODULES = (tokencount, sentencepieces, sharding, langid, jaccard, linededup, quality, media, decontaminate, secrets)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
