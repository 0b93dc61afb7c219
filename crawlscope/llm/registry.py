"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from crawlscope.llm import chat, embedding_dedup, gif, langid, line_dedup, mixing, pieces, quality, simhash, substring_dedup

_MODULES = [line_dedup, embedding_dedup, mixing, simhash, substring_dedup, gif, chat, quality, pieces, langid]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
