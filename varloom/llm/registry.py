"""All queries of this subpackage and their SQL."""
from __future__ import annotations

import importlib

#: Modules that hold QUERIES and ORACLE_SQL.
MODULES = ("queries_quality", "queries_tokens", "queries_chat", "queries_warc", "queries_pii", "queries_decontam", "queries_dedup", "queries_lm", "queries_divergence", "queries_phrases", "queries_minhash")


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= importlib.import_module(f"varloom.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= importlib.import_module(f"varloom.llm.{name}").ORACLE_SQL
    return out
