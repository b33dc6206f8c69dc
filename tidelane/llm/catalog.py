"""Registers the corpus operators' queries and SQL."""

from __future__ import annotations

import importlib

#: Modules in this package that each offer QUERIES and ORACLE_SQL.
MODULES = ("warc", "simhash", "packing", "impact", "bpe", "gam", "rules", "toxicity", "suffixes", "suffix_trees", "audit", "neighbours", "lexical")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tidelane.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE_SQL")
