"""The queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: Query and the module that holds it; SQL_<query> in the module is its DuckDB SQL.
HOLDS = {
    "op1_mix_sources": "mixing",
    "op2_quality_rules": "quality_rules",
    "op3_language_id": "language",
    "op4_quote_links": "quotes",
    "op5_media_columns": "media",
    "op6_near_dup": "near_dup",
    "op7_quality_classifier": "rule_ensemble",
    "op8_byte_bpe": "bpe",
    "op9_substring_dup": "substring_dup",
    "op10_html_extraction": "html_text",
    "op11_merkle_manifest": "merkle",
    "op12_embedding_near_dup": "vector_dup",
    "op13_collocations": "collocations",
}


def queries() -> dict:
    """Name to query."""
    found = {name: getattr(importlib.import_module(f"cadenza.llm.{module}"), name) for name, module in HOLDS.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    held = {name: getattr(importlib.import_module(f"cadenza.llm.{module}"), f"SQL_{name}", None) for name, module in HOLDS.items()}
    return {name: sql for name, sql in held.items() if sql}
