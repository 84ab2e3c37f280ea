"""Operators of a large-scale training-data pipeline; nothing outside this subpackage imports it."""

from __future__ import annotations

from importlib import import_module

#: Module and query of each operator; both have the same name.
OPERATORS = (
    "op1_line_dedup",
    "op2_sharding",
    "op3_packing",
    "op4_mixing",
    "op5_hnsw",
    "op6_license_scan",
    "op7_language_id",
    "op8_ngram_jaccard",
    "op9_quality_rules",
    "op10_suffix_dedup",
)


def queries() -> dict:
    return {name: getattr(import_module(f"{__name__}.{name}"), name) for name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.SQL)
