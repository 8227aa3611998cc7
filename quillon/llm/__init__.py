"""Operators of a training-data pipeline; nothing else in the package imports this one."""

from __future__ import annotations

from importlib import import_module

QUERIES = {
    "op1_decontamination": "op01_decontamination",
    "op2_license_scan": "op02_licenses",
    "op3_suffix_dedup": "op03_suffix",
    "op4_ngram_jaccard": "op04_jaccard",
    "op5_line_dedup": "op05_lines",
    "op6_quality_rules": "op06_quality",
    "op7_token_counts": "op07_tokens",
    "op8_best_fit_packing": "op08_packing",
    "op9_chat_format": "op09_chat",
    "op10_warc": "op10_warc",
    "op11_prefix_trie": "op11_trie",
    "op12_vector_codes": "op12_vector_codes",
    "op13_token_files": "op13_token_files",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), "SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
