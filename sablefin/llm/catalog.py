"""Queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

from sablefin.llm import oracle

MODULES = {
    "op1_near_dedup": "minhash", "op2_warc": "warc", "op3_lm_score": "ppm", "op4_quality": "quality", "op5_decontaminate": "decontaminate", "op6_packing": "packing", "op7_language": "language", "op8_line_dedup": "lines", "op9_secrets": "secrets", "op10_pii": "pii",
}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"sablefin.llm.{module}"), name) for name, module in MODULES.items()}
    return found | {name: getattr(oracle, name) for name in oracle.ORACLE if name not in MODULES}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLE)
