"""Queries over the operators of this package, one for each."""

from __future__ import annotations

from sketchloom.llm import decontaminate, katz, language_id, line_dedup, near_dedup, packing, quality, secret_scan, suffix_dedup, vp_search

OPERATORS = {
    "op1_language_id": language_id,
    "op2_near_dedup": near_dedup,
    "op3_packing": packing,
    "op4_suffix_dedup": suffix_dedup,
    "op5_decontaminate": decontaminate,
    "op6_secret_scan": secret_scan,
    "op7_quality": quality,
    "op8_vp_search": vp_search,
    "op9_line_dedup": line_dedup,
    "op10_katz": katz,
}


def queries() -> dict:
    return {name: module.query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in OPERATORS.items() if module.SQL}
