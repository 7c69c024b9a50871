"""The training-data queries, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this package that defines it under the same name.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_html_extract": "html_extract",
    "op3_near_dedup": "near_dedup",
    "op4_url_filter": "url_filter",
    "op5_pii": "pii",
    "op6_secret_scan": "secret_scan",
    "op7_decontaminate": "decontaminate",
    "op8_exact_dedup": "exact_dedup",
    "op9_byte_bpe": "byte_bpe",
    "op10_token_store": "token_store",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
