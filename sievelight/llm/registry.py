"""The queries and oracle SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

MODULES = ("chat_format", "exact_dedup", "mixing", "near_dedup", "decontaminate", "html_text", "language_id", "license_scan", "toxicity", "suffix_dedup")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(import_module(f"sievelight.llm.{m}"), name))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
