"""The queries of the retrieval operators and the SQL that checks them."""

from __future__ import annotations

from sievelight.plans import corpus, fixtures, retrieval

MODULES = (retrieval, corpus, fixtures)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
