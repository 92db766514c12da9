"""Compares a DataFrame with the rows of an SQL query, columns by name, rows in any order."""

from __future__ import annotations

import math
from decimal import Decimal


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if isinstance(v, (int, float)) else str(v)


def rows_of(names, rows):
    at = [list(names).index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


def assert_same(df, con, sql):
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())
