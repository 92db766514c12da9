"""Vector, ranking and relevance measures as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty ones and ones without a norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)).otherwise(0.0)


def rrf(*ranks: Column, k: int = RRF_K) -> Column:
    """Reciprocal rank fusion of ranks that count from 0; a null rank gives nothing."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(F.lit(1.0) / (F.lit(k + 1) + r), F.lit(0.0))
    return total


def recall(matched: Column, expected: Column) -> Column:
    return F.when(expected == 0, 1.0).otherwise(matched / expected)


def reciprocal_rank(gains: Column) -> Column:
    """1 / the place of the first positive gain, else 0."""
    at = F.array_position(F.transform(gains, lambda g: g > 0), True)
    return F.when(at > 0, F.lit(1.0) / at).otherwise(0.0)


def dcg(gains: Column) -> Column:
    """Sum of (2**g - 1) / log2(place + 1) over gains in ranked order."""
    terms = F.transform(gains, lambda g, i: (F.pow(F.lit(2.0), g.cast("double")) - 1) / F.log2(i.cast("double") + 2))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def ndcg(gains: Column, grades: Column, k: Column) -> Column:
    """DCG of gains over that of all expected grades in the best order, cut at k; 1 if that is 0."""
    ideal = dcg(F.slice(F.sort_array(grades, asc=False), F.lit(1), k))
    return F.when(ideal == 0, 1.0).otherwise(dcg(F.slice(gains, F.lit(1), k)) / ideal)


def nearest_rank(p: float, value: str) -> Column:
    """The nearest-rank percentile of a group, 0 if it is empty."""
    return F.expr(f"coalesce(percentile_disc({p}) WITHIN GROUP (ORDER BY {value}), 0)")
