"""Dense ranking, reciprocal rank fusion, rerank windows and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.metrics import cosine, rrf
from sievelight.functions.text import line_matches, query_terms


def dense_topk(vectors: DataFrame, query: DataFrame, id_col: str, vector_col: str, limit: int = 50, where: Column | None = None) -> DataFrame:
    """The rows with the greatest positive cosine to a query vector: id, score.

    query has one row with the column qvec; it is broadcast, and only the top rows
    of each partition move.
    """
    rows = vectors if where is None else vectors.where(where)
    scored = rows.crossJoin(F.broadcast(query.limit(1))).select(F.col(id_col), cosine(F.col(vector_col), F.col("qvec")).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), F.col(id_col)).limit(limit)


def ranked(hits: DataFrame, score: str, *ties: str, name: str = "rank") -> DataFrame:
    """hits (a bounded list) with their place, from 0."""
    order = Window.orderBy(F.desc(score), *[F.col(t) for t in ties])
    return hits.withColumn(name, (F.row_number().over(order) - 1).cast("long"))


def fuse(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two ranked candidate lists (keys, rank) as one: keys, r1, r2, fused, place.

    Ties keep the order in which candidates come: the first list, then what only
    the second has.
    """
    both = first.select(*keys, F.col("rank").alias("r1")).join(second.select(*keys, F.col("rank").alias("r2")), keys, "full_outer")
    n1 = F.count("r1").over(Window.partitionBy())
    both = both.withColumn("fused", rrf(F.col("r1"), F.col("r2"))).withColumn("arrival", F.coalesce("r1", n1 + F.col("r2")))
    order = Window.orderBy(F.desc("fused"), F.col("arrival"))
    return both.withColumn("place", (F.row_number().over(order) - 1).cast("long")).drop("arrival")


def wanted_rows(limit: int, rerank_topn: int = 10) -> int:
    """How many rows a hybrid search returns: never more than the reranker's."""
    return rerank_topn if limit == 0 else min(limit, rerank_topn)


def select_survivors(candidates: DataFrame, score: str, place: str, topn: int, threshold: float = 0.0) -> DataFrame:
    """Candidates whose score is above the threshold by score, then the rest in fused
    order to fill up; a candidate without a score surfaces with 0."""
    good = F.coalesce(F.col(score) > threshold, F.lit(False))
    order = [F.desc(good), F.when(good, F.col(score)).desc_nulls_last(), F.col(place)]
    return candidates.orderBy(*order).limit(topn).withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))


def rerank_window(hits: DataFrame, text_col: str, start_col: str, query: Column, context: int = 10, preview: int = 3) -> DataFrame:
    """Narrows each hit to context lines around its first line that holds a query
    term, else to its first lines: start_col, end and text_col are rewritten."""
    lines = F.split(text_col, "\n")
    terms = query_terms(query)
    hits = hits.withColumn("_lines", F.when(F.endswith(F.col(text_col), F.lit("\n")), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))
    first = F.array_position(F.transform("_lines", lambda x: line_matches(x, terms)), True).cast("int")
    lo = F.when(first > 0, F.greatest(first - context, F.lit(1))).otherwise(1)
    hi = F.when(first > 0, F.least(first + context, F.size("_lines"))).otherwise(F.least(F.lit(preview), F.size("_lines")))
    hits = hits.withColumn("_lo", lo).withColumn("_hi", hi)
    return (
        hits.withColumn(text_col, F.array_join(F.slice("_lines", F.col("_lo"), F.col("_hi") - F.col("_lo") + 1), "\n"))
        .withColumn("end", (F.col(start_col) + F.col("_hi") - 1).cast("long"))
        .withColumn(start_col, (F.col(start_col) + F.col("_lo") - 1).cast("long"))
        .drop("_lines", "_lo", "_hi")
    )


def snippet(text: Column, query: Column, context: int = 2, preview: int = 3) -> Column:
    """Lines around the matches, with a mark between groups; the first lines if none match."""
    lines = F.split(text, "\n")
    terms = query_terms(query)
    at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: line_matches(F.element_at(lines, i), terms))
    near = F.array_sort(F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - context, F.lit(1)), F.least(i + context, F.size(lines)))))))
    shown = F.when(F.size(at) > 0, near).otherwise(F.sequence(F.lit(1), F.least(F.lit(preview), F.size(lines))))
    marked = F.transform(shown, lambda i, k: F.when((k > 0) & (i - F.get(shown, k - 1) > 1), F.concat(F.lit("…\n"), F.element_at(lines, i))).otherwise(F.element_at(lines, i)))
    return F.array_join(marked, "\n")
