"""Retrieval quality: hits against expectations, scores by query and by mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import metrics
from sievelight.operators import telemetry

MODES = ("bm25", "hybrid")


def checked_modes(modes: list[str] | None) -> list[str]:
    """The modes to run: both by default; unknown ones and an empty list are errors."""
    modes = list(MODES) if modes is None else list(modes)
    if not modes or (bad := [m for m in modes if m not in MODES]):
        raise ValueError(f"modes must be some of {MODES}" + (f", not {bad}" if modes else ""))
    return modes


def gains(hits: Column, expected: Column, k: int | Column) -> Column:
    """The grade that each of the first k hits earns, 0 if none.

    hits: array of (path, start, end) in ranked order; expected: array of (path, lo,
    hi, grade), lo and hi null if any line will do. Hit by hit, the first expectation
    not yet used with the same path and overlapping lines is used up.
    """
    indexed = F.transform(expected, lambda e, i: F.struct(i.alias("i"), e["path"].alias("path"), e["lo"].alias("lo"), e["hi"].alias("hi"), e["grade"].cast("double").alias("grade")))

    def take(state: Column, hit: Column) -> Column:
        fits = F.filter(
            indexed,
            lambda e: ~F.array_contains(state["used"], e["i"])
            & (e["path"] == hit["path"])
            & (e["lo"].isNull() | ((hit["start"] <= e["hi"]) & (e["lo"] <= hit["end"]))),
        )
        best = F.get(fits, F.lit(0))
        used = F.when(best.isNull(), state["used"]).otherwise(F.concat(state["used"], F.array(best["i"])))
        return F.struct(used.alias("used"), F.concat(state["gains"], F.array(F.coalesce(best["grade"], F.lit(0.0)))).alias("gains"), )

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<double>").alias("gains"))
    return F.aggregate(F.slice(hits, F.lit(1), F.lit(k) if isinstance(k, int) else k), start, take, lambda s: s["gains"])


def score_queries(df: DataFrame, hits: str, expected: str, k: int) -> DataFrame:
    """Adds matched, expected_n, recall, mrr and ndcg to rows with hits and expected arrays."""
    df = df.withColumn("_gains", gains(F.col(hits), F.col(expected), k))
    df = df.withColumn("matched", F.size(F.filter("_gains", lambda g: g > 0)).cast("long")).withColumn("expected_n", F.size(expected).cast("long"))
    grades = F.transform(F.col(expected), lambda e: e["grade"].cast("double"))
    return (
        df.withColumn("recall", metrics.recall(F.col("matched"), F.col("expected_n")))
        .withColumn("mrr", metrics.reciprocal_rank(F.col("_gains")))
        .withColumn("ndcg", metrics.ndcg(F.col("_gains"), grades, F.lit(k)))
        .drop("_gains")
    )


def by_mode(scores: DataFrame) -> DataFrame:
    """Averages per mode; a failed query (error not null) scores 0 and counts."""
    ok = lambda c: F.avg(F.when(F.col("error").isNull(), F.col(c)).otherwise(0.0))
    return scores.groupBy("mode").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        ok("recall").alias("recall"),
        ok("mrr").alias("mrr"),
        ok("ndcg").alias("ndcg"),
        metrics.nearest_rank(0.5, "ms").alias("p50_ms"),
        metrics.nearest_rank(0.95, "ms").alias("p95_ms"),
    )


def evaluate(spec: DataFrame, run: dict[str, Callable[[DataFrame], DataFrame]], k: int = 10, modes: list[str] | None = None) -> DataFrame:
    """Scores of every query of a spec (q, expected) in every mode.

    run[mode] takes the queries and returns q, hits (array of (path, start, end)), ms
    and error. A mode that can't run is an error here, never measured as another one.
    """
    modes = checked_modes(modes)
    if missing := [m for m in modes if m not in run]:
        raise ValueError(f"no search for {missing}")
    out = None
    for mode in modes:
        found = spec.join(run[mode](spec.select("q")), "q", "left").withColumn("mode", F.lit(mode))
        found = found.withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<path: string, start: bigint, end: bigint>>")))
        scored = score_queries(found, "hits", "expected", k)
        out = scored if out is None else out.unionByName(scored)
    return out


def report(scores: DataFrame, folder: str, log: str, k: int = 10) -> str:
    """Write an evaluation's scores and means to a folder of its own, and a summary event for each
    mode, with the report's place, to the log. Returns the place."""
    stamp = scores.sparkSession.sql("SELECT date_format(now(), \"yyyyMMdd'T'HHmmssSSS'Z'\")").first()[0]
    place = f"{folder.rstrip('/')}/{stamp}-eval"
    scores.write.json(f"{place}/scores")
    means = scores.sparkSession.read.schema(scores.schema).json(f"{place}/scores").transform(by_mode)
    means.coalesce(1).write.json(f"{place}/modes")
    told = means.select(F.lit("eval_run").alias("kind"), "mode", "queries", "recall", "mrr", "ndcg", F.lit(k).cast("long").alias("k"), F.lit(place).alias("report"))
    telemetry.append_events(told, log)
    return place
