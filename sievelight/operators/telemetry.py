"""Roll-ups of search and build events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.functions.metrics import nearest_rank
from sievelight.functions.text import iso_time, redacted_query

SAMPLES = 10
SCHEMA = (
    "ts bigint, iso string, kind string, mode string, query string, total_ms bigint, results bigint, fallback boolean, error string, "
    "store string, files bigint, chunks bigint, rebuilt boolean, incremental boolean, recall double, mrr double, ndcg double, k bigint, queries bigint, report string"
)
BUILD = "kind string, store string, files bigint, chunks bigint, rebuilt boolean, incremental boolean, error string, total_ms bigint"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log; lines that aren't JSON are skipped, a missing log is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def append_events(events: DataFrame, path: str, log_queries: bool = True) -> None:
    """Adds events to the log, with ts and iso, the query as text or as its hash."""
    ts = F.coalesce(F.col("ts"), F.unix_timestamp()) if "ts" in events.columns else F.unix_timestamp()
    out = events.withColumn("ts", ts).withColumn("iso", iso_time(ts))
    if not log_queries and "query" in out.columns:
        out = out.withColumn("query", redacted_query(F.col("query")))
    out.write.mode("append").json(path)


def recorded(spark: SparkSession, log: str, store: str, build: Callable[[], dict]) -> dict:
    """What build returns (mode, files, chunks), its outcome added to the log: store, files, chunks,
    rebuilt, incremental and milliseconds, or its error, which is raised again."""
    began = time.time()
    event: dict = {"kind": "index_build", "store": store}
    try:
        done = build()
        event |= {"files": done["files"], "chunks": done["chunks"], "rebuilt": done["mode"] == "full", "incremental": done["mode"] == "delta"}
        return done
    except Exception as e:
        event["error"] = str(e)[:200]
        raise
    finally:
        event["total_ms"] = int((time.time() - began) * 1000)
        row = spark.createDataFrame([tuple(event.get(c) for c in ("kind", "store", "files", "chunks", "rebuilt", "incremental", "error", "total_ms"))], BUILD)
        append_events(row, log)


def totals(events: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.col("kind") == k)
    return events.agg(F.count(F.lit(1)).alias("events"), kind("search").alias("searches"), kind("index_build").alias("builds"), kind("eval_run").alias("evals"))


def by_mode(events: DataFrame) -> DataFrame:
    """Searches per mode: queries, errors, nearest-rank p50 and p95 of those that
    succeeded, and the sorted distinct queries without results and with a fallback."""
    ok = F.col("error").isNull()
    searches = events.where("kind = 'search'").withColumn("mode", F.coalesce("mode", F.lit("unknown")))
    searches = searches.withColumn("ok_ms", F.when(ok, F.coalesce("total_ms", F.lit(0))))
    query = F.coalesce("query", F.lit(""))
    return searches.groupBy("mode").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(~ok).alias("errors"),
        nearest_rank(0.5, "ok_ms").alias("p50_ms"),
        nearest_rank(0.95, "ok_ms").alias("p95_ms"),
        F.array_sort(F.collect_set(F.when(ok & (F.coalesce("results", F.lit(0)) == 0), query))).alias("zero_result"),
        F.array_sort(F.collect_set(F.when(ok & F.coalesce("fallback", F.lit(False)), query))).alias("fallbacks"),
    )


def shortcomings(events: DataFrame, most: int = 100) -> DataFrame:
    """What went wrong by mode: mode, what ('error', 'zero_result' or 'fallback'), query, times, place.
    Of each mode and kind the most frequent queries, at most so many: the rows of a report. A
    query counts once per event; equal numbers go by the query."""
    ok = F.col("error").isNull()
    kinds = F.array(
        F.when(~ok, F.lit("error")), F.when(ok & (F.coalesce("results", F.lit(0)) == 0), F.lit("zero_result")), F.when(ok & F.coalesce("fallback", F.lit(False)), F.lit("fallback"))
    )
    rows = events.where("kind = 'search'").select(F.coalesce("mode", F.lit("unknown")).alias("mode"), F.explode(F.array_compact(kinds)).alias("what"), F.coalesce("query", F.lit("")).alias("query"))
    counted = rows.groupBy("mode", "what", "query").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("mode", "what").orderBy(F.desc("times"), "query"))
    return counted.withColumn("place", place).where(F.col("place") <= most)


def slowest(events: DataFrame, n: int = SAMPLES, *ties: str) -> DataFrame:
    """The slowest successful searches of each mode: at most n, with their place."""
    order = Window.partitionBy("mode").orderBy(F.desc("total_ms"), F.desc("results"), *[F.col(t) for t in ties])
    good = events.where("kind = 'search' and error is null")
    return good.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def last_builds(events: DataFrame, order: str) -> DataFrame:
    """Per store the last build; every store but 'semantic' counts as 'bm25'."""
    store = F.when(F.col("store") == "semantic", "semantic").otherwise("bm25")
    builds = events.where("kind = 'index_build'").withColumn("store", store)
    rest = [c for c in builds.columns if c != "store"]
    last = builds.groupBy("store").agg(F.max_by(F.struct(*rest), order).alias("e"))
    return last.select("store", *[F.col(f"e.{c}").alias(c) for c in rest])


def tail(events: DataFrame, n: int, order: str) -> DataFrame:
    """The last n events, oldest first."""
    return events.orderBy(F.desc(order)).limit(n).orderBy(order)


def newest_evals(events: DataFrame, order: str) -> DataFrame:
    return events.where("kind = 'eval_run'").orderBy(F.desc(order))


def trace_line(df: DataFrame) -> DataFrame:
    """A search trace in one line: mode and the parts that are there."""
    part = lambda name, unit="": F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}="), F.col(name).cast("string"), F.lit(unit)))
    parts = [part(c, "ms" if c.endswith("_ms") else "") for c in df.columns if c not in ("mode", "fallback")]
    fallback = F.when(F.col("fallback"), "fallback") if "fallback" in df.columns else F.lit(None).cast("string")
    return df.withColumn("line", F.concat_ws(" ", F.col("mode"), *parts, fallback))
