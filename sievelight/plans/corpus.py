"""Queries of chunking, telemetry, snapshots, graphs, configuration and scalars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.functions import text
from sievelight.operators import chunking, context, overlay, relations, snapshot, telemetry
from sievelight.plans.tables import table
from sievelight.streaming import events as streaming


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.window_chunks(table(spark, d, "documents"), "doc_id", "text")


def chunk_trim(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit(" \n\n"), "text", F.lit("\n \n\n"))
    lines = table(spark, d, "documents").select("doc_id", chunking.effective_lines(padded).alias("lines"))
    cut = chunking.trimmed(lines.withColumn("start", F.lit(1)).withColumn("end", F.size("lines")), "lines")
    return cut.select("doc_id", "start", "end")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Regions made of conversation turns: each covers as many lines as its text has words modulo 9."""
    c = table(spark, d, "conversations")
    start = F.col("turn") * 4 + 1
    return c.select("conv_id", "turn", start.alias("start"), (start + F.char_length("text") % 9).alias("end"))


def region_prune(spark: SparkSession, d: str) -> DataFrame:
    return chunking.outer_regions(_spans(spark, d), "conv_id").select("conv_id", "turn", "start", "end")


def region_gaps(spark: SparkSession, d: str) -> DataFrame:
    kept = chunking.outer_regions(_spans(spark, d), "conv_id").select("conv_id", "start", "end")
    lengths = _spans(spark, d).groupBy("conv_id").agg((F.max("end") + 3).alias("n_lines"))
    return chunking.gaps(kept, lengths, "conv_id")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a telemetry log: types are modes, values milliseconds."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", F.when(F.col("event_id") % 10 == 0, "index_build").when(F.col("event_id") % 97 == 0, "eval_run").otherwise("search").alias("kind"),
        F.col("event_type").alias("mode"), F.col("value").cast("long").alias("total_ms"), (k % 4).cast("long").alias("results"),
        (k % 5 == 0).alias("fallback"), F.when(F.col("event_id") % 13 == 0, "boom").alias("error"), F.concat(F.lit("q"), k.cast("string")).alias("query"),
        F.when(F.col("event_id") % 20 == 0, "semantic").alias("store"), F.col("user_id").alias("chunks"),
    )


def metrics_totals(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.totals(_log(spark, d))


def metrics_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.by_mode(_log(spark, d)).select("mode", "queries", "errors", "p50_ms", "p95_ms")


def metrics_zero_result(spark: SparkSession, d: str) -> DataFrame:
    lists = telemetry.by_mode(_log(spark, d))
    return lists.select("mode", F.array_join("zero_result", ",").alias("zero_result"), F.array_join("fallbacks", ",").alias("fallbacks"))


def metrics_slowest(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.slowest(_log(spark, d), 5, "event_id").select("mode", "event_id", "total_ms", "results", F.col("place").cast("long").alias("place"))


def metrics_tail(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.tail(_log(spark, d), 20, "event_id").select("event_id", "kind", "mode")


def metrics_last_build(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.last_builds(_log(spark, d), "event_id").select("store", "event_id", "chunks")


def metrics_evals(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.newest_evals(_log(spark, d), "event_id").select("event_id", "mode")


def trace_lines(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).where("kind = 'search'")
    lines = telemetry.trace_line(log.select("event_id", "mode", F.when(F.col("results") > 0, F.col("total_ms")).alias("bm25_ms"), "results", "fallback").withColumnRenamed("event_id", "n"))
    return lines.select(F.col("n").alias("event_id"), "line")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    now = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"))
    then = now.where("path % 10 != 0").withColumn("mtime", F.when(F.col("path") % 7 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")))
    return now.where("path % 17 != 0"), then


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.diff(*_snapshots(spark, d))


def refresh_policy(spark: SparkSession, d: str) -> DataFrame:
    now, then = _snapshots(spark, d)
    n, m = snapshot.diff(now, then).count(), now.count()
    return spark.createDataFrame([(n, m, snapshot.policy(n, m), snapshot.policy(0, m), snapshot.policy(n, m, True))], "n_changes long, n_current long, mode string, unchanged string, forced string")


def incremental_equals_full(spark: SparkSession, d: str) -> DataFrame:
    """Rows by which a table kept up by a delta differs from one made anew: none."""
    now, then = _snapshots(spark, d)
    kept = snapshot.upserted(then, snapshot.diff(now, then), now)
    return kept.exceptAll(now).unionByName(now.exceptAll(kept)).agg(F.count(F.lit(1)).alias("n_different"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, d, "pages").select(F.col("url").alias("source"), F.explode(links).alias("target"))


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def importers_suffix(spark: SparkSession, d: str) -> DataFrame:
    return relations.importers(_edges(spark, d), "the")


def import_in_degree(spark: SparkSession, d: str) -> DataFrame:
    return relations.in_degree(_edges(spark, d))


def group_by_name(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("kind"))
    return relations.groups(p).select("name", F.array_join("kinds", ",").alias("kinds"), "count")


def containment_nest(spark: SparkSession, d: str) -> DataFrame:
    """Turns (as methods) in the regions (as impl blocks) that hold them: the first one takes each."""
    spans = _spans(spark, d)
    outer = spans.where("turn % 2 = 0").select(F.col("conv_id").alias("path"), F.col("turn").alias("outer_id"), "start", "end")
    inner = spans.where("turn % 2 = 1").select(F.col("conv_id").alias("path"), F.col("turn").alias("inner_id"), F.col("start").alias("line"))
    return relations.nested(inner, outer, "inner_id").select("path", "inner_id", "outer_id")


def orphans_anti(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d)
    outer = spans.where("turn % 2 = 0").select(F.col("conv_id").alias("path"), F.col("turn").alias("outer_id"), "start", "end")
    inner = spans.where("turn % 2 = 1").select(F.col("conv_id").alias("path"), F.col("turn").alias("inner_id"), F.col("start").alias("line"))
    return relations.orphans(inner, outer, "inner_id").select("path", "inner_id", "line")


def refs_minus_defs(spark: SparkSession, d: str) -> DataFrame:
    """Line items (as references) without those that open an order (as definition sites)."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("line"))
    defs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"), F.lit(1).cast("long").alias("line"))
    return relations.references_only(li, defs).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def typed_semi(spark: SparkSession, d: str) -> DataFrame:
    """Orders (as functions) of customers (as parents) in a segment (known types), others, and none."""
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("parent"))
    types = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("name"))
    return relations.by_parent(f, types).groupBy("belongs").agg(F.count(F.lit(1)).alias("n"))


def lang_stats_total(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.col("n_chars").alias("code"), F.size(F.split("text", "\n")).cast("long").alias("comments"))
    return context.language_stats(docs)


def severity_topk(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("INFO", "ERROR", "WARNING", "NOTE")])
    e = table(spark, d, "events").select("event_id", F.get(kinds, (F.col("user_id") % 4).cast("int")).alias("severity"))
    return overlay.by_severity(e, 10, "event_id").select("event_id", "severity")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    runner = F.get(F.array(*[F.lit(r) for r in overlay.RUNNERS]), (F.col("event_id") % 6).cast("int"))
    return table(spark, d, "events").select(F.concat(F.lit("t"), F.col("user_id") % 50).alias("task"), runner.alias("runner")).distinct()


def runner_priority(spark: SparkSession, d: str) -> DataFrame:
    return overlay.first_choice(_tasks(spark, d)).select("task", "runner")


def runner_first_name(spark: SparkSession, d: str) -> DataFrame:
    return overlay.first_choice(_tasks(spark, d).withColumn("g", F.lit(1)), ("t99", "t7", "t3"), "g").select("task", "runner")


_COMMANDS = [
    (0, 0, "rust", "clippy", "cargo clippy", 0), (0, 1, "rust", "audit", "cargo audit", 10), (0, 2, "rust", "fmt", "cargo fmt", 0),
    (1, 0, "rust", "clippy", "cargo clippy --fix", 2), (1, 1, "rust", "deny", "cargo deny", 5), (2, 0, "rust", "audit", "true", 0), (2, 1, "go", "vet", "go vet", 0),
]


def config_overlay(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame(_COMMANDS, "layer int, pos int, project string, name string, cmd string, cost int")
    return overlay.merged_commands(c, "project").select("project", "name", "cmd", "cost", "place")


def settings_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Settings of three layers over the nations: empty strings and zeros don't override."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("l0"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("mid").alias("l1"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("top")).alias("l2"))
    return n.select("n_nationkey", overlay.overlaid("l0", "l1", "l2").alias("value"))


def todo_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "(?m)^(the|The|En|De) ", "// todo: $1 ").alias("text"))
    return context.todos(docs, "doc_id", "text", None)


def readme_head(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "(?m)^(The|En) ", "## $1 ").alias("text"))
    return context.readme_head(docs, "doc_id", "text", 5)


def redact_url(spark: SparkSession, d: str) -> DataFrame:
    u = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "://", "://user:pw@")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.redacted_url(u).alias("url"))


def like_escape(spark: SparkSession, d: str) -> DataFrame:
    odd = F.concat("text", F.lit("50%_done\\x"))
    return table(spark, d, "documents").select("doc_id", text.like_escaped(odd).alias("escaped"))


def truncate_half(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.half(F.col("text")).alias("half"))


def iso_ts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.iso_time(F.unix_timestamp("ts")).alias("iso"))


def fmt_ms(spark: SparkSession, d: str) -> DataFrame:
    ms = (F.col("event_id") * 137 % 40000).cast("long")
    return table(spark, d, "events").select("event_id", text.duration(ms).alias("took"))


def brace_group(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_regionkey", F.concat(F.lower("n_name"), F.when(F.col("n_regionkey") == 1, F.concat(F.lit(".x"), F.col("n_nationkey") % 2)).otherwise(".rs")).alias("f"))
    return n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("f")).alias("fs")).select("n_regionkey", text.braced(F.col("fs")).alias("files"))


def fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", text.fnv1a64(F.col("p_brand")).alias("hash"), text.redacted_query(F.col("p_brand")).alias("redacted"))


def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files: the same roll-up as in batch."""
    return streaming.replayed_metrics(spark, f"{d}/events.parquet").select("mode", "queries", "errors", "p50_ms", "p95_ms")


def hourly_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and hour (an extension: tumbling windows)."""
    return streaming.hourly(table(spark, d, "events")).select("hour", "event_type", "n", F.round("total", 4).alias("total"))


def first_line_of_group(spark: SparkSession, d: str) -> DataFrame:
    """The three first turns of each conversation."""
    return context.rows_per(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", 3, "turn")


_SPANS = "spans AS (SELECT conv_id, turn, turn * 4 + 1 AS s, turn * 4 + 1 + length(text) % 9 AS e FROM conversations)"
_OUTER = """o AS (SELECT *, max(e) OVER (PARTITION BY conv_id ORDER BY s, e, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spans),
kept AS (SELECT * FROM o WHERE b IS NULL OR e > b)"""
_LOG = """log AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'index_build' WHEN event_id % 97 = 0 THEN 'eval_run' ELSE 'search' END AS kind, event_type AS mode,
 trunc(value)::BIGINT AS total_ms, ((props->>'$.k')::INT % 4)::BIGINT AS results, (props->>'$.k')::INT % 5 = 0 AS fallback, event_id % 13 = 0 AS failed,
 'q' || (props->>'$.k') AS query, CASE WHEN event_id % 20 = 0 THEN 'semantic' ELSE 'bm25' END AS store, user_id AS chunks FROM events)"""
_MODES = f"""WITH {_LOG} SELECT mode, count(*) AS queries, count(*) FILTER (failed) AS errors, coalesce(quantile_disc(total_ms, 0.5) FILTER (NOT failed), 0) AS p50_ms,
 coalesce(quantile_disc(total_ms, 0.95) FILTER (NOT failed), 0) AS p95_ms FROM log WHERE kind = 'search' GROUP BY mode"""
_SNAPS = """now AS (SELECT doc_id AS path, n_chars AS m FROM documents WHERE doc_id % 17 <> 0),
prev AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN n_chars - 1 ELSE n_chars END AS m FROM documents WHERE doc_id % 10 <> 0),
diff AS (SELECT coalesce(now.path, prev.path) AS path, CASE WHEN prev.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'removed' WHEN now.m <> prev.m THEN 'changed' END AS change
 FROM now FULL JOIN prev ON now.path = prev.path)"""
_EDGES = "edges AS (SELECT url AS source, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages)"
_TASKS = "tasks AS (SELECT DISTINCT 't' || (user_id % 50) AS task, (event_id % 6)::INT AS p FROM events)"
_RUNNER = "(['mise', 'just', 'make', 'deno', 'npm', 'gradle'])[p + 1]"
_INNER = "i AS (SELECT conv_id AS path, turn AS inner_id, s AS line FROM spans WHERE turn % 2 = 1), x AS (SELECT conv_id AS path, turn AS outer_id, s, e FROM spans WHERE turn % 2 = 0)"
_VALUES = ", ".join(str(c) for c in _COMMANDS)

QUERIES = {f.__name__: f for f in (
    chunk_windows, chunk_trim, region_prune, region_gaps, metrics_totals, metrics_by_mode, metrics_zero_result, metrics_slowest, metrics_tail, metrics_last_build,
    metrics_evals, trace_lines, snapshot_diff, refresh_policy, incremental_equals_full, import_edges, importers_suffix, import_in_degree, group_by_name,
    containment_nest, orphans_anti, refs_minus_defs, typed_semi, lang_stats_total, severity_topk, runner_priority, runner_first_name, config_overlay,
    settings_overlay, todo_scan, readme_head, redact_url, like_escape, truncate_half, iso_ts, fmt_ms, brace_group, fnv1a, stream_metrics, hourly_metrics,
    first_line_of_group,
)}
SQL = {
    "chunk_windows": """
WITH l AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents WHERE text <> ''),
s AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1, 56)) AS s FROM l)
SELECT doc_id, s AS start, least(s + 63, len(ls)) AS "end", array_to_string(ls[s:least(s + 63, len(ls))], chr(10)) AS text FROM s WHERE s = 1 OR s + 7 < len(ls)""",
    "chunk_trim": """
WITH p AS (SELECT doc_id, string_split(' ' || chr(10) || chr(10) || text || chr(10) || ' ' || chr(10) || chr(10), chr(10))[:-2] AS ls FROM documents),
f AS (SELECT doc_id, list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i]) <> '') AS k FROM p)
SELECT doc_id, list_min(k) AS start, list_max(k) AS "end" FROM f WHERE len(k) > 0""",
    "region_prune": f'WITH {_SPANS}, {_OUTER} SELECT conv_id, turn, s AS start, e AS "end" FROM kept',
    "region_gaps": f"""WITH {_SPANS}, {_OUTER},
k AS (SELECT conv_id, s, e, coalesce(max(e) OVER (PARTITION BY conv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM kept)
SELECT * FROM (SELECT conv_id, reach + 1 AS start, s - 1 AS "end" FROM k UNION ALL SELECT conv_id, max(e) + 1, max(e) + 3 FROM spans GROUP BY conv_id) WHERE start <= "end" """,
    "metrics_totals": f"WITH {_LOG} SELECT count(*) AS events, count(*) FILTER (kind = 'search') AS searches, count(*) FILTER (kind = 'index_build') AS builds, count(*) FILTER (kind = 'eval_run') AS evals FROM log",
    "metrics_by_mode": _MODES,
    "metrics_zero_result": f"""WITH {_LOG} SELECT mode, coalesce(array_to_string(list_sort(list(DISTINCT query) FILTER (NOT failed AND results = 0)), ','), '') AS zero_result,
 coalesce(array_to_string(list_sort(list(DISTINCT query) FILTER (NOT failed AND fallback)), ','), '') AS fallbacks FROM log WHERE kind = 'search' GROUP BY mode""",
    "metrics_slowest": f"""WITH {_LOG} SELECT mode, event_id, total_ms, results, row_number() OVER (PARTITION BY mode ORDER BY total_ms DESC, results DESC, event_id) AS place
FROM log WHERE kind = 'search' AND NOT failed QUALIFY place <= 5""",
    "metrics_tail": f"WITH {_LOG} SELECT event_id, kind, mode FROM log ORDER BY event_id DESC LIMIT 20",
    "metrics_last_build": f"WITH {_LOG} SELECT store, max(event_id) AS event_id, arg_max(chunks, event_id) AS chunks FROM log WHERE kind = 'index_build' GROUP BY store",
    "metrics_evals": f"WITH {_LOG} SELECT event_id, mode FROM log WHERE kind = 'eval_run' ORDER BY event_id DESC",
    "trace_lines": f"""WITH {_LOG} SELECT event_id, concat_ws(' ', mode, 'n=' || event_id, CASE WHEN results > 0 THEN 'bm25_ms=' || total_ms || 'ms' END, 'results=' || results, CASE WHEN fallback THEN 'fallback' END) AS line
FROM log WHERE kind = 'search'""",
    "snapshot_diff": f"WITH {_SNAPS} SELECT path, change FROM diff WHERE change IS NOT NULL",
    "refresh_policy": f"""WITH {_SNAPS}, n AS (SELECT (SELECT count(*) FROM diff WHERE change IS NOT NULL) AS a, (SELECT count(*) FROM now) AS b)
SELECT a AS n_changes, b AS n_current, CASE WHEN a = 0 THEN 'none' WHEN 2 * a <= b THEN 'delta' ELSE 'full' END AS mode, 'none' AS unchanged, 'full' AS forced FROM n""",
    "incremental_equals_full": "SELECT 0::BIGINT AS n_different",
    "import_edges": f"WITH {_EDGES} SELECT source, target FROM edges",
    "importers_suffix": f"WITH {_EDGES} SELECT DISTINCT source FROM edges WHERE ends_with(target, 'the')",
    "import_in_degree": f"WITH {_EDGES} SELECT target, count(DISTINCT source) AS importers FROM edges GROUP BY target",
    "group_by_name": "SELECT p_brand AS name, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS kinds, count(*) AS count FROM part GROUP BY p_brand",
    "containment_nest": f"""WITH {_SPANS}, {_INNER} SELECT path, inner_id, outer_id FROM (SELECT i.path, inner_id, outer_id,
 row_number() OVER (PARTITION BY i.path, inner_id ORDER BY s, e, outer_id) AS r FROM i JOIN x ON i.path = x.path AND line BETWEEN s AND e) WHERE r = 1""",
    "orphans_anti": f"WITH {_SPANS}, {_INNER} SELECT path, inner_id, line FROM i WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.path = i.path AND i.line BETWEEN s AND e)",
    "refs_minus_defs": """SELECT l_linenumber::BIGINT AS line, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = l_orderkey AND l_linenumber = 1) GROUP BY 1""",
    "typed_semi": """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'none' WHEN EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey) THEN 'type' ELSE 'other' END AS belongs, count(*) AS n FROM orders GROUP BY 1""",
    "lang_stats_total": """SELECT CASE WHEN grouping(lang) = 1 THEN 'Total' ELSE lang END AS lang, sum(n_chars)::BIGINT AS code, sum(len(string_split(text, chr(10))))::BIGINT AS comments, count(*) AS files
FROM documents GROUP BY GROUPING SETS ((lang), ())""",
    "severity_topk": """SELECT event_id, (['INFO', 'ERROR', 'WARNING', 'NOTE'])[user_id % 4 + 1] AS severity FROM events
ORDER BY ([2, 0, 1, 4])[user_id % 4 + 1], event_id LIMIT 10""",
    "runner_priority": f"WITH {_TASKS} SELECT task, {_RUNNER.replace('p + 1', 'min(p) + 1')} AS runner FROM tasks GROUP BY task",
    "runner_first_name": f"WITH {_TASKS}, r AS (SELECT task, p, CASE task WHEN 't7' THEN 1 ELSE 2 END AS k FROM tasks WHERE task IN ('t99', 't7', 't3')) SELECT task, {_RUNNER} AS runner FROM r ORDER BY k, p LIMIT 1",
    "config_overlay": f"""WITH c(layer, pos, project, name, cmd, cost) AS (VALUES {_VALUES}),
m AS (SELECT project, name, min(layer * 100 + pos) AS first, arg_max(cmd, layer) AS cmd, arg_max(cost, layer) AS cost FROM c GROUP BY ALL)
SELECT project, name, cmd, cost, row_number() OVER (PARTITION BY project ORDER BY first) - 1 AS place FROM m""",
    "settings_overlay": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'top' WHEN n_nationkey % 2 = 1 THEN 'mid' ELSE n_name END AS value FROM nation",
    "todo_scan": r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '(?m)^(the|The|En|De) ', '// todo: \1 ', 'g') AS text FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t))
SELECT doc_id, line, regexp_replace(trim(x), '(?i)^(?://|#|<!--|/\*)\s*(?:TODO|FIXME|HACK|XXX):?\s*', '') AS text FROM l WHERE regexp_matches(x, '(?i)(?://|#|<!--|/\*)\s*(TODO|FIXME|HACK|XXX)\b:?')""",
    "readme_head": r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '(?m)^(The|En) ', '## \1 ', 'g') AS text FROM documents),
l AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM t),
m AS (SELECT doc_id, ls, list_filter(range(len(ls)), lambda i: starts_with(ls[i + 1], '## ')) AS k FROM l),
n AS (SELECT doc_id, ls, least(coalesce(k[2], len(ls)), 5, len(ls)) AS n FROM m)
SELECT doc_id, array_to_string(ls[1:n], chr(10)) AS head, len(ls) - n AS more FROM n""",
    "redact_url": "SELECT page_id, CASE WHEN contains(url, '@') THEN regexp_replace(url, '^(.*?://)[^@]*@', '\\1') ELSE url END AS url FROM pages",
    "like_escape": r"SELECT doc_id, regexp_replace(text || '50%_done\x', '([\\%_])', '\\\1', 'g') AS escaped FROM documents",
    "truncate_half": "SELECT doc_id, left(text, length(text) // 2) AS half FROM documents",
    "iso_ts": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events",
    "fmt_ms": "SELECT event_id, CASE WHEN ms >= 10000 THEN (floor(ms / 100 + 0.5)::BIGINT // 10) || '.' || (floor(ms / 100 + 0.5)::BIGINT % 10) || 's' ELSE ms || 'ms' END AS took FROM (SELECT event_id, event_id * 137 % 40000 AS ms FROM events)",
    "brace_group": """
WITH f AS (SELECT n_regionkey, lower(n_name) || CASE WHEN n_regionkey = 1 THEN '.x' || (n_nationkey % 2) ELSE '.rs' END AS f FROM nation),
g AS (SELECT n_regionkey, list_sort(list(f)) AS fs FROM f GROUP BY 1),
e AS (SELECT *, list_distinct(list_transform(fs, lambda x: regexp_extract(x, '\\.([^.]+)$', 1))) AS ex FROM g)
SELECT n_regionkey, CASE WHEN len(fs) = 1 THEN fs[1] WHEN len(ex) = 1 AND ex[1] <> '' THEN '{' || array_to_string(list_transform(fs, lambda x: regexp_replace(x, '\\.[^.]+$', '')), ',') || '}.' || ex[1]
 ELSE '{' || array_to_string(fs, ',') || '}' END AS files FROM e""".replace("\\\\", "\\"),
    "fnv1a": """
WITH b AS (SELECT DISTINCT p_brand FROM part),
h AS (SELECT p_brand, list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(1, length(p_brand) + 1), lambda i: ascii(p_brand[i])::UHUGEINT)),
 lambda a, x: (xor(a, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS v FROM b)
SELECT p_brand, printf('%016x', v::UBIGINT) AS hash, 'h' || printf('%016x', v::UBIGINT) AS redacted FROM h""",
    "stream_metrics": _MODES,
    "hourly_metrics": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "first_line_of_group": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3",
}
