"""Queries of tokenising, ranking, fusion and relevance, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import metrics, text
from sievelight.operators import bm25, evaluation, fusion
from sievelight.plans.tables import spread, table

QUERY = "the heat and"
PHRASE = '"of the"'


def tok_runs(spark: SparkSession, d: str) -> DataFrame:
    words = spread(table(spark, d, "documents").select("text")).select(F.explode(text.runs(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def tok_subwords(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat_ws("", "p_brand", F.replace("p_type", F.lit(" "), F.lit(""))).alias("name"))
    return c.unionByName(p).select("id", F.array_join(text.expand(F.col("name")), " ").alias("tokens"))


def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = bm25.term_statistics(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return stats.orderBy(F.desc("cf"), "term").limit(100)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bm25.search(spread(table(spark, d, "documents").select("doc_id", "text")), QUERY, "doc_id", "text", 50))


def bm25_lang(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bm25.search(spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source")), QUERY, "doc_id", "text", 50, F.col("lang") == "en", ("lang",)))


def bm25_path(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bm25.search(spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source")), QUERY, "doc_id", "text", 50, F.contains("source", F.lit("src1")), ("source",)))


def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bm25.search(spread(table(spark, d, "documents").select("doc_id", "text")), PHRASE, "doc_id", "text", 50))


def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking from an inverted index."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    lengths = docs.select("doc_id", F.size(text.index_tokens(F.col("text"))).alias("dl"))
    return rounded(bm25.search_postings(bm25.postings(docs, "doc_id", "text"), lengths, QUERY, "doc_id", 50))


def _query_vector(vectors: DataFrame, vec_id: int) -> DataFrame:
    return vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("qvec"))


def _dense(spark: SparkSession, d: str, vec_id: int, where: Column | None = None) -> DataFrame:
    v = table(spark, d, "embeddings")
    return fusion.dense_topk(v, _query_vector(v, vec_id), "vec_id", "embedding", 50, where)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_dense(spark, d, 0))


def dense_label(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_dense(spark, d, 0, F.col("label") == 1))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    lists = [fusion.ranked(_dense(spark, d, k).withColumn("score", F.round("score", 9)), "score", "vec_id") for k in (0, 1)]
    return fusion.fuse(*lists, ["vec_id"])


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).withColumn("fused", F.round("fused", 9))


def rerank_select(spark: SparkSession, d: str) -> DataFrame:
    """A scorer of the id's last digit stands in for a reranker; one in seven isn't scored."""
    scored = _fused(spark, d).withColumn("score", F.when(F.col("vec_id") % 7 != 0, F.col("vec_id") % 10 - 4.0))
    chosen = fusion.select_survivors(scored, "score", "place", fusion.wanted_rows(0))
    return chosen.select("vec_id", "score", "place")


def rerank_window(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").where("text != ''").select("doc_id", F.lit(1).cast("long").alias("start"), "text")
    return fusion.rerank_window(hits, "text", "start", F.lit("that with"), context=1)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and hashed bag-of-words cosine over documents, fused; see plans.search for the API."""
    from sievelight.plans.search import hashed_vector

    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    lexical = fusion.ranked(rounded(bm25.search(docs, QUERY, "doc_id", "text", 50)), "score", "doc_id")
    vectors = docs.select("doc_id", text.made_once(hashed_vector(F.col("text"))).alias("v"))
    query = spark.range(1).select(text.made_once(hashed_vector(F.lit(QUERY))).alias("qvec"))
    dense = fusion.ranked(fusion.dense_topk(vectors, query, "doc_id", "v", 50).withColumn("score", F.round("score", 9)), "score", "doc_id")
    return fusion.fuse(lexical, dense, ["doc_id"]).withColumn("fused", F.round("fused", 9)).orderBy("place").limit(10)


def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    return _user_scores(table(spark, d, "events"))


def _user_scores(e: DataFrame) -> DataFrame:
    """Users as queries: their first ten events by time are hits, their greatest values expected."""
    hits = F.slice(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.col("event_type").alias("path")))), 1, 10)
    expected = F.slice(F.sort_array(F.collect_list(F.struct(F.col("value"), "event_id", F.col("event_type").alias("path"))), asc=False), 1, 3)
    g = e.groupBy("user_id").agg(hits.alias("h"), expected.alias("x"))
    line = lambda c: F.pmod(c, F.lit(40))
    g = g.select(
        "user_id",
        F.transform("h", lambda h: F.struct(h["path"].alias("path"), line(h["event_id"]).alias("start"), (line(h["event_id"]) + 9).alias("end"))).alias("hits"),
        F.transform("x", lambda x, i: F.struct(x["path"].alias("path"), F.when(i > 0, line(x["event_id"])).alias("lo"), F.when(i > 0, line(x["event_id"]) + 9).alias("hi"), (i + 1).cast("double").alias("grade"))).alias("expected"),
    )
    s = evaluation.score_queries(g, "hits", "expected", 10)
    return s.select("user_id", "matched", "expected_n", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def eval_single(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as queries with one expectation each: the reciprocal rank of the item's
    own document among documents that hold its first words, by id."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    probe = b.select("item_id", F.explode(F.array_distinct(F.slice(text.runs(F.lower("q")), 1, 6))).alias("w"))
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(text.runs(F.lower("text")))).alias("w"))
    counts = words.join(F.broadcast(probe), "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("item_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), F.col("doc_id")))), 1, 10).alias("h"))
    hits = F.transform("h", lambda x: F.struct(x["doc_id"].cast("string").alias("path"), F.lit(1).alias("start"), F.lit(1).alias("end")))
    want = F.array(F.struct((F.col("item_id") * 3).cast("string").alias("path"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit(1.0).alias("grade")))
    s = evaluation.score_queries(top.select("item_id", hits.alias("hits"), want.alias("expected")), "hits", "expected", 10)
    return s.select("item_id", "matched", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


def eval_by_mode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        F.col("event_type").alias("mode"), F.when(F.col("event_id") % 11 == 0, "failed").alias("error"), F.col("value").cast("long").alias("ms"),
        (F.col("event_id") % 5 / 4).alias("recall"), (F.lit(1.0) / (F.col("event_id") % 4 + 1)).alias("mrr"), (F.col("event_id") % 3 / 2).alias("ndcg"),
    )
    s = evaluation.by_mode(e)
    return s.select("mode", "queries", "errors", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "p50_ms", "p95_ms")


def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metric scalars over gains made of a document's first words."""
    g = F.transform(F.slice(text.runs(F.col("text")), 1, 5), lambda w: (F.char_length(w) % 4).cast("double"))
    docs = table(spark, d, "documents").select("doc_id", g.alias("g")).where("size(g) > 0")
    return docs.select(
        "doc_id", F.round(metrics.reciprocal_rank(F.col("g")), 6).alias("rr"), F.round(metrics.dcg(F.col("g")), 6).alias("dcg"),
        F.round(metrics.ndcg(F.col("g"), F.col("g"), F.lit(3)), 6).alias("ndcg3"),
    )


_SUB = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({w}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"
_EXPAND = """list_concat([w], CASE WHEN lower(w) <> w THEN [lower(w)] ELSE [] END,
       CASE WHEN len(string_split({sub}, ' ')) > 1 THEN list_transform(string_split({sub}, ' '), lambda x: lower(x)) ELSE [] END)""".replace("{sub}", _SUB.replace("{w}", "w"))
_TOKENS = f"""
words AS (SELECT doc_id, pos, w FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos
          FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM documents))),
tokens AS (SELECT doc_id, pos, unnest(range(len(e))) AS k, lower(unnest(e)) AS term FROM (SELECT doc_id, pos, {_EXPAND} AS e FROM words)),
dl AS (SELECT doc_id, count(*) AS dl FROM tokens GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tokens) / (SELECT count(*) FROM documents) AS avgdl),
"""


def _bm25_sql(words: list[str], where: str = "true", keep: str = "", extra: str = "true") -> str:
    terms = ", ".join(f"'{w}'" for w in words)
    return f"""
WITH {_TOKENS}
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN ({terms}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY tf.doc_id)
SELECT doc_id{keep}, round(score, 6) AS score FROM s JOIN documents USING (doc_id) WHERE {where} AND {extra} ORDER BY s.score DESC, doc_id LIMIT 50
"""


def _dense_sql(vec: int, where: str = "true") -> str:
    return f"""SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec})) AS score
      FROM embeddings WHERE {where}"""


_FUSED = ", ".join(
    f"l{k} AS (SELECT vec_id, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) - 1 AS r FROM (SELECT * FROM ({_dense_sql(k)}) WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 50))"
    for k in (0, 1)
) + """, f AS (SELECT coalesce(l0.vec_id, l1.vec_id) AS vec_id, l0.r AS r1, l1.r AS r2, coalesce(1.0 / (61 + l0.r), 0) + coalesce(1.0 / (61 + l1.r), 0) AS fused
      FROM l0 FULL JOIN l1 ON l0.vec_id = l1.vec_id),
g AS (SELECT *, row_number() OVER (ORDER BY fused DESC, coalesce(r1, (SELECT count(*) FROM l0) + r2)) - 1 AS place FROM f)"""

_HASHED = "(SELECT list_transform(range(64), lambda b: len(list_filter(h, lambda x: x = b))::DOUBLE) FROM (SELECT list_transform({words}, lambda w: (ascii(w) * 7 + length(w) * 31 + ascii(right(w, 1)) * 3) % 64) AS h))"
_LOW = "list_transform(regexp_extract_all({t}, '[A-Za-z0-9]+'), lambda w: lower(w))"

QUERIES = {f.__name__: f for f in (
    tok_runs, tok_subwords, postings_stats, bm25_topk, bm25_lang, bm25_path, bm25_phrase, bm25_postings, dense_topk, dense_label, rrf_fusion,
    rerank_select, rerank_window, hybrid_search, eval_scores, eval_single, eval_by_mode, rank_metrics,
)}
_Q = QUERY.split()
SQL = {
    "tok_runs": "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS token FROM documents) GROUP BY token",
    "tok_subwords": f"""
WITH names AS (SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'p' || p_partkey, p_brand || replace(p_type, ' ', '') FROM part),
words AS (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT id, regexp_extract_all(name, '[A-Za-z0-9]+') AS ws FROM names))
SELECT id, array_to_string(flatten(list(e ORDER BY pos)), ' ') AS tokens FROM (SELECT id, pos, {_EXPAND} AS e FROM words) GROUP BY id""",
    "postings_stats": f"""WITH {_TOKENS} per AS (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM per GROUP BY term ORDER BY cf DESC, term LIMIT 100""",
    "bm25_topk": _bm25_sql(_Q),
    "bm25_lang": _bm25_sql(_Q, "lang = 'en'", ", lang"),
    "bm25_path": _bm25_sql(_Q, "contains(source, 'src1')", ", source"),
    "bm25_phrase": _bm25_sql(["of", "the"], extra="""doc_id IN (SELECT a.doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS p FROM tokens) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS p FROM tokens) b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.term = 'of' AND b.term = 'the')"""),
    "bm25_postings": _bm25_sql(_Q),
    "dense_topk": f"SELECT vec_id, round(score, 6) AS score FROM ({_dense_sql(0)}) WHERE score > 0 ORDER BY ({'score'}) DESC, vec_id LIMIT 50",
    "dense_label": f"SELECT vec_id, round(score, 6) AS score FROM ({_dense_sql(0, 'label = 1')}) WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 50",
    "rrf_fusion": f"WITH {_FUSED} SELECT vec_id, r1, r2, round(fused, 9) AS fused, place FROM g",
    "rerank_select": f"""WITH {_FUSED}, s AS (SELECT vec_id, place, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 10 - 4.0 END::DOUBLE AS sc FROM g)
SELECT vec_id, coalesce(sc, 0) AS score, place FROM s ORDER BY coalesce(sc > 0, false) DESC, CASE WHEN sc > 0 THEN sc END DESC NULLS LAST, place LIMIT 10""",
    "rerank_window": r"""
WITH l AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents WHERE text <> ''),
m AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: contains(lower(x), 'that') OR contains(lower(x), 'with')), true) AS p FROM l),
w AS (SELECT doc_id, ls, CASE WHEN p > 0 THEN greatest(p - 1, 1) ELSE 1 END AS lo, CASE WHEN p > 0 THEN least(p + 1, len(ls)) ELSE least(3, len(ls)) END AS hi FROM m)
SELECT doc_id, lo::BIGINT AS start, array_to_string(ls[lo:hi], chr(10)) AS text, hi::BIGINT AS "end" FROM w""",
    "hybrid_search": f"""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM ({_bm25_sql(_Q)})),
v AS (SELECT doc_id, {_HASHED.replace("{words}", "d.ws")} AS v FROM (SELECT doc_id, {_LOW.replace("{t}", "text")} AS ws FROM documents) d),
q AS (SELECT {_HASHED.replace("{words}", "d.ws")} AS v FROM (SELECT {_LOW.replace("{t}", f"'{QUERY}'")} AS ws) d),
c AS (SELECT doc_id, list_cosine_similarity(v.v, q.v) AS score FROM v, q WHERE len(list_filter(v.v, lambda x: x > 0)) > 0),
b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS r FROM (SELECT * FROM c WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50)),
f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.r AS r1, b.r AS r2, coalesce(1.0 / (61 + a.r), 0) + coalesce(1.0 / (61 + b.r), 0) AS fused FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT doc_id, r1, r2, round(fused, 9) AS fused, row_number() OVER (ORDER BY f.fused DESC, coalesce(r1, (SELECT count(*) FROM a) + r2)) - 1 AS place FROM f ORDER BY place LIMIT 10""",
    "eval_scores": """
WITH RECURSIVE e AS (SELECT * FROM events),
h AS (SELECT user_id, event_type AS path, event_id % 40 AS s, event_id % 40 + 9 AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type) AS k FROM e QUALIFY k <= 10),
w AS (SELECT user_id, event_type AS path, event_id % 40 AS l, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC, event_type DESC) AS i FROM e QUALIFY i <= 3),
x AS (SELECT user_id, list({'i': i, 'path': path, 'lo': CASE WHEN i > 1 THEN l END, 'hi': CASE WHEN i > 1 THEN l + 9 END} ORDER BY i) AS x FROM w GROUP BY user_id),
r AS (SELECT user_id, x, 0::BIGINT AS k, []::BIGINT[] AS used, []::BIGINT[] AS g FROM x UNION ALL
 SELECT user_id, x, k, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END, list_append(g, coalesce(f, 0)) FROM (
  SELECT r.user_id, r.x, h.k, r.used, r.g, list_filter(r.x, lambda q: NOT list_contains(r.used, q.i) AND q.path = h.path AND (q.lo IS NULL OR (h.s <= q.hi AND q.lo <= h.e)))[1].i AS f
  FROM r JOIN h ON h.user_id = r.user_id AND h.k = r.k + 1)),
z AS (SELECT *, len(x) AS n, len(list_filter(g, lambda v: v > 0)) AS m FROM r QUALIFY k = max(k) OVER (PARTITION BY user_id)),
d AS (SELECT *, list_sum(list_transform(g, lambda v, i: (pow(2, v) - 1) / log2(i + 1))) AS dcg, list_sum(list_transform(range(1, n + 1), lambda v: (pow(2, n + 1 - v) - 1) / log2(v + 1))) AS ideal,
 list_position(list_transform(g, lambda v: v > 0), true) AS p FROM z)
SELECT user_id, m::BIGINT AS matched, n::BIGINT AS expected_n, round(m / n, 6) AS recall, round(CASE WHEN p > 0 THEN 1 / p ELSE 0 END, 6)::DOUBLE AS mrr, round(dcg / ideal, 6) AS ndcg FROM d""",
    "eval_single": r"""
WITH p AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+')[1:6])) AS w FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+'))) AS w FROM documents),
c AS (SELECT item_id, doc_id, count(*) AS n FROM d JOIN p USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS r FROM c QUALIFY r <= 10),
b AS (SELECT item_id, min(CASE WHEN doc_id = item_id * 3 THEN r END) AS r FROM r GROUP BY item_id)
SELECT item_id, (r IS NOT NULL)::BIGINT AS matched, round(coalesce(1.0 / r, 0), 6)::DOUBLE AS mrr, round(coalesce(1.0 / log2(r + 1), 0), 6)::DOUBLE AS ndcg FROM b""",
    "eval_by_mode": """SELECT event_type AS mode, count(*) AS queries, count(*) FILTER (event_id % 11 = 0) AS errors,
 round(avg(CASE WHEN event_id % 11 = 0 THEN 0 ELSE (event_id % 5) / 4 END), 6) AS recall, round(avg(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1.0 / (event_id % 4 + 1) END), 6)::DOUBLE AS mrr,
 round(avg(CASE WHEN event_id % 11 = 0 THEN 0 ELSE (event_id % 3) / 2 END), 6) AS ndcg, quantile_disc(trunc(value)::BIGINT, 0.5) AS p50_ms, quantile_disc(trunc(value)::BIGINT, 0.95) AS p95_ms
FROM events GROUP BY event_type""",
    "rank_metrics": r"""
WITH g AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+')[1:5], lambda w: (length(w) % 4)::DOUBLE) AS g FROM documents),
n AS (SELECT * FROM g WHERE len(g) > 0)
SELECT doc_id, round(CASE WHEN list_position(list_transform(g, lambda x: x > 0), true) > 0 THEN 1.0 / list_position(list_transform(g, lambda x: x > 0), true) ELSE 0 END, 6)::DOUBLE AS rr,
 round(coalesce(list_sum(list_transform(g, lambda x, i: (pow(2, x) - 1) / log2(i + 1))), 0), 6) AS dcg,
 round(CASE WHEN list_sum(list_transform(list_reverse_sort(g)[1:3], lambda x, i: (pow(2, x) - 1) / log2(i + 1))) = 0 THEN 1.0 ELSE
   list_sum(list_transform(g[1:3], lambda x, i: (pow(2, x) - 1) / log2(i + 1))) / list_sum(list_transform(list_reverse_sort(g)[1:3], lambda x, i: (pow(2, x) - 1) / log2(i + 1))) END, 6) AS ndcg3
FROM n""",
}
