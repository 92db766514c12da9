from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.functions import metrics, text


def scan_subwords(word):
    """The specification: cut at lower-Upper, before an acronym's last capital, between letters and digits."""
    out = [word[:1]]
    for k in range(1, len(word)):
        a, b = word[k - 1], word[k]
        cut = a.islower() and b.isupper() or a.isdigit() != b.isdigit() or a.isupper() and b.isupper() and word[k + 1 : k + 2].islower()
        if cut:
            out.append(b)
        else:
            out[-1] += b
    return out


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_expand(spark):
    rows = spark.createDataFrame([("handle_http_request",), ("getUserName",), ("HTTPServer",), ("parse2Json",), ("",), ("...!!!...",), (None,)], "t string")
    got = [r.x for r in rows.select(text.expand(F.col("t")).alias("x")).collect()]
    assert got[0] == ["handle", "http", "request"]
    assert got[1] == ["getUserName", "getusername", "get", "user", "name"]
    assert got[2] == ["HTTPServer", "httpserver", "http", "server"]
    assert got[3] == ["parse2Json", "parse2json", "parse", "2", "json"]
    assert got[4:] == [[], [], []]


def test_subwords_property(spark):
    words = ["".join(p) for n in (1, 2, 3, 4, 5) for p in __import__("itertools").product("aB1", repeat=n)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.subwords(F.col("w")).alias("s")).collect()
    assert all(r.s == scan_subwords(r.w) for r in rows)


def test_scalars(spark):
    assert one(spark, text.fnv1a64(F.lit("hello")).alias("x")).x == "a430d84680aabd0b"
    assert one(spark, text.fnv1a64(F.lit("")).alias("x")).x == "cbf29ce484222325"
    urls = ["https://u:p@host/x.git", "https://host/x.git", "git@host:x.git", "ssh://a@h/p@q"]
    got = [r.x for r in spark.createDataFrame([(u,) for u in urls], "u string").select(text.redacted_url(F.col("u")).alias("x")).collect()]
    assert got == ["https://host/x.git", "https://host/x.git", "git@host:x.git", "ssh://h/p@q"]
    assert one(spark, text.like_escaped(F.lit("50%_done\\x")).alias("x")).x == r"50\%\_done\\x"
    assert [one(spark, text.iso_time(F.lit(s)).alias("x")).x for s in (0, 10**9, 1759564427)] == ["1970-01-01T00:00:00Z", "2001-09-09T01:46:40Z", "2025-10-04T07:53:47Z"]
    assert [one(spark, text.duration(F.lit(m)).alias("x")).x for m in (7, 9999, 12345)] == ["7ms", "9999ms", "12.3s"]
    assert one(spark, text.argv(F.lit("{pm} run  test"), F.lit("pnpm")).alias("x")).x == ["pnpm", "run", "test"]
    assert one(spark, text.task_name(F.lit("a/_default")).alias("x"), text.task_name(F.lit("a/b.sh")).alias("y")) == ("a", "a:b")
    assert one(spark, text.local_url(F.lit(":81/v1")).alias("x")).x == "http://localhost:81/v1"
    assert one(spark, text.unquoted(F.lit("rb'abc'")).alias("x")).x == "abc"
    assert one(spark, text.jsonc_stripped(F.lit('{"a": 1, // no\n/* x */ "u": "http://h"}')).alias("x")).x == '{"a": 1, \n "u": "http://h"}'
    assert one(spark, text.truncated(F.lit("abc"), 2).alias("x")).x.startswith("ab\n")


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(k)).cast("float") for k in x]) if x else F.array().cast("array<float>")
    pairs = [(v(1, 0), v(1)), (v(), v()), (v(1, 0), v(0, 1)), (v(2, 0), v(1, 0)), (v(0, 0), v(1, 0))]
    assert list(one(spark, *[metrics.cosine(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])) == [0, 0, 0, 1, 0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=12), st.sampled_from([50, 95]))
def test_percentile_property(spark, values, p):
    want = sorted(values)[min(max(-(-len(values) * p // 100), 1), len(values)) - 1] if values else 0
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    assert rows.agg(metrics.nearest_rank(p / 100, "v").alias("x")).first().x == want


def test_runs_split_everything_else(spark):
    s = "foo.bar(baz) ünï_x9"
    assert one(spark, text.runs(F.lit(s)).alias("x")).x == re.findall("[A-Za-z0-9]+", s)
