from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievelight.operators import bm25, chunking, context, evaluation, fusion, overlay, relations, snapshot, telemetry


def test_chunking(spark):
    docs = spark.createDataFrame([(1, ""), (2, "a\nb\n"), (3, "\n".join(f"l{k}" for k in range(192))), (4, None)], "id int, text string")
    got = [(r.id, r.start, r.end) for r in chunking.window_chunks(docs, "id", "text").orderBy("id", "start").collect()]
    assert got == [(2, 1, 2), (3, 1, 64), (3, 57, 120), (3, 113, 176), (3, 169, 192)]


def test_window_starts_every_length(spark):
    rows = spark.range(1, 300).select(F.col("id").cast("int").alias("n")).select("n", chunking.window_starts(F.lit(1), F.col("n")).alias("s")).collect()
    for r in rows:
        want, s = [], 1
        while True:
            want.append(s)
            if s + 63 >= r.n:
                break
            s += 56
        assert r.s == want


def test_chunk_files(spark):
    text = "//! doc\n\nfn a() {\n  1\n}\n\n\nstruct B;\n\n// tail\n\n"
    files = spark.createDataFrame([("x.rs", text), ("y.sh", "x\ny\n")], "path string, text string")
    defs = spark.createDataFrame([("x.rs", "a", 3, 5, None), ("x.rs", "inner", 4, 4, "a"), ("x.rs", "B", 8, 8, None)], "path string, name string, start long, end long, parent string")
    got = {(r.path, r.start, r.end): r.breadcrumb for r in chunking.chunk_files(files, defs).collect()}
    assert got == {("x.rs", 1, 1): None, ("x.rs", 3, 5): "a", ("x.rs", 8, 8): "B", ("x.rs", 10, 10): None, ("y.sh", 1, 2): None}


def test_outer_regions_property(spark):
    rng = random.Random(5)
    rows = [(g, a, a + rng.randint(0, 9), k) for g in range(40) for k, a in enumerate(sorted(rng.randint(1, 30) for _ in range(8)))]
    want = set()
    for g in range(40):
        last = None
        for _, a, b, k in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2], r[3])):
            if last and a >= last[0] and b <= last[1]:
                continue
            last = (a, b)
            want.add((g, k))
    got = chunking.outer_regions(spark.createDataFrame(rows, "g int, start int, end int, k int"), "g")
    assert {(r.g, r.k) for r in got.collect()} == want


def test_query_parser():
    q = bm25.parse_query('foo +bar -baz "a b" gamma_unique "" (')
    assert (q.terms, q.must, q.must_not, q.phrases) == (("foo",), ("bar",), ("baz",), (("a", "b"), ("gamma", "unique")))
    assert bm25.parse_query("").scored == () and bm25.parse_query("+++ ---").scored == ()


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "fn handle_login() {}"), (2, "login page"), (3, "other"), (4, None)], "id int, text string")
    assert [r.id for r in bm25.search(docs, "login", "id", "text").collect()] == [2, 1]
    assert [r.id for r in bm25.search(docs, '"handle login"', "id", "text").collect()] == [1]
    assert [r.id for r in bm25.search(docs, "login -page", "id", "text").collect()] == [1]
    assert bm25.search(docs, "", "id", "text").count() == 0 and bm25.search(docs, "login", "id", "text", 0).count() == 0
    index, lengths = bm25.postings(docs, "id", "text"), docs.selectExpr("id", "2 as dl")
    assert [r.id for r in bm25.search_postings(index, lengths, '"handle login"', "id").collect()] == [1]


def test_fusion(spark):
    a = spark.createDataFrame([("a", 0), ("b", 1)], "k string, rank long")
    b = spark.createDataFrame([("c", 0), ("a", 3)], "k string, rank long")
    got = fusion.fuse(a, b, ["k"]).orderBy("place").collect()
    assert [r.k for r in got] == ["a", "c", "b"] and abs(got[0].fused - (1 / 61 + 1 / 64)) < 1e-12


@pytest.mark.parametrize(("scores", "topn", "want"), [([9, None, 5, 1], 4, [0, 2, 3, 1]), ([-1, -2, -3], 3, [0, 1, 2]), ([3, -1, 4], 2, [2, 0]), ([0, 5], 1, [1]), ([], 3, [])])
def test_selection(spark, scores, topn, want):
    rows = spark.createDataFrame([(k, float(s) if s is not None else None) for k, s in enumerate(scores)], "place long, score double")
    assert [r.place for r in fusion.select_survivors(rows, "score", "place", topn).collect()] == want
    assert fusion.wanted_rows(0) == 10 and fusion.wanted_rows(50) == 10 and fusion.wanted_rows(3) == 3


def test_rerank_window(spark):
    hits = spark.createDataFrame([(1, "a\nb\nNeedle x\nd\ne\nf", 10), (2, "a\nb\nc\nd", 5)], "id int, text string, start long")
    got = fusion.rerank_window(hits, "text", "start", F.lit("needle"), 1).orderBy("id").collect()
    assert (got[0].start, got[0].end, got[0].text) == (11, 13, "b\nNeedle x\nd") and (got[1].start, got[1].end) == (5, 7)


def greedy(hits, expected, k):
    used, out = set(), []
    for path, s, e in hits[:k]:
        grade = 0.0
        for i, (p, lo, hi, g) in enumerate(expected):
            if i not in used and p == path and (lo is None or (s <= hi and lo <= e)):
                used.add(i)
                grade = g
                break
        out.append(grade)
    return out


def test_evaluation_property(spark):
    rng = random.Random(3)
    rows = []
    for q in range(60):
        hits = [(rng.choice("abc"), s := rng.randint(1, 20), s + rng.randint(0, 6)) for _ in range(rng.randint(0, 8))]
        expected = [(rng.choice("abc"), *((None, None) if rng.random() < 0.4 else (lo := rng.randint(1, 20), lo + 3)), float(rng.randint(1, 3))) for _ in range(rng.randint(0, 4))]
        rows.append((q, hits, expected))
    df = spark.createDataFrame(rows, "q int, hits array<struct<path: string, start: int, end: int>>, expected array<struct<path: string, lo: int, hi: int, grade: double>>")
    got = {r.q: r for r in evaluation.score_queries(df.withColumn("g", evaluation.gains(F.col("hits"), F.col("expected"), 5)), "hits", "expected", 5).collect()}
    for q, hits, expected in rows:
        g = greedy(hits, expected, 5)
        assert got[q].g == g and got[q].matched == sum(x > 0 for x in g)
        assert got[q].recall == (1 if not expected else sum(x > 0 for x in g) / len(expected))
    with pytest.raises(ValueError):
        evaluation.checked_modes(["dense"])
    with pytest.raises(ValueError):
        evaluation.checked_modes([])


def test_telemetry(spark, tmp_path):
    log = str(tmp_path / "log")
    assert telemetry.read_events(spark, log).count() == 0
    e = spark.createDataFrame([("search", "bm25", 5, 0, "q1", None), ("search", "bm25", 7, 2, "q2", None), ("search", "bm25", None, None, "q3", "down"), ("index_build", None, 9, None, None, None)], "kind string, mode string, total_ms long, results long, query string, error string")
    telemetry.append_events(e, log, log_queries=False)
    with open(tmp_path / "log" / "part-bad.json", "w") as f:
        f.write("not json\n")
    events = telemetry.read_events(spark, log)
    row = telemetry.by_mode(events).first()
    assert (row["queries"], row["errors"], row["p50_ms"], row["p95_ms"], len(row["zero_result"])) == (3, 1, 5, 7, 1)
    assert row["zero_result"][0].startswith("h") and telemetry.totals(events).first().builds == 1


def test_snapshot_store(spark, tmp_path):
    def derive(files):
        return files.select("path", F.explode(F.split("text", " ")).alias("word"))

    def source(rows):
        return spark.createDataFrame(rows, "path string, mtime long, text string")

    store = snapshot.Store(spark, str(tmp_path / "s"), derive, buckets=4)
    first = [(f"f{k}", 1, f"w{k} x") for k in range(10)]
    assert store.refresh(source(first))["mode"] == "full" and not store.stale(source(first))
    assert store.refresh(source(first)) == {"mode": "none", "files": 10, "chunks": 0}
    then = [("f0", 2, "new"), *first[2:], ("g", 1, "added y")]
    assert store.stale(source(then)) and store.refresh(source(then))["mode"] == "delta"
    assert sorted(map(tuple, store.table().collect())) == sorted(map(tuple, derive(source(then)).collect()))
    assert store.refresh(source(then), force=True)["mode"] == "full"
    assert snapshot.Store(spark, str(tmp_path / "s"), derive, schema_version=2).manifest() is None
    assert [snapshot.policy(*a) for a in ((0, 5), (2, 4), (3, 4))] == ["none", "delta", "full"]


def test_overlay_and_tasks(spark):
    t = spark.createDataFrame([("npm", "run"), ("just", "dev"), ("make", "dev")], "runner string, task string")
    assert {r.task: r.runner for r in overlay.first_choice(t).collect()} == {"run": "npm", "dev": "just"}
    assert overlay.first_choice(t.withColumn("g", F.lit(1)), ("run", "start", "dev"), "g").first().task == "run"
    files = spark.createDataFrame(
        [("justfile", "x := 1\n@quiet:\n  do\nbuild arg: dep\n  y\n# c: d\n"), ("Makefile", ".PHONY: a\nall: b\n\tc\nV := 2\n%.o: x\n"), ("package.json", '{"scripts": {"test": "t", "dev": "d"}}'), ("mise.toml", '[tasks.lint]\n[tasks."my task"]\n[tasks.build.env]\n'), ("deno.jsonc", '{// c\n"tasks": {"fmt": "f"}}')],
        "path string, text string",
    )
    assert {(r.runner, r.task) for r in context.tasks(files).collect()} == {
        ("just", "quiet"), ("just", "build"), ("make", "all"), ("npm", "test"), ("npm", "dev"), ("mise", "lint"), ("mise", "my task"), ("mise", "build"), ("deno", "fmt"),
    }
    gradle = "Build tasks\n-----------\nassemble - Assembles\nclean\n> Task :x\n"
    assert spark.range(1).select(context.gradle_tasks(F.lit(gradle)).alias("x")).first().x == ["assemble", "clean"]
    results = spark.createDataFrame([(True,), (False,)], "success boolean")
    assert tuple(overlay.overall(results).first()) == (False, 1)
    git = spark.createDataFrame([("M  a",), (" M b",), ("?? c",), ("MM d",)], "line string")
    assert tuple(context.git_status(git).first()) == (1, 2, 1)


def test_relations(spark):
    edges = spark.createDataFrame([("a", "x::Store"), ("b", "x::MyStore"), ("a", "x::Store"), ("c", "100%")], "source string, target string")
    assert {r.source for r in relations.importers(edges, "Store").collect()} == {"a", "b"}
    assert {r.source for r in relations.importers(edges, "Store", boundary=True).collect()} == {"a"}
    assert {r.source for r in relations.importers(edges, "%").collect()} == {"c"}
