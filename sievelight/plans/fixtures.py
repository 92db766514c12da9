"""Queries of the parser, chunk, tree, task and configuration operators over a small source
tree that is written here, with the rows that are expected of each as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import text
from sievelight.operators import bm25, chunking, context, evaluation, fusion, overlay, snapshot, symbols, telemetry
from sievelight.plans import retrieval
from sievelight.plans.search import Settings
from sievelight.plans.stored import StoredIndex
from sievelight.plans.tables import spread, table, work_dir
from sievelight.sources import config, files, project

RUST = """use std::{fs::File, io::{self, Read as R}};
use crate::store::Table;

pub struct Session { id: u32 }

impl Session {
    pub fn open(name: &str) -> Session {
        // helper in a comment
        let s = "helper";
        helper(name)
    }
}

fn helper(name: &str) -> Session { Session { id: 1 } }
"""
PYTHON = "import os\nfrom .models import User, Team as T\n\nclass Fetcher:\n    def get(self):\n        return helper(User)\n\ndef helper(x):\n    return x\n"
GO = 'package m\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\n\ntype Server struct { a int }\n\nfunc (s *Server) Run() error { return nil }\n\nfunc main() { fmt.Println("main") }\n'
SCRIPT = 'import { a } from "./a";\nimport React from "react";\nexport { q } from \'./q\';\n\nclass Widget extends Base {\n  spin(n) { return n }\n}\n'
SOURCES = [("src/auth.rs", RUST, "rust", 10), ("pkg/fetch.py", PYTHON, "python", 20), ("srv/main.go", GO, "go", 30), ("web/w.ts", SCRIPT, "typescript", 40)]
RUNNER_FILES = [
    ("Makefile", ".PHONY: all\nall: build\n\techo\nbuild:\n\tcc\nX := 1\n"), ("justfile", "# c\ntest arg:\n  run\nlint:\n  x\n"),
    ("mise.toml", "[tasks.fmt]\nrun = 'x'\n[tasks.\"a:b\"]\n[tasks.lint.sub]\n"), ("package.json", '{"scripts": {"start": "x", "build": "y"}}'), ("deno.jsonc", '{"tasks": {"dev": "x" /* c */}}'),
]


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "path string, text string, lang string, mtime long")


def sym_definitions(spark: SparkSession, d: str) -> DataFrame:
    return symbols.definitions(_sources(spark)).select("path", "name", "kind", "start", "end", "parent", "signature")


def sym_references(spark: SparkSession, d: str) -> DataFrame:
    """Uses of three names: none in comments and strings, none at a definition."""
    from sievelight.operators.relations import references_only

    names = F.col("name").isin("helper", "Session", "fmt")
    found = symbols.definitions(_sources(spark)).where(names & (F.col("kind") != "impl")).select("path", "name", F.col("start").alias("line"))
    uses = symbols.identifier_table(_sources(spark)).where(names)
    parts = [references_only(uses.where(F.col("name") == n), found.where(F.col("name") == n).select("path", "line")).select("name", "path", "line", "col") for n in ("helper", "Session", "fmt")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sym_imports(spark: SparkSession, d: str) -> DataFrame:
    return symbols.import_table(_sources(spark)).toDF("path", "source", "target").select("path", "target")


def sym_outline(spark: SparkSession, d: str) -> DataFrame:
    return symbols.outlined(symbols.definitions(_sources(spark))).select("path", "place", "depth", "head")


def sym_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by their label and back; types and impls told apart."""
    found = symbols.definitions(_sources(spark)).select("kind").distinct()
    return found.select("kind", F.col("kind").isin("struct", "enum", "trait", "class", "interface", "type").alias("is_type"), (F.col("kind") == "impl").alias("is_impl"))


def region_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of top-level definitions, the gaps between them and whole files without any."""
    src = _sources(spark).unionByName(spark.createDataFrame([("notes.txt", "one\n\ntwo\n", None, 1)], "path string, text string, lang string, mtime long"))
    found = chunking.chunk_files(src.select("path", "text"), symbols.definitions(src))
    return found.select(chunking.chunk_id(F.col("path"), F.col("start"), F.col("end")).alias("chunk"), "path", "start", "end", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"))


def runner_tasks(spark: SparkSession, d: str) -> DataFrame:
    return context.tasks(spark.createDataFrame(RUNNER_FILES, "path string, text string"))


def import_graph(spark: SparkSession, d: str) -> DataFrame:
    return context.import_graph(_sources(spark)).select("path", F.explode("imports").alias("target"))


def git_counters(spark: SparkSession, d: str) -> DataFrame:
    lines = ["M  a", "A  b", "D  c", " M d", "MM e", "?? f", "?? g", "R  h -> i", ""]
    return context.git_status(spark.createDataFrame([(x,) for x in lines], "line string"))


def dir_listing(spark: SparkSession, d: str) -> DataFrame:
    paths = ["a/x.rs", "a/y.rs", "a/b/z.py", "top.md", "a/c/k.ts", "a/c/m.js"]
    return context.listing(spark.createDataFrame([(p,) for p in paths], "path string"))


def structure_summary(spark: SparkSession, d: str) -> DataFrame:
    paths = ["src/a.rs", "src/a_test.rs", "tests/b.py", "web/c.spec.ts", "web/c.ts", "README.md"]
    return context.structure(spark.createDataFrame([(p,) for p in paths], "path string"))


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    return context.tree(spark.createDataFrame([("a/b/c/d.rs",), ("a/x.py",), ("y",)], "path string"), 3)


def tree_signature(spark: SparkSession, d: str) -> DataFrame:
    return context.signature(_sources(spark)).select("mtime_sum", "files")


def success_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False)], "plan string, success boolean")
    one = lambda p: overlay.overall(rows.where(F.col("plan") == p)).withColumn("plan", F.lit(p))
    return one("a").unionByName(one("b")).unionByName(one("none"))


def intelligence_union(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "Go", None, None, ["lint"], None), (0, "Rust", "native", "CLI", ["fmt", "lint"], None), (2, None, "node", "Library", None, "web/w.ts")]
    got = overlay.joined_intelligence(spark.createDataFrame(rows, "place int, stack string, runtime string, arch string, gates array<string>, entry string"))
    return got.withColumn("gates", F.array_join("gates", ","))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = [
        ("url", ":8081/v1"), ("url", "http://h/x"), ("literal", "r\"a b\""), ("literal", "'x'"), ("literal", "`t`"), ("jsonc", '{"u": "http://x", // c\n"v": 1}'), ("task", "db/_default"), ("task", "db/reset.sh"), ("task", "lint"),
        ("argv", "{pm} run  lint"), ("argv", "cargo fmt"), ("cut", "é" * 5000), ("cut", "short"),
    ]
    df = spark.createDataFrame(rows, "form string, value string")
    v = F.col("value")
    out = (
        F.when(F.col("form") == "url", text.local_url(v)).when(F.col("form") == "literal", text.unquoted(v)).when(F.col("form") == "jsonc", text.jsonc_stripped(v))
        .when(F.col("form") == "task", text.task_name(v)).when(F.col("form") == "argv", F.array_join(text.argv(v, F.lit("pnpm")), "|"))
        .otherwise(F.concat_ws(" ", F.octet_length(text.truncated(v)).cast("string"), F.right(text.truncated(v), F.lit(12))))
    )
    return df.select("form", F.left("value", F.lit(20)).alias("value"), out.alias("form_of"))


def snippet_lines(spark: SparkSession, d: str) -> DataFrame:
    body = "\n".join(["alpha", "b", "c", "needle one", "e", "f", "g", "h", "i", "Needle two", "k"])
    rows = spark.createDataFrame([(1, body, "needle"), (2, body, "absent"), (3, "x", "x")], "id int, body string, q string")
    return rows.select("id", fusion.snippet(F.col("body"), F.col("q"), 1).alias("lines"))


def command_plan(spark: SparkSession, d: str) -> DataFrame:
    """The commands of two layers that apply to a tree, with their words and by cost."""
    host = files.host_predicates(spark.createDataFrame([("Cargo.toml", "[package]")], "path string, text string"))
    layers = [
        {"lint": [{"name": "clippy", "cmd": "cargo clippy", "fix": "cargo clippy --fix"}, {"name": "audit", "cmd": "{pm} audit", "security": True, "cost": 10, "when": "glob('Cargo.toml')"}, {"name": "vet", "cmd": "go vet", "when": "glob('go.mod')"}]},
        {"lint": [{"name": "clippy", "cmd": "cargo clippy -q", "fix": "cargo fix"}, {"name": "odd", "cmd": "x", "when": "nothing('x')"}]},
    ]
    merged = overlay.merged_commands(config.commands(spark, layers), "kind")
    found = overlay.applicable(project.with_conditions(merged, host))
    lines = project.command_lines(found, "pnpm", "fix")
    return lines.select("name", "place", F.array_join("argv", " ").alias("argv"), F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("security", F.lit(False)).alias("security"))


def project_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = [("rust", 0, "Rust", "cargo"), ("rust", 1, "", "cargo2"), ("go", 0, "Go", None), ("go", 1, "Golang", "go")]
    return overlay.merged_projects(spark.createDataFrame(rows, "id string, layer int, stack string, runtime string"))


def project_order(spark: SparkSession, d: str) -> DataFrame:
    groups = {"a": ["python", "rust"], "b": ["java", "javascript", "typescript"], "c": [], "d": ["go", "python"]}
    parts = [overlay.project_type(spark.createDataFrame([(x,) for x in t], "type string")).select(F.lit(k).alias("tree"), "type") for k, t in groups.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions over a tree; an error is false, a text isn't true."""
    host = files.host_predicates(spark.createDataFrame([("Cargo.toml", "[[bin]]"), ("package.json", '{"scripts": {"lint": "x"}}'), ("src/a/m.rs", "")], "path string, text string"))
    cases = ["glob('Cargo.toml') && contains('Cargo.toml', '[[bin]]')", "glob('src/**/*.rs')", "script('lint') || false", "!glob('go.mod')", "nothing('x')", "'text'", "contains('Cargo.toml', 'nope')"]
    return spark.createDataFrame([(c, project.Condition(c).holds(host)) for c in cases], "source string, holds boolean")


def eval_expectations(spark: SparkSession, d: str) -> DataFrame:
    spec, options = config.eval_spec(spark, '{"k": 5, "queries": [{"q": "login", "relevant": [{"path": "a", "lines": [1, 9], "grade": 2}, {"path": "b"}]}, {"q": "none", "relevant": []}]}')
    rows = spec.select("q", F.explode_outer("expected").alias("e"))
    return rows.select("q", "e.path", F.col("e.lo").cast("long").alias("lo"), F.col("e.hi").cast("long").alias("hi"), F.col("e.grade").alias("grade"), F.lit(options["k"]).cast("long").alias("k"))


def mode_shortcomings(spark: SparkSession, d: str) -> DataFrame:
    """Per mode the queries without a result and those that fell back, with their numbers."""
    rows = [("search", "bm25", "a", 5, 0, False, None), ("search", "bm25", "a", 6, 0, False, None), ("search", "bm25", "b", 7, 2, True, None), ("search", "hybrid", "c", None, 0, True, None), ("search", None, "d", 1, 0, None, "boom"), ("index_build", None, None, 9, None, None, None)]
    return telemetry.shortcomings(spark.createDataFrame(rows, "kind string, mode string, query string, total_ms bigint, results bigint, fallback boolean, error string"))


def _turns(spark: SparkSession) -> list[tuple[str, DataFrame]]:
    """A tree over time: as it is, the same again, one file changed and one removed of five."""
    more = spark.createDataFrame([("notes/a.py", "def a():\n    return 1\n", "python", 1)], "path string, text string, lang string, mtime long")
    first = _sources(spark).unionByName(more)
    later = first.where("path != 'web/w.ts'").withColumn("mtime", F.when(F.col("path") == "notes/a.py", 2).otherwise(F.col("mtime")))
    later = later.withColumn("text", F.when(F.col("path") == "notes/a.py", F.lit("def fetcher_two():\n    return 2\n")).otherwise(F.col("text")))
    return [("first", first), ("again", first), ("later", later)]


def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    """How a stored index follows its tree: the mode of each store at each turn, and its files."""
    rows: list[tuple] = []
    index = StoredIndex(spark, work_dir(spark, "index"), Settings(enabled=False), buckets=2)
    for turn, tree in _turns(spark):
        rows.append((turn, "stale", str(index.stale(tree)).lower(), tree.count()))
        rows += [(turn, store, done["mode"], done["files"]) for store, done in index.refresh(tree).items()]
    return spark.createDataFrame(rows, "turn string, store string, mode string, files long")


def index_search(spark: SparkSession, d: str) -> DataFrame:
    """First hits of a stored index, by words, language, path and mode."""
    index = StoredIndex(spark, work_dir(spark, "index"), buckets=1)
    index.refresh(_turns(spark)[-1][1])
    cases = [("fetcher", {}), ("helper", {"lang": "Rust"}), ("helper", {"path": "pkg/"}), ("spin", {}), ("\"server struct\"", {}), ("fetcher_two", {"mode": "hybrid"})]
    out = None
    for q, options in cases:
        how = {"mode": "bm25"} | options
        found = index.search(q, 1, **how).select(F.lit(q).alias("q"), F.lit(",".join(f"{k}={v}" for k, v in sorted(how.items()))).alias("how"), "path", F.col("start").cast("long").alias("start"))
        out = found if out is None else out.unionByName(found)
    return out


def build_log(spark: SparkSession, d: str) -> DataFrame:
    """What builds tell the event log, failures too."""
    place = work_dir(spark, "log")
    for store, mode, n in (("bm25", "full", 5), ("bm25", "none", 5), ("bm25", "delta", 4), ("semantic", "full", 4)):
        telemetry.recorded(spark, f"{place}/events", store, lambda mode=mode, n=n: {"mode": mode, "files": n, "chunks": 9})
    try:
        telemetry.recorded(spark, f"{place}/events", "bm25", lambda: {}["files"])
    except KeyError:
        pass
    events = telemetry.read_events(spark, f"{place}/events")
    return events.groupBy("store", "rebuilt", "incremental", "files", "error").agg(F.count(F.lit(1)).alias("events"))


def eval_report(spark: SparkSession, d: str) -> DataFrame:
    """The summary events of an evaluation's report, which stands in a folder."""
    place = work_dir(spark, "eval")
    spec = spark.createDataFrame([("a", [("x", 1, 9, 1.0)]), ("b", [("y", None, None, 2.0)])], "q string, expected array<struct<path: string, lo: bigint, hi: bigint, grade: double>>")
    hits = "q string, hits array<struct<path: string, start: bigint, end: bigint>>, ms long, error string"
    good = lambda q: spark.createDataFrame([("a", [("x", 2, 3)], 5, None), ("b", [("z", 1, 2), ("y", 1, 2)], 7, None)], hits)
    bad = lambda q: spark.createDataFrame([("a", None, None, "down"), ("b", [("y", 1, 2)], 9, None)], hits)
    evaluation.report(evaluation.evaluate(spec, {"bm25": good, "hybrid": bad}, 10), place, f"{place}/events")
    events = telemetry.read_events(spark, f"{place}/events")
    return events.select("kind", "mode", "queries", "recall", "mrr", F.round("ndcg", 6).alias("ndcg"), "k", F.col("report").isNotNull().alias("reported"))


def stored_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ranking of bm25_topk from postings that are stored in order of their terms."""
    place = work_dir(spark, "postings")
    docs = spread(table(spark, d, "documents").select("doc_id", "text", F.col("doc_id").alias("mtime")))
    store = snapshot.Store(spark, f"{place}/postings", lambda f: bm25.postings(f, "doc_id", "text"), key="doc_id", order=("term",))
    lengths = snapshot.Store(spark, f"{place}/lengths", lambda f: f.select("doc_id", F.size(text.index_tokens(F.col("text"))).cast("long").alias("dl")), key="doc_id")
    store.refresh(docs)
    lengths.refresh(docs)
    return retrieval.rounded(bm25.search_postings(store.table(), lengths.table(), retrieval.QUERY, "doc_id", 50))


def _values(names: str, *rows: tuple) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "concat(" + ", chr(10), ".join("'" + p.replace("'", "''") + "'" for p in v.split("\n")) + ")" if "\n" in v else "'" + v.replace("'", "''") + "'"
        return str(v).upper() if isinstance(v, bool) else repr(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


_all = [
    sym_definitions, sym_references, sym_imports, sym_outline, sym_kinds, region_chunks, runner_tasks, import_graph, git_counters, dir_listing, structure_summary, tree_paths, tree_signature, success_flag,
    intelligence_union, text_forms, snippet_lines, command_plan, project_merge, project_order, conditions, eval_expectations, mode_shortcomings,
    index_refresh, index_search, build_log, eval_report, stored_bm25,
]
QUERIES = {f.__name__: f for f in _all}
SQL: dict[str, str] = {
    "sym_definitions": _values(
        'path, name, kind, "start", "end", parent, signature',
        ("pkg/fetch.py", "Fetcher", "class", 4, 6, None, None), ("pkg/fetch.py", "get", "method", 5, 6, "Fetcher", "def get(self):"), ("pkg/fetch.py", "helper", "function", 8, 9, None, "def helper(x):"),
        ("src/auth.rs", "Session", "struct", 4, 4, None, None), ("src/auth.rs", "Session", "impl", 6, 12, None, None), ("src/auth.rs", "open", "method", 7, 11, "Session", "pub fn open(name: &str) -> Session"),
        ("src/auth.rs", "helper", "function", 14, 14, None, "fn helper(name: &str) -> Session"), ("srv/main.go", "Server", "struct", 8, 8, None, None), ("srv/main.go", "Run", "method", 10, 10, None, "func (s *Server) Run() error"),
        ("srv/main.go", "main", "function", 12, 12, None, "func main()"), ("web/w.ts", "Widget", "class", 5, 7, None, None), ("web/w.ts", "spin", "method", 6, 6, "Widget", "spin(n)"),
    ),
    "sym_references": _values(
        "name, path, line, col", ("Session", "src/auth.rs", 6, 5), ("Session", "src/auth.rs", 7, 31), ("Session", "src/auth.rs", 14, 25), ("Session", "src/auth.rs", 14, 35),
        ("fmt", "srv/main.go", 12, 14), ("helper", "pkg/fetch.py", 6, 15), ("helper", "src/auth.rs", 10, 8),
    ),
    "sym_imports": _values(
        "path, target", ("pkg/fetch.py", "os"), ("pkg/fetch.py", ".models.User"), ("pkg/fetch.py", ".models.Team"), ("src/auth.rs", "std::fs::File"), ("src/auth.rs", "std::io"), ("src/auth.rs", "std::io::Read"),
        ("src/auth.rs", "crate::store::Table"), ("srv/main.go", "fmt"), ("srv/main.go", "net/http"), ("web/w.ts", "./a"), ("web/w.ts", "./q"), ("web/w.ts", "react"),
    ),
    "sym_outline": _values(
        "path, place, depth, head", ("pkg/fetch.py", 1, 0, "class Fetcher"), ("pkg/fetch.py", 2, 1, "def get(self):"), ("pkg/fetch.py", 3, 0, "def helper(x):"),
        ("src/auth.rs", 1, 0, "struct Session"), ("src/auth.rs", 2, 0, "impl Session"), ("src/auth.rs", 3, 1, "pub fn open(name: &str) -> Session"), ("src/auth.rs", 4, 0, "fn helper(name: &str) -> Session"),
        ("srv/main.go", 1, 0, "struct Server"), ("srv/main.go", 2, 0, "func (s *Server) Run() error"), ("srv/main.go", 3, 0, "func main()"), ("web/w.ts", 1, 0, "class Widget"), ("web/w.ts", 2, 1, "spin(n)"),
    ),
    "sym_kinds": _values("kind, is_type, is_impl", ("class", True, False), ("struct", True, False), ("impl", False, True), ("function", False, False), ("method", False, False)),
    "region_chunks": """WITH t(path, "start", "end", breadcrumb) AS (VALUES ('notes.txt', 1, 3, ''), ('pkg/fetch.py', 1, 2, ''), ('pkg/fetch.py', 4, 6, 'Fetcher'), ('pkg/fetch.py', 8, 9, 'helper'),
        ('src/auth.rs', 1, 2, ''), ('src/auth.rs', 4, 4, 'Session'), ('src/auth.rs', 6, 12, 'Session'), ('src/auth.rs', 14, 14, 'helper'), ('srv/main.go', 1, 6, ''), ('srv/main.go', 8, 8, 'Server'),
        ('srv/main.go', 10, 10, 'Run'), ('srv/main.go', 12, 12, 'main'), ('web/w.ts', 1, 3, ''), ('web/w.ts', 5, 7, 'Widget'))
        SELECT path || ':' || "start" || '-' || "end" AS chunk, path, "start", "end", breadcrumb FROM t""",
    "runner_tasks": _values(
        "runner, task", ("deno", "dev"), ("just", "lint"), ("just", "test"), ("make", "all"), ("make", "build"), ("mise", "a:b"), ("mise", "fmt"), ("mise", "lint"), ("npm", "build"), ("npm", "start"),
    ),
    "import_graph": _values("path, target", ("pkg/fetch.py", ".models"), ("src/auth.rs", "crate::store::Table"), ("srv/main.go", "fmt"), ("srv/main.go", "net/http"), ("web/w.ts", "./a")),
    "git_counters": """SELECT count(*) FILTER (regexp_matches(l, '^[MAD] ')) AS staged, count(*) FILTER (NOT regexp_matches(l, '^[MAD] ') AND l[1:2] != '??' AND trim(l) != '') AS modified,
        count(*) FILTER (l[1:2] = '??') AS untracked FROM (VALUES ('M  a'), ('A  b'), ('D  c'), (' M d'), ('MM e'), ('?? f'), ('?? g'), ('R  h -> i'), ('')) t(l)""",
    "dir_listing": _values("dir, files", (".", "top.md"), ("a", "{x,y}.rs"), ("a/b", "z.py"), ("a/c", "{k.ts,m.js}")),
    "structure_summary": _values("dir, files, tests", (".", 1, 0), ("src", 2, 1), ("tests", 1, 1), ("web", 2, 1)),
    "tree_paths": _values("path, depth, is_dir", ("a", 1, True), ("a/b", 2, True), ("a/b/c", 3, True), ("a/x.py", 2, False), ("y", 1, False)),
    "tree_signature": "SELECT sum(m)::BIGINT AS mtime_sum, count(*) AS files FROM (VALUES (10), (20), (30), (40)) t(m)",
    "success_flag": """SELECT p AS plan, coalesce(bool_and(s), true) AS success, CASE WHEN coalesce(bool_and(s), true) THEN 0 ELSE 1 END AS exit_code
        FROM (VALUES ('a'), ('b'), ('none')) q(p) LEFT JOIN (VALUES ('a', true), ('a', true), ('b', true), ('b', false)) t(plan, s) ON plan = p GROUP BY p""",
    "intelligence_union": _values("stack, runtime, arch, entry, gates", ("Rust|Go", "native", "CLI", "web/w.ts", "fmt,lint")),
    "text_forms": _values(
        "form, value, form_of", ("url", ":8081/v1", "http://localhost:8081/v1"), ("url", "http://h/x", "http://h/x"), ("literal", 'r"a b"', "a b"), ("literal", "'x'", "x"), ("literal", "`t`", "t"),
        ("jsonc", '{"u": "http://x", //', '{"u": "http://x", \n"v": 1}'), ("task", "db/_default", "db"), ("task", "db/reset.sh", "db:reset"), ("task", "lint", "lint"),
        ("argv", "{pm} run  lint", "pnpm|run|lint"), ("argv", "cargo fmt", "cargo|fmt"), ("cut", "é" * 20, "8204 \n[truncated]"), ("cut", "short", "5 short"),
    ),
    "snippet_lines": _values("id, lines", (1, "c\nneedle one\ne\n…\ni\nNeedle two\nk"), (2, "alpha\nb\nc"), (3, "x")),
    "command_plan": _values("name, place, argv, cost, security", ("clippy", 0, "cargo fix", 0, False), ("audit", 1, "pnpm audit", 10, True)),
    "project_merge": _values("id, stack, runtime", ("rust", "Rust", "cargo2"), ("go", "Golang", "go")),
    "project_order": _values("tree, type", ("a", "rust"), ("b", "typescript"), ("c", "unknown"), ("d", "go")),
    "conditions": _values(
        "source, holds", ("glob('Cargo.toml') && contains('Cargo.toml', '[[bin]]')", True), ("glob('src/**/*.rs')", True), ("script('lint') || false", True), ("!glob('go.mod')", True),
        ("nothing('x')", False), ("'text'", False), ("contains('Cargo.toml', 'nope')", False),
    ),
    "eval_expectations": "SELECT * FROM (VALUES ('login', 'a', 1::BIGINT, 9::BIGINT, 2.0::DOUBLE, 5), ('login', 'b', NULL, NULL, 1.0, 5), ('none', NULL, NULL, NULL, NULL, 5)) t(q, path, lo, hi, grade, k)",
    "mode_shortcomings": _values("mode, what, query, times, place", ("bm25", "fallback", "b", 1, 1), ("bm25", "zero_result", "a", 2, 1), ("hybrid", "fallback", "c", 1, 1), ("hybrid", "zero_result", "c", 1, 1), ("unknown", "error", "d", 1, 1)),
    "index_refresh": _values(
        "turn, store, mode, files", ("first", "stale", "true", 5), ("first", "chunks", "full", 5), ("first", "bm25", "full", 5), 
        ("again", "stale", "false", 5), ("again", "chunks", "none", 5), ("again", "bm25", "none", 5),
        ("later", "stale", "true", 4), ("later", "chunks", "delta", 4), ("later", "bm25", "delta", 4),
    ),
    "index_search": _values(
        'q, how, path, "start"', ("fetcher", "mode=bm25", "pkg/fetch.py", 4), ("helper", "lang=Rust,mode=bm25", "src/auth.rs", 14), ("helper", "mode=bm25,path=pkg/", "pkg/fetch.py", 8),
        ('"server struct"', "mode=bm25", "srv/main.go", 8), ("fetcher_two", "mode=hybrid", "notes/a.py", 1),
    ),
    "build_log": "SELECT * FROM (VALUES ('bm25', true, false, 5, NULL, 1), ('bm25', false, false, 5, NULL, 1), ('bm25', false, true, 4, NULL, 1), ('semantic', true, false, 4, NULL, 1), ('bm25', NULL, NULL, NULL, chr(39) || 'files' || chr(39), 1)) t(store, rebuilt, incremental, files, error, events)",
    "eval_report": """SELECT 'eval_run' AS kind, mode, 2 AS queries, recall, mrr, round(ndcg, 6) AS ndcg, 10 AS k, true AS reported
        FROM (VALUES ('bm25', 1.0::DOUBLE, 0.75::DOUBLE, (1 + 1 / log2(3)) / 2), ('hybrid', 0.5, 0.5, 0.5)) t(mode, recall, mrr, ndcg)""",
    "stored_bm25": retrieval.SQL["bm25_topk"],
}
