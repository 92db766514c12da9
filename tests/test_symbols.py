from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.operators import symbols
from sievelight.plans.search import Index
from sievelight.sources import config, files

RUST = """//! Users of handle_login
use std::{fs::File, io::{self, Read as R}};

pub fn handle_login(user: &str) -> bool {
    // handle_login in a comment
    let s = "handle_login";
    check(user, handle_token)
}

pub struct Session { id: u32 }

impl<T> Show for Session<T> {
    fn spin(&self) -> u32 { self.id }
}
"""
PYTHON = "import os\nfrom .m import x\n\nclass Fetcher:\n    def get(self):\n        return x\n\n    def put(self):\n        pass\n\ndef helper():\n    return Fetcher()\n"
GO = 'package m\nimport (\n\t"fmt"\n\tx "net/http"\n)\ntype Server struct { a int }\nfunc (s *Server) Run() error { return nil }\nfunc main() { fmt.Println("main") }\n'
SCRIPT = 'import { a } from "./a";\nexport const x = "foo";\nexport { q } from \'./q\';\nclass Widget extends Base {\n  spin(n) { return /"b/.test(n) }\n}\n'


def tree(tmp_path):
    for name, text in {"src/auth.rs": RUST, "pkg/fetcher.py": PYTHON, "srv/main.go": GO, "web/w.ts": SCRIPT, "gen/out.py": "x = 1", "node_modules/a.js": "1", ".hidden.py": "1", "secret.rs": "", "notes.md": "# x", ".gitignore": "gen/\nsecret.rs\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "big.py").write_text("x = 1\n" * 200_000)
    return str(tmp_path)


def test_source_files(spark, tmp_path):
    got = files.source_files(spark, tree(tmp_path)).select("path", "lang").collect()
    assert sorted(map(tuple, got)) == [("pkg/fetcher.py", "python"), ("src/auth.rs", "rust"), ("srv/main.go", "go"), ("web/w.ts", "typescript")]
    assert "text" not in files.source_files(spark, str(tmp_path), content=False).columns


def test_ignore_rules():
    r = files.IgnoreRules()
    r.add("", "*.log\n!keep.log\n/top\nbuild/\na/**/b\n")
    r.add("sub", "x.py\n")
    assert [r.ignored(p, d) for p, d in (("d/a.log", False), ("keep.log", False), ("top", False), ("d/top", False), ("build", False), ("build/x", False), ("a/c/d/b", False), ("sub/x.py", False), ("x.py", False))] == [
        True, False, True, False, False, True, True, True, False,
    ]


def test_definitions():
    assert [(n, k, a, b, up) for n, k, a, b, _, up in symbols.definitions_of(RUST, "rust")] == [
        ("handle_login", "function", 4, 8, None), ("Session", "struct", 10, 10, None), ("Session", "impl", 12, 14, None), ("spin", "method", 13, 13, "Session"),
    ]
    assert symbols.definitions_of(RUST, "rust")[0][4] == "pub fn handle_login(user: &str) -> bool"
    assert [(n, k, up) for n, k, _, _, _, up in symbols.definitions_of(PYTHON, "python")] == [("Fetcher", "class", None), ("get", "method", "Fetcher"), ("put", "method", "Fetcher"), ("helper", "function", None)]
    assert [(n, k) for n, k, *_ in symbols.definitions_of(PYTHON + "def broken(:\n    pass\n", "python")][-1] == ("broken", "function")
    assert [(n, k) for n, k, *_ in symbols.definitions_of(GO, "go")] == [("Server", "struct"), ("Run", "method"), ("main", "function")]
    assert [(n, k, up) for n, k, _, _, _, up in symbols.definitions_of(SCRIPT, "typescript")] == [("Widget", "class", None), ("spin", "method", "Widget")]


def test_imports_and_references():
    assert list(symbols.rust_uses(RUST)) == ["std::fs::File", "std::io", "std::io::Read"]
    assert symbols.imports_of(PYTHON, "python") == ["os", ".m.x"]
    assert symbols.imports_of(GO, "go") == ["fmt", "net/http"]
    assert symbols.imports_of(SCRIPT, "typescript") == ["./a", "./q"]
    assert "foo" in list(symbols.quoted_imports(SCRIPT, "typescript", all_exports=True))
    assert [(line, col) for n, line, col, _ in symbols.identifiers(RUST, "rust") if n == "handle_login"] == [(4, 7)]


def test_store_and_search(spark, tmp_path):
    src = files.source_files(spark, tree(tmp_path / "t")).cache()
    store = symbols.SymbolStore(spark, str(tmp_path / "store"))
    assert store.stale(src) and store.build(src)["files"] == 4 and not store.stale(src)
    assert store.stale(src.where("path != 'srv/main.go'"))
    assert [r.source for r in store.importers("File").collect()] == ["src/auth.rs"]
    assert [(r.path, r.line) for r in store.references("Fetcher").collect()] == [("pkg/fetcher.py", 12)]
    about = store.refs("Session")
    assert about["impls"].count() == 1 and [r.name for r in about["methods"].collect()] == ["spin"] and about["orphans"].count() == 0
    assert {r["name"]: r["kinds"] for r in store.groups().collect()}["Session"] == ["impl", "struct"]
    index = Index.of_files(src, store.table("definitions"))
    assert index.search("handle_login", 3).first().path == "src/auth.rs"
    assert index.bm25("login", 5, lang="PYTHON").count() == 0 and index.bm25("fetcher", 5, path="pkg/").count() > 0
    rows, event = index.traced("helper", mode="bm25")
    assert event["results"] == len(rows) > 0 and "error" not in event


def test_specs(spark):
    spec, options = config.eval_spec(spark, '{"k": 5, "queries": [{"q": "login", "relevant": [{"path": "a", "lines": [1, 9], "grade": 2}, {"path": "b"}]}]}')
    row = spec.first()
    assert options["k"] == 5 and [(e.path, e.lo, e.grade) for e in row.expected] == [("a", 1, 2.0), ("b", None, 1.0)]
    layers = [config.parsed('{"projects": {"rust": {"name": "Rust", "lint": [{"name": "clippy", "cmd": "a"}]}}}'), config.parsed('{"projects": {"rust": {"lint": [{"name": "clippy", "cmd": "b"}]}}}')]
    from sievelight.operators.overlay import merged_commands

    assert merged_commands(config.commands(spark, layers).where(F.col("kind") == "lint"), "project").first().cmd == "b"
    assert config.projects(spark, layers).count() == 2
