from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sievelight.operators import evaluation, symbols
from sievelight.plans import document
from sievelight.plans.search import Index, Settings
from sievelight.sources import config, files, project

FILES = [
    ("Cargo.toml", '[package]\nname = "x"\n[[bin]]\n', None), ("src/main.rs", "mod a;\nuse crate::b::C;\n// TODO: tidy\nfn main() {}\n", "rust"), ("package.json", '{"scripts": {"lint": "x"}}', None),
    ("pnpm-lock.yaml", "", None), ("tsconfig.json", '{"compilerOptions": {"strict": true, "target": "es2022"}}', None), (".eslintrc.json", '{"rules": {"no-console": 1}}', None),
    ("README.md", "# X\nintro\n## One\na\n## Two\nb\n", None), ("web/a.test.ts", 'import { x } from "./b";\ntest()\n', "typescript"),
]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(FILES, "path string, text string, lang string").cache()


def test_conditions(tree):
    host = files.host_predicates(tree, "/r", lambda name: name == "cargo") | {"project": lambda p: p == "rust"}
    holds = lambda c: project.Condition(c).holds(host)
    assert holds("glob('Cargo.toml') && contains('Cargo.toml', '[[bin]]')") and holds("glob('src/**/*.rs') || false") and not holds("!bin('cargo')")
    assert holds("script('lint') && !project('go')") and not holds("nothing('x')") and not holds("'text'") and holds("repo_root == '/r'")
    assert project.value_or_text("='Rust ' + read('none') ", host) == "Rust" and project.value_or_text("=oops(", host) == "=oops(" and project.value_or_text("Go", host) == "Go"
    with pytest.raises(ValueError):
        project.validated(["'text'"], host)
    assert project.package_manager(tree) == "pnpm" and project.package_manager(tree.limit(0)) == "npm"
    block = {"stack": "RUST", "arch": {"cli": "contains('Cargo.toml', '[[bin]]')"}, "gates": [{"name": "a"}, {"name": "b", "when": "false"}], "entry_points": [{"path": "src/lib.rs"}, {"path": "src/main.rs", "purpose": "main"}]}
    assert project.intelligence(block, host) == project.Intelligence("RUST", "", "CLI", ("a",), ("src/main.rs", "main"))
    assert project.detected([{"projects": {"rust": {"detect": "glob('Cargo.toml')"}, "go": {"detect": "glob('go.mod')"}}}], host) == ["rust"]


def test_commands(spark, tree):
    host = files.host_predicates(tree)
    layers = [{"lint": [{"name": "a", "cmd": "{pm} run a", "fix": "{pm} fix"}, {"name": "audit", "cmd": "audit", "security": True, "cost": 10, "when": "glob('Cargo.toml')"}, {"name": "no", "cmd": "x", "when": "glob('go.mod')"}]}]
    from sievelight.operators.overlay import applicable

    found = project.with_conditions(config.commands(spark, layers), host)
    assert {r["name"] for r in applicable(found).collect()} == {"a", "audit"} and {r["name"] for r in applicable(found, cost=5).collect()} == {"a"}
    assert project.command_lines(found, "pnpm", "fix").where("name = 'a'").first().argv == ["pnpm", "fix"]
    assert [r["name"] for r in project.lint_plan(applicable(found), True).collect()] == ["audit"]
    assert "audit: audit (cost 10)" in project.preview(project.command_lines(found, "npm"))
    with pytest.raises(ValueError):
        project.of_type(spark.createDataFrame([("rust",)], "id string"), "GO")
    assert project.of_type(spark.createDataFrame([("rust",)], "id string"), "RUST").count() == 1


def test_git(spark, tmp_path):
    answers = {"branch": "main", "remote": "https://u:t@h/x", "log": "ab12 one\ncd34 two", "status": "M  a\n M b\n?? c"}
    row = project.git_context(spark, str(tmp_path), lambda a: answers.get(a[0])).first()
    assert (row.branch, row.remote, row.staged, row.modified, row.untracked) == ("main", "https://h/x", 1, 1, 1) and len(row.recent) == 2
    assert project.git_context(spark, str(tmp_path), lambda a: None) is None
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert project.root_of(str(tmp_path / "a" / "b")) == str(tmp_path)


def test_document(spark, tree):
    found = document.parts(tree, symbols.definitions(tree))
    whole = json.loads(document.as_json(found))
    assert [r["rule"] for r in whole["rules"]] == ["Use strict type checking", "target: es2022", "No console calls (use logging library instead)"]
    assert {r["path"]: r["imports"] for r in whole["imports"]} == {"src/main.rs": "{a,crate::b::C}", "web/a.test.ts": "./b"}
    assert whole["todos"][0]["text"] == "tidy" and whole["readme"][0] == {"path": "README.md", "head": "# X\nintro\n## One\na", "more": 2}
    assert whole["symbols"][0]["name"] == "main" and "## Todos" in document.as_markdown(found) and whole["tests"][0]["path"] == "web/a.test.ts"
    from sievelight.operators.context import tree as paths

    assert document.drawn(paths(tree.where("path like 'src%' or path like 'web%'"))) == "├── src/\n│   └── main.rs\n└── web/\n    └── a.test.ts"


def test_evaluate_index(spark, tree):
    index = Index.of_files(tree.where("lang is not null"), symbols.definitions(tree))
    spec, options = config.eval_spec(spark, '{"queries": [{"q": "main", "relevant": [{"path": "src/main.rs", "lines": [1, 4]}]}, {"q": "zzz", "relevant": [{"path": "x"}]}]}')
    scores = evaluation.evaluate(spec, {m: (lambda q, m=m: index.batch(q, options["k"], m)) for m in evaluation.MODES}, options["k"])
    means = {r.mode: r for r in evaluation.by_mode(scores).collect()}
    assert means["bm25"].recall == 0.5 and means["bm25"]["queries"] == 2 and means["hybrid"].errors == 0
    with pytest.raises(ValueError):
        Index(index.chunks.drop("chunk"), Settings(enabled=False)).search("main")
    rated = Index(index.chunks.drop("chunk"), reranker=lambda q, texts: [1.0 if "main" in t else None for t in texts])
    assert rated.search("main").first().path == "src/main.rs"
    assert json.loads(document.rendered_hits(index.bm25("main"), True))[0]["path"] == "src/main.rs" and document.rendered_hits(index.bm25("main")).startswith("1. src/main.rs:")


def test_settings():
    assert Settings().overlaid(embed_url="", rerank_topn=0, rerank_threshold=0.0, embed_model="m") == Settings(embed_model="m")
    assert Settings().overlaid(rerank_threshold=-1.0, enabled=False).rerank_threshold == -1.0


def test_reads(spark, tree):
    assert files.read_json("[1]") == {} and files.read_json("{") == {}
    assert [r.line for r in files.command_output(spark, ["printf", "a\\nb\\n"]).collect()] == ["a", "b"] and files.command_output(spark, ["false"]).count() == 0
    assert files.globbed(tree, "src/**/*.rs").count() == 1 and files.globbed(tree, ".eslintrc*").count() == 1 and files.globbed(tree, "*.rs").count() == 0
    assert [r.lang for r in spark.createDataFrame([("a.RS",), ("b.tsx",), ("c",), ("d.md",)], "p string").select(files.language(F.col("p")).alias("lang")).collect()] == ["rust", "typescript", None, None]
