"""A description of a source tree: its parts as DataFrames, and one Markdown or JSON text of them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.text import braced
from sievelight.operators import context

#: Files whose head a description quotes, and the compiler options and linter
#: words that state rules.
METADATA = ("package.json", "tsconfig.json", "Cargo.toml", "pyproject.toml", "go.mod", "build.gradle", "build.gradle.kts")
METADATA_LINES = 60
OPTIONS = {
    "strict": "Use strict type checking", "noUncheckedIndexedAccess": "No unchecked indexed access", "noImplicitReturns": "Explicit return statements",
    "noUnusedLocals": "No unused locals", "noUnusedParameters": "No unused parameters",
}
LINTERS = ("eslint.config.js", "eslint.config.mjs", ".eslintrc.js", ".eslintrc.json", "eslint.config.ts")
LINT_WORDS = {
    "typescript-eslint": "Use typescript-eslint parser", "stylistic": "Use stylistic rules for formatting", "no-unused-vars": "No unused variables",
    "no-console": "No console calls (use logging library instead)", "prefer-const": "Prefer const over let when variables aren't reassigned", "no-var": "Use const/let, never var",
}


def head(text: Column, lines: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")


def metadata(files: DataFrame) -> DataFrame:
    """The heads of metadata files, in fixed order."""
    order = F.array_position(F.array(*[F.lit(x) for x in METADATA]), F.col("path"))
    return files.where(F.col("path").isin(*METADATA)).orderBy(order).select("path", head(F.col("text"), METADATA_LINES).alias("text"))


def code_rules(files: DataFrame) -> DataFrame:
    """Rules that compiler options and the linter's configuration state: source, rule."""
    ts = files.where("path = 'tsconfig.json'")
    option = lambda k: F.get_json_object("text", f"$.compilerOptions.{k}")
    stated = [F.when(option(k) == "true", F.lit(rule)) for k, rule in OPTIONS.items()] + [F.concat(F.lit(f"{k}: "), option(k)) for k in ("module", "target")]
    options = ts.select(F.lit("compiler").alias("source"), F.explode(F.array_compact(F.array(*stated))).alias("rule"))
    place = F.array_position(F.array(*[F.lit(x) for x in LINTERS]), F.col("path"))
    linter = files.where(F.col("path").isin(*LINTERS)).orderBy(place).limit(1)
    words = [F.when(F.contains("text", F.lit(w)), F.lit(rule)) for w, rule in LINT_WORDS.items()]
    return options.unionByName(linter.select(F.lit("linter").alias("source"), F.explode(F.array_compact(F.array(*words))).alias("rule")))


def test_pattern(files: DataFrame, lines: int = 20) -> DataFrame:
    """The head of the first test file."""
    tests = files.where(F.col("path").rlike(r"\.test\.tsx?$|(^|/)test_[^/]*\.py$|_test\.go$"))
    return tests.orderBy("path").limit(1).select("path", head(F.col("text"), lines).alias("text"))


def drawn(tree: DataFrame) -> str:
    """A tree of paths as lines with branches."""
    rows = sorted((tuple(r.path.split("/")), r.is_dir) for r in tree.collect())
    last = {}
    for parts, _ in rows:
        last[parts[:-1]] = parts
    lines = []
    for parts, is_dir in rows:
        bars = "".join("    " if last[parts[:k]] == parts[: k + 1] else "│   " for k in range(len(parts) - 1))
        lines.append(bars + ("└── " if last[parts[:-1]] == parts else "├── ") + parts[-1] + ("/" if is_dir else ""))
    return "\n".join(lines)


def parts(files: DataFrame, definitions: DataFrame | None = None, findings: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of a description of files (path, text, lang), in order."""
    from sievelight.operators.overlay import by_severity

    code = files.where("lang is not null").select("lang", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("code"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x).rlike("^(//|#|\\*|/\\*)"))).cast("long").alias("comments"))
    out = {
        "metadata": metadata(files), "rules": code_rules(files), "listing": context.listing(files), "stats": context.language_stats(code),
        "imports": context.import_graph(files).select("path", braced(F.col("imports")).alias("imports")),
    }
    if findings is not None:
        out["findings"] = by_severity(findings, 10, "path")
    if definitions is not None:
        out["symbols"] = context.symbol_map(definitions)
    out |= {"todos": context.todos(files), "tests": test_pattern(files), "readme": context.readme_head(files.where("path = 'README.md'"), "path", "text"), "structure": context.structure(files)}
    return out


def as_json(found: dict[str, DataFrame]) -> str:
    return json.dumps({k: [r.asDict(True) for r in df.collect()] for k, df in found.items()}, ensure_ascii=False)


def as_markdown(found: dict[str, DataFrame], line: Callable[[dict], str] | None = None) -> str:
    """A section a part that has rows, one line a row."""
    show = line or (lambda r: "- " + ", ".join(f"{v}" for v in r.values() if v is not None))
    sections = []
    for name, df in found.items():
        if rows := df.collect():
            sections.append("\n".join([f"## {name.capitalize()}", *[show(r.asDict(True)) for r in rows]]))
    return "\n\n".join(sections)


def rendered_hits(hits: DataFrame, as_json: bool = False) -> str:
    """Search results as a JSON array, or as a numbered list."""
    if as_json:
        return "[" + ",".join(r[0] for r in hits.select(F.to_json(F.struct(*hits.columns))).collect()) + "]"
    return "\n".join(f"{k}. {r['path']}:{r['start']}-{r['end']} ({r['score']:.3f})" for k, r in enumerate(hits.collect(), 1)) or "no results"
