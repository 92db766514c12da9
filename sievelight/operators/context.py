"""Facts about a source tree: statistics, structure, TODOs, imports, README head, tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import braced
from sievelight.operators.chunking import effective_lines

#: The patterns of TODO marks, imports and task names.
TODO = r"(?i)(?://|#|<!--|/\*)\s*(TODO|FIXME|HACK|XXX)\b:?"
TODO_START = r"(?i)^(?://|#|<!--|/\*)\s*(?:TODO|FIXME|HACK|XXX):?\s*"
RUST_MODULE = r"(?m)^mod\s+(\w+)"
RUST_USE = r"use\s+((?:crate|super)::[\w:]+)"
PYTHON_RELATIVE = r"from\s+(\.[\w.]*)\s+import"
GO_BLOCK = r"import\s*\(([\s\S]*?)\)"
GO_QUOTED = '"([^"]+)"'
GO_SINGLE = r'import\s+"([^"]+)"'
SCRIPT_IMPORT = r"import\s+(?:type\s+)?(?:\{[^}]+\}|\*\s+as\s+\w+|\w+(?:\s*,\s*\{[^}]+\})?)\s+from\s+['\"]([^'\"]+)['\"]"
SCRIPT_REQUIRE = r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"
MISE_HEADER = r"(?m)^\s*\[tasks\.([^\]]*)\]"
JUST_RECIPE = r"(?m)^@?([a-zA-Z_][\w-]*)[^:\n]*:(?!=)"
MAKE_TARGET = r"(?m)^([a-zA-Z0-9_][a-zA-Z0-9_.\-]*)[ \t]*:(?!=)"
GRADLE_TASK = r"(?m)^[ \t]*([a-zA-Z][\w-]*)(?:[ \t]*$|[ \t]+-[ \t]+.*$)"


def language_stats(files: DataFrame, lang: str = "lang", code: str = "code", comments: str = "comments") -> DataFrame:
    """Per language code, comments and files, and a row 'Total' over all (grouping sets)."""
    return files.groupingSets([[lang], []], lang).agg(
        F.grouping(lang).alias("_total"), F.sum(code).alias("code"), F.sum(comments).alias("comments"), F.count(F.lit(1)).alias("files")
    ).select(F.when(F.col("_total") == 1, "Total").otherwise(F.col(lang)).alias("lang"), "code", "comments", "files")


def git_status(lines: DataFrame) -> DataFrame:
    """Counts of staged, modified and untracked files from porcelain lines (column line): staged
    are M, A and D with a clean work tree, untracked ??, all others modified."""
    staged, new = F.col("line").rlike("^[MAD] "), F.startswith("line", F.lit("??"))
    return lines.agg(F.count_if(staged).alias("staged"), F.count_if(~staged & ~new & (F.trim("line") != "")).alias("modified"), F.count_if(new).alias("untracked"))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def listing(files: DataFrame, most: int = 100) -> DataFrame:
    """Files per directory, names in braces; at most so many directories, by name."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    grouped = files.groupBy(directory(F.col("path")).alias("dir")).agg(F.array_sort(F.collect_list(name)).alias("names"))
    return grouped.select("dir", braced(F.col("names")).alias("files")).orderBy("dir").limit(most)


def structure(files: DataFrame) -> DataFrame:
    """Top-level directories with their files and test files."""
    top = F.when(F.contains("path", F.lit("/")), F.split("path", "/")[0]).otherwise(".")
    test = F.col("path").rlike(r"(^|/)tests?/|[._]test\.|(^|/)test_|\.spec\.")
    return files.groupBy(top.alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.count_if(test).alias("tests"))


def tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """All directories and files up to a depth: path, depth, is_dir; to be drawn in path order."""
    parts = F.split("path", "/")
    levels = files.select(F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))).alias("depth"), parts.alias("p"))
    return levels.select(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("path"), "depth", (F.col("depth") < F.size("p")).alias("is_dir")).distinct()


def todos(files: DataFrame, id_col: str = "path", text_col: str = "text", most: int | None = 20) -> DataFrame:
    """Lines with a TODO mark in a comment: id, line, text (from the mark on, without it)."""
    lines = files.where(F.col(text_col).rlike(TODO)).select(F.col(id_col), F.posexplode(effective_lines(F.col(text_col))).alias("_at", "_line"))
    found = lines.where(F.col("_line").rlike(TODO))
    text = F.regexp_replace(F.trim("_line"), TODO_START, "")
    out = found.select(id_col, (F.col("_at") + 1).cast("long").alias("line"), text.alias("text"))
    return out if most is None else out.orderBy(id_col, "line").limit(most)


def readme_head(files: DataFrame, id_col: str, text_col: str, most: int = 40) -> DataFrame:
    """Per text its head: lines before the second '## ' and at most so many; and the
    number of lines left out."""
    lines = effective_lines(F.col(text_col))
    marks = F.filter(F.transform("_lines", lambda x, i: F.when(F.startswith(x, F.lit("## ")), i)), lambda i: i.isNotNull())
    n = F.least(F.coalesce(F.get("_marks", F.lit(1)), F.size("_lines")), F.lit(most), F.size("_lines"))
    df = files.select(F.col(id_col), lines.alias("_lines")).withColumn("_marks", marks).withColumn("_n", n)
    return df.select(id_col, F.array_join(F.slice("_lines", F.lit(1), F.col("_n")), "\n").alias("head"), (F.size("_lines") - F.col("_n")).cast("long").alias("more"))


def import_targets(text: Column, lang: Column) -> Column:
    """Imports by regular expressions, one language's patterns per file: modules and
    crate paths (rust), relative modules (python), all paths (go), relative ones (others)."""
    every = lambda p, g=1, t=text: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    rust = F.concat(every(RUST_MODULE), F.transform(every(RUST_USE), lambda x: F.regexp_replace(x, ":+$", "")))
    go = F.concat(every(GO_QUOTED, 1, F.regexp_extract(text, GO_BLOCK, 1)), every(GO_SINGLE))
    code = F.regexp_replace(text, r"(?m)^\s*//.*$", "")
    js = F.concat(every(SCRIPT_IMPORT, 1, code), every(SCRIPT_REQUIRE, 1, code))
    chosen = (
        F.when(lang == "rust", rust).when(lang == "python", every(PYTHON_RELATIVE)).when(lang == "go", go)
        .otherwise(F.filter(js, lambda x: F.startswith(x, F.lit("."))))
    )
    return F.array_distinct(chosen)


def import_graph(files: DataFrame, most: int | None = 40) -> DataFrame:
    """path, imports of files (path, lang, text) that have any."""
    first = files if most is None else files.orderBy("path").limit(most)
    return first.select("path", import_targets(F.col("text"), F.col("lang")).alias("imports")).where(F.size("imports") > 0)


def symbol_map(definitions: DataFrame, most: int = 400) -> DataFrame:
    """An outline of the first definitions by file and line."""
    return definitions.orderBy("path", "start").limit(most)


def mise_tasks(text: Column) -> Column:
    header = F.regexp_extract_all(text, F.lit(MISE_HEADER), F.lit(1))
    name = lambda h: F.coalesce(
        F.nullif(F.regexp_extract(F.trim(h), "^[\"']([^\"']*)[\"']?", 1), F.lit("")), F.nullif(F.regexp_extract(F.trim(h), "^([^.\\s\"']+)", 1), F.lit("")),
    )
    return F.array_sort(F.array_distinct(F.filter(F.transform(header, name), lambda x: x.isNotNull())))


def just_tasks(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(JUST_RECIPE), F.lit(1))))


def make_tasks(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(MAKE_TARGET), F.lit(1))))


def gradle_tasks(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(GRADLE_TASK), F.lit(1))))


def npm_tasks(text: Column) -> Column:
    return F.array_sort(F.map_keys(F.from_json(F.get_json_object(text, "$.scripts"), "map<string,string>")))


def deno_tasks(text: Column) -> Column:
    from sievelight.functions.text import jsonc_stripped

    return F.array_sort(F.map_keys(F.from_json(F.get_json_object(jsonc_stripped(text), "$.tasks"), "map<string,string>")))


def tasks(files: DataFrame) -> DataFrame:
    """All tasks of runner files (path, text): runner, task."""
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    found = (
        F.when(name.isin("mise.toml", ".mise.toml"), F.struct(F.lit("mise").alias("runner"), mise_tasks(F.col("text")).alias("t")))
        .when(name.isin("justfile", ".justfile"), F.struct(F.lit("just").alias("runner"), just_tasks(F.col("text")).alias("t")))
        .when(name.isin("makefile", "gnumakefile"), F.struct(F.lit("make").alias("runner"), make_tasks(F.col("text")).alias("t")))
        .when(name.isin("deno.json", "deno.jsonc"), F.struct(F.lit("deno").alias("runner"), deno_tasks(F.col("text")).alias("t")))
        .when(name == "package.json", F.struct(F.lit("npm").alias("runner"), npm_tasks(F.col("text")).alias("t")))
    )
    return files.select(found.alias("f")).where("f is not null").select("f.runner", F.explode("f.t").alias("task")).distinct()


def signature(files: DataFrame) -> DataFrame:
    """A signature of a listing: the sum of modification times, the number of files, and a
    fingerprint: hashes of the rows added up, whatever their order, so that it is one partial sum a task."""
    row = F.sha2(F.concat_ws(":", "path", F.col("mtime").cast("string")), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("long"))
    mixed = F.sha2(F.concat_ws(":", *[F.coalesce(part(k), F.lit(0)).cast("string") for k in range(8)]), 256)
    return files.agg(F.sum("mtime").alias("mtime_sum"), F.count(F.lit(1)).alias("files"), mixed.alias("fingerprint"))


def rows_per(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """At most n rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c) for c in order]))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
