"""Source trees and single files as DataFrames."""

from __future__ import annotations

import fnmatch
import json
import re
import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest file, directories that are never entered, languages by extension.
MAX_BYTES = 1024 * 1024
EXCLUDED = ("target", "node_modules", ".git", "dist", "build", ".next", "vendor", ".cache", "__pycache__")
LANGUAGES = {
    "rs": "rust", "go": "go", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "kt": "kotlin", "scala": "scala", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "rb": "ruby", "php": "php",
    "swift": "swift", "sh": "shell", "bash": "shell",
    # Beyond the fixed list, so that the parsers' extensions all pass:
    "pyi": "python", "mts": "typescript", "cts": "typescript",
}
PARSED = ("rust", "python", "go", "typescript", "javascript")


def language(path: Column) -> Column:
    """The language of a file by its extension, in any case; null for other files."""
    table = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


class IgnoreRules:
    """The rules of ignore files: patterns by folder, the last one that matches decides."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []

    def add(self, folder: str, text: str) -> None:
        """Rules of the ignore file in folder ('' for the root)."""
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line.removeprefix("\\")
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            self.rules.append((folder, _pattern(line.lstrip("/"), anchored), negated, only_dirs))

    def ignored(self, path: str, is_dir: bool) -> bool:
        """Whether a path (relative, with /) or a folder above it is ignored."""
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            part, folder = "/".join(parts[:k]), k < len(parts) or is_dir
            verdict = False
            for base, pattern, negated, only_dirs in self.rules:
                inside = part[len(base) + 1 :] if base and part.startswith(base + "/") else (part if not base else None)
                if inside and (folder or not only_dirs) and pattern.fullmatch(inside):
                    verdict = not negated
            if verdict:
                return True
        return False


def _pattern(glob: str, anchored: bool) -> re.Pattern:
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("/**", k) and k + 3 == len(glob):
            out, k = out + "/.*", k + 3
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        elif glob[k] == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return re.compile(out if anchored else "(?:.*/)?" + out)


def read_tree(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """All files under a root of any store: path (relative), mtime, length, text if wanted.

    Size and name filters reach the scan; without text, contents aren't read.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).where(F.col("length") <= MAX_BYTES)
    absolute = spark._jvm.org.apache.hadoop.fs.Path(base)
    absolute = absolute.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(absolute).toString().rstrip("/")
    plain = re.sub("^file:/+", "/", absolute)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(plain) + "/", "")
    rows = files.select(path.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), "length", *(["content"] if content else []))
    if content:
        rows = rows.where(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("text", F.col("content").cast("string")).drop("content")
    return rows


def ignore_rules(spark: SparkSession, root: str) -> IgnoreRules:
    """The rules of all .gitignore and .ignore files under a root, outer folders first. Spark's
    readers pass hidden files over, so the store's listing is asked."""
    rules = IgnoreRules()
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return rules
    top, walk, found = fs.makeQualified(base).toUri().getPath().rstrip("/"), fs.listFiles(base, True), []
    while walk.hasNext():
        place = walk.next().getPath()
        if place.getName() in (".gitignore", ".ignore"):
            found.append((place.getParent().toUri().getPath()[len(top) + 1 :], place))
    for folder, place in sorted(found, key=lambda x: (x[0].count("/"), x[0])):
        stream = fs.open(place)
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()
        rules.add(folder, text)
    return rules


def source_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """The source files of a tree: path, mtime, length, lang (and text), as a code index takes them.

    Left out: hidden files and folders, the excluded folders, what .gitignore and
    .ignore files say, other extensions, files above 1 MiB and ones that aren't UTF-8.
    The ignore files' rules are few and are read by the driver.
    """
    rows = read_tree(spark, root, content).withColumn("lang", language(F.col("path"))).where("lang is not null")
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = rows.where(~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in EXCLUDED]))).where(~F.col("path").rlike(r"(^|/)\."))
    rules = ignore_rules(spark, root)
    if not rules.rules:
        return rows

    @F.pandas_udf("boolean")
    def kept(paths):  # noqa: ANN001, ANN202 - a pandas Series each way
        return paths.map(lambda p: not rules.ignored(p, False))

    return rows.where(kept(F.col("path")))


def listing(files: DataFrame) -> DataFrame:
    return files.select("path").orderBy("path")


def read_json(text: str) -> dict:
    """A JSON object, {} if it isn't one."""
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def command_output(spark: SparkSession, argv: list[str], cwd: str = ".") -> DataFrame:
    """A command's output lines: line, place; none if it fails."""
    try:
        done = subprocess.run(argv, cwd=cwd, capture_output=True, text=True, timeout=600)
        lines = done.stdout.split("\n") if done.returncode == 0 else []
    except OSError:
        lines = []
    rows = [(k, x) for k, x in enumerate(lines[: len(lines) - (lines[-1:] == [""])])]
    return spark.createDataFrame(rows, "place int, line string")


def globbed(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose path matches a pattern such as src/**/*.rs or .eslintrc*."""
    return files.where(F.col("path").rlike("^(?:" + _pattern(pattern, True).pattern + ")$"))


def host_predicates(files: DataFrame, root: str = ".", binaries: Callable[[str], bool] | None = None) -> dict[str, Callable[..., bool]]:
    """The functions of conditions: glob, contains, script, project-independent ones."""
    import shutil

    texts = lambda path: files.where(F.col("path") == path)
    return {
        "glob": lambda pattern: not globbed(files, pattern).isEmpty(),
        "contains": lambda path, needle: not texts(path).where(F.contains("text", F.lit(needle))).isEmpty(),
        "read": lambda path: next((r.text for r in texts(path).select("text").collect()), ""),
        "script": lambda name: name in read_json(next((r.text for r in texts("package.json").select("text").collect()), "")).get("scripts", {}),
        "bin": binaries or (lambda name: shutil.which(name) is not None),
        "repo_root": lambda: root,
    }


def matches(name: str, pattern: str) -> bool:
    return fnmatch.fnmatchcase(name, pattern)
