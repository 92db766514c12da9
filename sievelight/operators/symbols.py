"""Definitions, identifiers and imports of source files, and the symbol store.

Rust, Go, JavaScript and TypeScript go through one small lexer that knows comments,
strings, identifiers and brackets; Python through the standard library's parser, or
the same lexer if a file doesn't parse. Limits: macros and generated code aren't
expanded, and template or f-string parts count as strings.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.operators import relations

KINDS = ("function", "method", "struct", "enum", "trait", "class", "type", "impl")
DEFINITIONS = "path string, name string, kind string, start bigint, end bigint, signature string, lang string, parent string"
IDENTIFIERS = "path string, name string, line bigint, col bigint, text string"
IMPORTS = "path string, source string, target string"

_SLASHED = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
#: Comments and strings by language.
_NOISE = {
    "rust": (_SLASHED, r"b?r(?P<hash>#*)\".*?\"(?P=hash)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\\n])'(?!\w)"),
    "go": (_SLASHED, r"`[^`]*`|" + _QUOTED),
    "javascript": (_SLASHED, r"`(?:\\.|[^`\\])*`|" + _QUOTED),
    "typescript": (_SLASHED, r"`(?:\\.|[^`\\])*`|" + _QUOTED),
    "python": (r"\#[^\n]*", r"[rbfuRBFU]{0,2}(?:\"\"\".*?\"\"\"|\'\'\'.*?\'\'\'|" + _QUOTED + ")"),
}
TOKEN = {
    lang: re.compile(rf"(?P<comment>{c})|(?P<string>{q})|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<mark>::|=>|->|.)", re.S)
    for lang, (c, q) in _NOISE.items()
}
#: A regular expression literal, where a value may stand.
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Words that are no identifiers, by language.
KEYWORDS = {
    "rust": "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "javascript": "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null return static super switch this throw true try typeof var void while with yield async await",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}
KEYWORDS["typescript"] = KEYWORDS["javascript"]


class Token:
    __slots__ = ("kind", "text", "at", "line")

    def __init__(self, kind: str, text: str, at: int, line: int) -> None:
        self.kind, self.text, self.at, self.line = kind, text, at, line


def lex(text: str, lang: str) -> list[Token]:
    """Tokens but for white space, comments included."""
    out, line, at = [], 1, 0
    script = lang in ("javascript", "typescript")
    value = True  # whether a value may stand here, so that / begins a regular expression
    while at < len(text):
        m = TOKEN[lang].match(text, at)
        kind, found = m.lastgroup, m[0]
        if script and value and found == "/" and (r := _REGEX.match(text, at)):
            kind, found = "string", r[0]
        if kind != "space":
            out.append(Token(kind, found, at, line))
            if kind != "comment":
                value = found in ("return", "typeof", "case", "in", "of", "=>") or kind == "mark" and found not in (")", "]", "}")
        line += found.count("\n")
        at += len(found)
    return out


def identifiers(text: str, lang: str) -> Iterator[tuple[str, int, int, str]]:
    """(name, line from 1, column in bytes from 0, the line's text) outside comments and strings."""
    lines = text.split("\n")
    for t in lex(text, lang):
        if t.kind == "word" and t.text not in KEYWORDS[lang]:
            begin = text.rfind("\n", 0, t.at) + 1
            yield t.text, t.line, len(text[begin : t.at].encode()), lines[t.line - 1].strip()


def _closing(tokens: list[Token], k: int) -> int:
    """The index of the bracket that closes the one at k (the last token if none does)."""
    pairs = {"{": "}", "(": ")", "[": "]"}
    depth, opened = 0, tokens[k].text
    for j in range(k, len(tokens)):
        if tokens[j].kind == "mark":
            depth += (tokens[j].text == opened) - (tokens[j].text == pairs[opened])
            if not depth:
                return j
    return len(tokens) - 1


def _body(tokens: list[Token], k: int) -> tuple[int, int]:
    """From a declaration's tokens at k: (index of its body's brace or -1, index of its last token)."""
    while k < len(tokens):
        t = tokens[k].text if tokens[k].kind == "mark" else ""
        if t == "{":
            return k, _closing(tokens, k)
        if t == ";":
            return -1, k
        k = _closing(tokens, k) if t in ("(", "[") else k
        k += 1
    return -1, len(tokens) - 1


def _clean(code: str) -> str | None:
    return code.strip() or None


def braces_definitions(text: str, lang: str) -> Iterator[tuple[str, str, int, int, str | None, str | None]]:
    """(name, kind, start, end, signature, parent) of a language with braces, outer ones first."""
    tokens = [t for t in lex(text, lang) if t.kind != "comment"]
    scopes: list[tuple[int, str]] = []  # (last token, container's name)
    for k, t in enumerate(tokens):
        while scopes and k > scopes[-1][0]:
            scopes.pop()
        if t.kind != "word":
            continue
        parent = scopes[-1][1] if scopes else None
        follows = lambda n=1, k=k: tokens[k + n] if k + n < len(tokens) else Token("", "", 0, 0)
        first, name, kind, container = k, None, None, False
        if lang == "rust" and t.text in ("fn", "struct", "enum", "trait") and follows().kind == "word":
            name, kind = follows().text, {"fn": "method" if parent else "function"}.get(t.text, t.text)
            container = t.text in ("trait",)
        elif lang == "rust" and t.text == "impl" and (k == 0 or tokens[k - 1].text in (";", "}", "]", "unsafe", "{")):
            body, _ = _body(tokens, k)
            head = [x for x in tokens[k + 1 : body if body > 0 else k + 1]]
            if head and head[0].text == "<":
                head = _after_angles(head)
            cut = next((j for j, x in enumerate(head) if x.text == "for"), -1)
            stop = next((j for j, x in enumerate(head) if x.text == "where"), len(head))
            words = [x.text for x in _before_angles(head[cut + 1 : stop]) if x.kind == "word"]
            name, kind, container = (words[-1] if words else None), "impl", True
        elif lang == "go" and t.text == "func":
            if follows().text == "(":
                at = _closing(tokens, k + 1) + 1
                name, kind = (tokens[at].text, "method") if at < len(tokens) and tokens[at].kind == "word" else (None, None)
            elif follows().kind == "word":
                name, kind = follows().text, "function"
        elif lang == "go" and t.text == "type" and follows().kind == "word":
            name, kind = follows().text, "struct" if follows(2).text == "struct" else "type"
        elif lang in ("javascript", "typescript") and t.text == "function":
            at = 2 if follows().text == "*" else 1
            name, kind = (follows(at).text, "function") if follows(at).kind == "word" else (None, None)
        elif lang in ("javascript", "typescript") and t.text == "class" and follows().kind == "word" and follows().text != "extends":
            name, kind, container = follows().text, "class", True
        elif lang in ("javascript", "typescript") and parent and follows().text == "(" and _direct(tokens, k, scopes):
            close = _closing(tokens, k + 1)
            body, _ = _body(tokens, close + 1)
            between = tokens[close + 1 : body] if body > 0 else [Token("", "", 0, 0)] * 99
            if body > 0 and (not between or between[0].text == ":") and t.text not in ("if", "for", "while", "switch", "catch"):
                name, kind = t.text, "method"
        if not name:
            continue
        body, last = _body(tokens, k + 1)
        if lang == "go" and kind == "type" and follows(2).text != "interface":
            body, last = -1, max(j for j in range(k, len(tokens)) if tokens[j].line == t.line)
        while first and tokens[first - 1].kind == "word" and tokens[first - 1].text in ("pub", "async", "unsafe", "const", "extern", "export", "default", "static") and tokens[first - 1].line == tokens[first].line:
            first -= 1
        signature = None
        if kind in ("function", "method"):
            signature = _clean(text[tokens[first].at : tokens[body].at]) if body > 0 else _clean(text[tokens[first].at : tokens[last].at + 1].split("\n")[0])
        end = tokens[last].line + tokens[last].text.count("\n")
        yield name, kind, tokens[first].line, end, signature, parent
        if container and body > 0:
            scopes.append((last, name))


def _direct(tokens: list[Token], k: int, scopes: list[tuple[int, str]]) -> bool:
    """Whether a token stands directly in the innermost container, not in a bracket of it."""
    depth = 0
    for j in range(k - 1, -1, -1):
        x = tokens[j].text if tokens[j].kind == "mark" else ""
        depth += (x in ")}]") - (x in "({[") if x else 0
        if depth < 0:
            return x == "{" and _closing(tokens, j) == scopes[-1][0]
    return False


def _after_angles(head: list[Token]) -> list[Token]:
    depth = 0
    for j, x in enumerate(head):
        depth += (x.text == "<") - (x.text == ">")
        if not depth:
            return head[j + 1 :]
    return head


def _before_angles(head: list[Token]) -> list[Token]:
    return head[: next((j for j, x in enumerate(head) if x.text == "<"), len(head))]


def python_definitions(text: str) -> Iterator[tuple[str, str, int, int, str | None, str | None]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        yield from _python_lines(text)
        return
    lines = text.split("\n")

    def walk(node: ast.AST, parent: str | None) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                head = lines[child.lineno - 1 : child.body[0].lineno] if child.body[0].lineno > child.lineno else [lines[child.lineno - 1]]
                head = "\n".join(head)[child.col_offset :]
                close = re.match(r"(?s)(?:async\s+)?def\s+\w+.*?\)\s*(?:->[^:]*)?:", head)
                yield child.name, "method" if parent else "function", child.lineno, child.end_lineno, _clean(close[0] if close else head.split("\n")[0]), parent
                yield from walk(child, parent)
            elif isinstance(child, ast.ClassDef):
                yield child.name, "class", child.lineno, child.end_lineno, None, parent
                yield from walk(child, child.name)
            else:
                yield from walk(child, parent)

    yield from walk(tree, None)


def _python_lines(text: str) -> Iterator[tuple[str, str, int, int, str | None, str | None]]:
    """Definitions of a file that doesn't parse, by indentation."""
    lines = text.split("\n")
    scopes: list[tuple[int, str, bool]] = []
    for k, line in enumerate(lines):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line)
        if not m:
            continue
        indent = len(m[1])
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        end = k + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > indent):
            end += 1
        while end > k + 1 and not lines[end - 1].strip():
            end -= 1
        parent = next((n for _, n, c in reversed(scopes) if c), None)
        kind = "class" if m[2] == "class" else "method" if parent else "function"
        yield m[3], kind, k + 1, end, None if kind == "class" else _clean(line), parent
        scopes.append((indent, m[3], m[2] == "class"))


def definitions_of(text: str, lang: str) -> list[tuple]:
    return list(python_definitions(text) if lang == "python" else braces_definitions(text, lang))


def rust_uses(text: str) -> Iterator[str]:
    """Targets of use declarations at the root: groups spread, aliases under their original
    name, p::* for wildcards, self as the path itself."""
    tokens = [t for t in lex(text, "rust") if t.kind in ("word", "mark")]
    depth, k = 0, 0
    while k < len(tokens):
        t = tokens[k]
        depth += (t.text == "{") - (t.text == "}")
        if t.text == "use" and t.kind == "word" and depth == 0:
            end = next((j for j in range(k, len(tokens)) if tokens[j].text == ";"), len(tokens))
            yield from _spread("".join(" as " if x.text == "as" and x.kind == "word" else x.text for x in tokens[k + 1 : end]), "")
            k = end
        k += 1


def _spread(part: str, prefix: str) -> Iterator[str]:
    part = part.strip()
    if part.endswith("}") and "{" in part:
        head, inner = part[:-1].split("{", 1)
        depth, piece = 0, ""
        for c in inner + ",":
            if c == "," and not depth:
                if piece.strip():
                    yield from _spread(piece, prefix + head)
                piece = ""
            else:
                depth += (c == "{") - (c == "}")
                piece += c
        return
    path = part.split(" as ")[0].strip()
    if path == "self":
        yield prefix.removesuffix("::")
    elif path:
        yield prefix + path


def python_imports(text: str) -> Iterator[str]:
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        for m in re.finditer(r"(?m)^(?:import\s+([\w.]+)|from\s+(\.*[\w.]*)\s+import\s+([\w, *]+))", text):
            yield from [m[1]] if m[1] else [_member(m[2], x.split()[0]) for x in m[3].split(",") if x.split()]
        return
    for node in body:
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from (_member("." * node.level + (node.module or ""), a.name) for a in node.names)


def _member(module: str, name: str) -> str:
    return f"{module}{'' if module.endswith('.') or not module else '.'}{name}"


def quoted_imports(text: str, lang: str, all_exports: bool = False) -> Iterator[str]:
    """String literals of import (and export ... from) statements at the root. all_exports: of
    every export statement, whether it has a from or not."""
    tokens = [t for t in lex(text, lang) if t.kind != "comment"]
    depth, k = 0, 0
    while k < len(tokens):
        t = tokens[k]
        if t.kind == "word" and depth == 0 and t.text in ("import", "export") and (lang != "go" or t.text == "import"):
            body = tokens[k + 1 : k + 2] and tokens[k + 1].text
            end = _closing(tokens, k + 1) if lang == "go" and body == "(" else k
            if end == k:
                end = next((j for j in range(k + 1, len(tokens)) if tokens[j].kind == "string" or tokens[j].text == ";"), k)
                end = end if t.text == "import" or all_exports or any(x.text == "from" for x in tokens[k:end]) else k
            yield from (re.sub("^[\"'`]|[\"'`]$", "", x.text) for x in tokens[k : end + 1] if x.kind == "string")
            k = end
        elif t.kind == "mark":
            depth += (t.text in "({[") - (t.text in ")}]") if len(t.text) == 1 else 0
        k += 1


def imports_of(text: str, lang: str) -> list[str]:
    if lang == "rust":
        return list(rust_uses(text))
    return list(python_imports(text) if lang == "python" else quoted_imports(text, lang))


def _over(files: DataFrame, schema: str, rows) -> DataFrame:  # noqa: ANN001 - (path, text, lang) -> rows
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [r for path, text, lang in zip(f["path"], f["text"], f["lang"], strict=True) for r in rows(path, text or "", lang)]
            yield pd.DataFrame(out, columns=names)

    known = files.where(F.col("lang").isin(*TOKEN)).select("path", "text", "lang")
    return known.mapInPandas(run, schema)


def definitions(files: DataFrame) -> DataFrame:
    """All definitions of files (path, text, lang)."""
    return _over(files, DEFINITIONS, lambda p, t, lang: [(p, n, k, a, b, s, lang, up) for n, k, a, b, s, up in definitions_of(t, lang)])


def identifier_table(files: DataFrame) -> DataFrame:
    """All identifiers outside comments and strings; a reference lookup is a filter on name."""
    return _over(files, IDENTIFIERS, lambda p, t, lang: [(p, *r) for r in identifiers(t, lang)])


def import_table(files: DataFrame) -> DataFrame:
    return _over(files, IMPORTS, lambda p, t, lang: [(p, p, x) for x in imports_of(t, lang)])


def outlined(found: DataFrame, most: int = 400) -> DataFrame:
    """An outline of definitions (path, name, kind, start, end, parent, signature): path, start,
    place in the file (from 1), depth and head. A definition stands below its parent's first type
    or impl in the file that holds it, or, outside of all (a method of a type declared
    elsewhere), below the type itself; others stand at depth 0 in order of their lines."""
    head = F.coalesce("signature", F.concat_ws(" ", "kind", "name"))
    own = found.select("path", "name", "start", "end", "parent", head.alias("head"))
    held = own.where("parent is not null")
    outer = found.where(F.col("kind") != "method").select("path", F.col("name").alias("parent"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    within = (F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end"))
    above = held.join(outer, ["path", "parent"]).groupBy("path", "name", "start").agg(
        F.max(F.when(within, F.col("o_start"))).alias("in_start"), F.min("o_start").alias("of_start")
    ).select("path", "name", "start", F.coalesce("in_start", "of_start").alias("above"))
    rows = own.join(above, ["path", "name", "start"], "left").withColumn("depth", F.col("above").isNotNull().cast("int"))
    order = Window.partitionBy("path").orderBy(F.coalesce("above", "start"), "depth", "start", "name")
    return rows.select("path", "start", F.row_number().over(order).alias("place"), "depth", "head").orderBy("path", "place").limit(most)


class SymbolStore:
    """Definitions, imports and identifiers of a tree, as Parquet tables in a folder."""

    TABLES = ("definitions", "imports", "identifiers")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, files: DataFrame) -> dict:
        """Replace all tables; identifiers are laid out by name."""
        definitions(files).write.mode("overwrite").parquet(f"{self.path}/definitions")
        import_table(files).write.mode("overwrite").parquet(f"{self.path}/imports")
        identifier_table(files).repartitionByRange("name").sortWithinPartitions("name", "path", "line").write.mode("overwrite").parquet(f"{self.path}/identifiers")
        files.select("path", "mtime").write.mode("overwrite").parquet(f"{self.path}/tracked")
        return {"files": files.count(), "symbols": self.table("definitions").count()}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def stale(self, files: DataFrame) -> bool:
        from sievelight.operators.snapshot import diff

        try:
            return not diff(files.select("path", "mtime"), self.table("tracked")).isEmpty()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return True
            raise

    def defs(self, name: str) -> DataFrame:
        return self.table("definitions").where(F.col("name") == name).orderBy("path", "start")

    def members(self, parent: str) -> DataFrame:
        return self.table("definitions").where(F.col("parent") == parent).orderBy("path", "start")

    def importers(self, name: str, boundary: bool = False) -> DataFrame:
        return relations.importers(self.table("imports"), name, boundary).orderBy("source")

    def references(self, name: str) -> DataFrame:
        """Uses of a name, without its definitions' own lines."""
        uses = self.table("identifiers").where(F.col("name") == name.strip())
        return relations.references_only(uses, self.defs(name).select("path", F.col("start").alias("line"))).orderBy("path", "line", "col")

    def refs(self, name: str) -> dict[str, DataFrame]:
        """All about one name: its types, impls, methods (each under the impl that holds it), references, importers."""
        found, members = self.defs(name), self.members(name)
        impls = found.where("kind = 'impl'")
        blocks = impls.select("path", F.col("start").alias("outer_id"), "start", "end")
        methods = members.withColumn("line", F.col("start")).withColumn("id", F.concat_ws(":", "name", "start")).drop("start", "end")
        return {
            "definitions": found.where("kind != 'impl'"), "impls": impls, "methods": relations.nested(methods, blocks, "id"),
            "orphans": relations.orphans(methods, blocks, "id"), "references": self.references(name), "importers": self.importers(name),
        }

    def groups(self) -> DataFrame:
        return relations.groups(self.table("definitions")).orderBy("name")

    def outline(self, most: int = 400) -> DataFrame:
        """Declaration heads by file, methods under their types."""
        return outlined(self.table("definitions"), most)
