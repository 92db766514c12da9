"""String functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_MARK = "…"


def runs(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits; every other character splits."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+"), "")


def subwords(word: Column) -> Column:
    """Parts of an identifier: at lower-Upper, before the last capital of an acronym
    that a word follows, and between letters and digits."""
    for pattern in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        word = F.regexp_replace(word, pattern, "$1 $2")
    return F.split(word, " ")


#: Where subwords() cuts; most words hold no such place and are left alone.
_CUT = "[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]"


def expand(text: Column) -> Column:
    """Of each run: itself, its lower case if that differs, its sub-words in lower case if several."""
    none = F.array().cast("array<string>")

    def of(word: Column) -> Column:
        parts = subwords(word)
        return F.concat(
            F.array(word),
            F.when(F.lower(word) != word, F.array(F.lower(word))).otherwise(none),
            F.when(word.rlike(_CUT), F.transform(parts, F.lower)).otherwise(none),
        )

    return F.flatten(F.transform(runs(text), of))


def made_once(value: Column) -> Column:
    """value as a generated column: what refers to it reads it, and no filter or projection
    below makes it again. To be selected as it is; every row stays."""
    return F.explode(F.array(value))


def index_tokens(text: Column) -> Column:
    """The tokens an index holds, in lower case; a mixed-case word counts twice.

    Only texts with a word that is cut need expand(); in all others every word with a
    capital is doubled in the text, which is then split as a whole. (Two characters
    outside ASCII turn into letters of it in lower case; texts with them are expanded.)
    """
    text = F.coalesce(text, F.lit(""))
    doubled = F.regexp_replace(text, "(?<![A-Za-z0-9])([a-z0-9]*+[A-Z][A-Za-z0-9]*+)", "$1 $1")
    whole = F.array_remove(F.split(F.lower(doubled), "[^a-z0-9]+"), "")
    return F.when(text.rlike(_CUT + "|[\u212A\u0130]"), F.transform(expand(text), F.lower)).otherwise(whole)


def query_terms(query: Column) -> Column:
    """Terms for marking matches: split at white space, A-Z in lower case."""
    lowered = F.translate(query, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"\s+"), lambda t: t != "")


def line_matches(line: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(F.lower(line), t))


def half(text: Column) -> Column:
    """The first half of a text, by characters."""
    return F.left(text, (F.char_length(text) / 2).cast("int"))


def like_escaped(text: Column) -> Column:
    r"""\, % and _ with a backslash before them."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def redacted_url(url: Column) -> Column:
    """Without what stands between scheme:// and the first @."""
    return F.regexp_replace(url, "^(.*?://)[^@]*@", "$1")


def local_url(url: Column) -> Column:
    """:port/path as http://localhost:port/path, others as they are."""
    return F.when(F.startswith(url, F.lit(":")), F.concat(F.lit("http://localhost"), url)).otherwise(url)


def braced(names: Column) -> Column:
    """{a,b}.ext if all file names share an extension, else {a.x,b.y}; one name stays as it is."""
    ext = F.transform(names, lambda n: F.regexp_extract(n, r"\.([^.]+)$", 1))
    stem = F.transform(names, lambda n: F.regexp_replace(n, r"\.[^.]+$", ""))
    same = (F.size(F.array_distinct(ext)) == 1) & (ext[0] != "")
    return (
        F.when(F.size(names) == 1, names[0])
        .when(same, F.concat(F.lit("{"), F.array_join(stem, ","), F.lit("}."), ext[0]))
        .otherwise(F.concat(F.lit("{"), F.array_join(names, ","), F.lit("}")))
    )


def unquoted(literal: Column) -> Column:
    """A string literal without its prefix letters and quotes."""
    return F.regexp_replace(F.regexp_replace(literal, r"^[rbfRBF]{0,2}(?=[\"'`])", ""), "^[\"'`]+|[\"'`]+$", "")


def jsonc_stripped(text: Column) -> Column:
    """JSON without // and /* */ comments (strings that hold // after a colon, as URLs, stay)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:\"])//.*$", "$1")


def task_name(path: Column) -> Column:
    """The name of a file task: a/_default is a, a/b.sh is a:b."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/_default(\.[^/]*)?$", ""), r"\.[^./]+$", ""), "/", ":")


def argv(command: Column, manager: Column) -> Column:
    """A command's words, {pm} replaced by the package manager."""
    return F.filter(F.split(F.replace(command, F.lit("{pm}"), manager), r"\s+"), lambda w: w != "")


def duration(ms: Column) -> Column:
    """Nms, or N.Ns from ten seconds on."""
    return F.when(ms >= 10_000, F.format_string("%.1fs", ms / 1000.0)).otherwise(F.format_string("%dms", ms.cast("long")))


def iso_time(seconds: Column) -> Column:
    """UNIX seconds as an ISO time in UTC (the session's zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def truncated(text: Column, most: int = 8192) -> Column:
    """At most most bytes of UTF-8, cut before a character that would pass them, with a mark if something is cut."""
    # Of the longest prefix a character's later bytes (10xxxxxx) may hang over: drop up to three and the lead of a part.
    octets = F.substring(text.cast("binary"), 1, most + 1)
    back = lambda k: F.hex(F.substring(octets, most + 1 - k, 1)).rlike("^[89AB]")
    keep = F.when(~back(0), most).when(~back(1), most - 1).when(~back(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) > most, F.concat(F.decode(F.substring(octets, F.lit(1), keep), "UTF-8"), F.lit("\n[truncated]"))).otherwise(text)


def fnv1a64(text: Column) -> Column:
    """FNV-1a, 64 bits, of a text's UTF-8 bytes as 16 hexadecimal digits.

    The state is kept as two unsigned halves of 32 bits, so that no product
    overflows: with prime 2**40 + 435, h * prime mod 2**64 is, in halves,
    (hi * 435 + lo * 2**8 + carry, lo * 435).
    """
    mask = F.lit(0xFFFFFFFF)
    octets = F.filter(F.split(F.regexp_replace(F.hex(text.cast("binary")), "(..)", "$1 "), " "), lambda x: x != "")

    def step(h: Column, octet: Column) -> Column:
        lo = h["lo"].bitwiseXOR(F.conv(octet, 16, 10).cast("long"))
        product = lo * 435
        hi = h["hi"] * 435 + F.shiftleft(lo, 8) + F.shiftright(product, 32)
        return F.struct(hi.bitwiseAND(mask).alias("hi"), product.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(octets, start, step, lambda h: F.concat(digits(h["hi"]), digits(h["lo"])))


def redacted_query(query: Column) -> Column:
    return F.concat(F.lit("h"), fnv1a64(query))
