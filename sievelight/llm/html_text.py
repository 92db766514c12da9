"""HTML main text by a maximum-scoring subsequence of tokens.

Words score positive and tags negative; words in links and in page furniture
(menus, footers, adverts, forms, comments ...) score negative too. The weights
are log-odds of lying in the marked region of labelled pages. A linear scan
finds the contiguous token region of greatest score: the blocks with a word in
it are the main text, less the furniture that stands among them.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.bytesops import frugal
from sievelight.llm.common import ship, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<title\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</title\s*>|(?=</head\b|<body\b)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>(?:[^<]|<(?![a-z!?/]))+)"
    r"|<",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Nouns of class, id or role that name furniture. A name's noun is its last part but for
#: those of PLACES; names that begin with a word of OTHERS tell of what is beside an element.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies"
    " discussion footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply search share sharing"
    " sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
PLACES = frozenset("area bar block bottom box center container group inner item items left link links list outer panel right row section slot top unit wrap wrapper".split())
OTHERS = frozenset("with without has no not after before".split())
ARTICLE = frozenset("article content entry main post story".split())
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu".split())
CONTAINERS = frozenset("html body main article section div td table tbody tr ul ol dl blockquote figure header center details".split()) | FURNITURE_TAGS
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr figcaption address caption thead tfoot fieldset legend summary".split())
#: Elements without main text whose tags and words don't count, and what an svg holds as a page of its own.
SILENT = frozenset("head select button svg".split())
NESTED = SILENT | {"foreignobject"}
#: What a head holds besides raw elements and a title: anything else ends it.
HEAD = frozenset("head base basefont bgsound link meta noframes".split())
#: Elements that hold running text: reaching one ends a paragraph, not the region.
#: What an opening tag ends if it is open in the same table or list.
ENDS = {
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "tr": frozenset(("td", "th", "tr")), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tbody": frozenset(("td", "th", "tr", "tbody", "thead")), "tfoot": frozenset(("td", "th", "tr", "tbody", "thead")),
}
SCOPES = frozenset("table ul ol dl body html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Labelled pages: the main text lies between the marks. They show one layout each.
LABELLED = (
    "<body><header><a href='/'>Paper</a></header><nav><ul><li><a href='/a'>World</a></li><li><a href='/b'>Sport</a></li></ul></nav><!--begin--><article><h1>River rises again</h1>"
    "<p>The river rose by two metres in the night and flooded the lower town.</p><p>Nobody was hurt, the mayor said on Monday.</p></article><!--end--><footer>Contact us today</footer></body>",
    "<body><div class='menu'><a href='/'>Home</a> <a href='/x'>About</a></div><div id='content'><!--begin--><h2>Bread at home</h2><p>Mix flour, water and salt. Let the dough rest for a day.</p>"
    "<ul><li>Heat the oven well before</li><li>Bake for forty minutes</li></ul><p>Let it cool on a rack.</p><!--end--></div><div class='sidebar'><a href='/1'>Soup</a><a href='/2'>Cake</a></div></body>",
    "<body><div class='ad'>Buy now and save</div><main><!--begin--><h1>Notes on soil</h1><p>Sandy soil drains fast and warms up early in the year.</p><p>Clay holds water <a href='/c'>for weeks</a> "
    "and cracks when dry.</p><blockquote>Feed the soil, not the plant.</blockquote><!--end--></main><div class='comments'><p>Nice post!</p><p>Thanks a lot</p></div><form><input> Subscribe here</form></body>",
    "<body><table><tr><td class='nav'><a href='/'>Start</a><br><a href='/n'>News</a></td><td><!--begin--><p>The old bridge will close for repairs in the spring, the council decided.</p><p>Cars must take "
    "the northern road until autumn.</p><!--end--></td></tr></table><div class='footer'><a href='/i'>Imprint</a> All prices in euro</div></body>",
)


class Page:
    """A page's tokens: kind ('word', 'link', 'off' or a tag's name), container, text and the region's marks."""

    def __init__(self, source: str) -> None:
        self.kinds: list[str] = []
        self.where: list[int] = []
        self.parent, self.off, self.silent, self.article = [-1], [False], [False], [False]
        self.spans: list[tuple[int, str, str]] = []  # (container, what, text): what is 'text' or 'block'
        self.span_of: list[int] = []
        self.marks: list[int] = []
        names, top, links = ["#"], 0, 0
        loose: set[int] = set()  # elements that the next block ends: silent ones that are never closed, paragraphs and running text
        for m in TOKEN.finditer(source):
            if m["text"]:
                if names[top] == "head" and m["text"].strip():
                    top = self.parent[top]
                self.spans.append((top, "text", m["text"]))
                self.span_of.append(len(self.kinds))
                kind = "off" if self.off[top] else "link" if links else "word"
                for _ in range(0 if self.silent[top] else len(html.unescape(m["text"]).split())):
                    self._add(kind, top)
            elif m["name"]:
                name, closing = m["name"].lower(), bool(m["close"])
                if names[top] == "head" and not closing and name not in HEAD:
                    top = self.parent[top]
                while top in loose and name in BLOCKS:
                    top = self.parent[top]
                if name in ENDS and not closing:
                    k = top
                    while k > 0 and names[k] not in SCOPES:
                        if names[k] in ENDS[name]:
                            top = self.parent[k]
                        k = self.parent[k]
                if name == "a":
                    links = 0 if closing else 1
                if name in BLOCKS:
                    links = 0
                    self._gap(top, "block")
                elif name in ("br", "td", "th", "img"):
                    self._gap(top, "text")
                if closing:
                    k = top
                    while k > 0 and names[k] != name:
                        k = self.parent[k]
                    if k > 0:
                        top = self.parent[k]
                elif name not in VOID and not m["rest"].rstrip().endswith("/"):
                    off = name in SILENT or furniture(name, m["rest"]) or (name == "header" and not self._in_article(names, top))
                    if off or name in CONTAINERS or name in NESTED or names[top] == name:
                        names.append(name)
                        self.parent.append(top)
                        self.off.append(self.off[top] or off)
                        self.silent.append(self.silent[top] or name in SILENT)
                        self.article.append(name in ("article", "main") or named(m["rest"], ARTICLE))
                        top = len(names) - 1
                        if name in SILENT and name != "head" and not _closed(source, m.end(), name) or name not in BLOCKS and name not in NESTED or name == "p":
                            loose.add(top)
                if (not closing or name in CONTAINERS) and name not in NESTED and not self.silent[top]:
                    self._add("<" + name, top)
            elif m[0] in ("<!--begin-->", "<!--end-->"):
                self.marks.append(len(self.kinds))
        self.names = names

    def _add(self, kind: str, where: int) -> None:
        self.kinds.append(kind)
        self.where.append(where)

    def _gap(self, where: int, what: str) -> None:
        self.spans.append((where, what, " "))
        self.span_of.append(len(self.kinds))

    def _in_article(self, names: list[str], k: int) -> bool:
        """Whether an element is in an article: its header is a part of it, another one a site's."""
        while k > 0:
            if self.article[k] or names[k] in ("section", "blockquote", "figure"):
                return True
            k = self.parent[k]
        return False


def _closed(source: str, at: int, name: str) -> bool:
    """Whether the next tag of that name closes it; an svg may hold others."""
    tags = re.compile(rf"<(/?){name}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I)
    depth = 1
    for m in tags.finditer(source, at):
        if m[1]:
            depth -= 1
        elif name != "svg":
            return False
        elif not m[0][:-1].rstrip().endswith("/"):
            depth += 1
        if not depth:
            return True
    return False


def named(attributes: str, nouns: frozenset[str]) -> bool:
    """Whether class, id or role has a name whose noun is one of nouns."""
    for value in ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x]
            while len(parts) > 1 and parts[-1] in PLACES:
                parts.pop()
            if parts and parts[-1] in nouns and (len(parts) == 1 or parts[0] not in OTHERS):
                return True
    return False


def furniture(name: str, attributes: str) -> bool:
    if name in FURNITURE_TAGS:
        return True
    if not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    return name not in ("body", "html", "main", "article") and named(attributes, FURNITURE)


@lru_cache(1)
def weights(pages: tuple[str, ...] = LABELLED) -> dict[str, float]:
    """Log-odds of each token kind to lie in the marked region, against all tokens; a
    plain word's is positive at least, any other's negative at most."""
    inside, outside = Counter(), Counter()
    for source in pages:
        page = Page(source)
        a, b = page.marks
        inside.update(page.kinds[a:b])
        outside.update(page.kinds[:a] + page.kinds[b:])
    odds = {k: math.log((inside[k] + 0.5) / (outside[k] + 0.5)) for k in {*inside, *outside}}
    return {k: max(0.1, x) if k == "word" else min(-0.1, x) for k, x in odds.items()}


def best_region(page: Page, weight: dict[str, float]) -> tuple[int, int] | None:
    """The token range of greatest score, the first one of equal ones; None if no word scores."""
    best, found, total, start = 0.0, None, 0.0, 0
    for k, kind in enumerate(page.kinds):
        if total <= 0:
            total, start = 0.0, k
        total += weight.get(kind, -0.5)
        if total > best:
            best, found = total, (start, k + 1)
    return found


def main_text(source: str | None) -> str:
    """The blocks of the main text, joined by line feeds.

    A "<" before a letter begins a tag, as in a browser: of "a<b then c>d" a and d are left.
    A tag with a quote that nothing closes ends at the next ">".
    """
    page = Page(source or "")
    region = best_region(page, weights())
    if not region:
        return ""
    first, stop = region
    blocks, own, inside = [], [], False
    ends = [*page.span_of[1:], len(page.kinds)]
    for (where, what, text), begin, end in zip([*page.spans, (0, "block", "")], [*page.span_of, len(page.kinds)], [*ends, len(page.kinds)], strict=True):
        if what == "block":
            if inside and own and (line := " ".join(html.unescape("".join(own)).split())):
                blocks.append(line)
            own, inside = [], False
        elif not page.off[where]:
            own.append(text)
            # A block with a word in the region is in it as a whole.
            inside = inside or any(k[0] != "<" for k in page.kinds[max(begin, first) : min(end, stop)])
    return "\n".join(blocks)


@frugal
def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("text")]
        out = {x: batch.column(x) for x in batch.schema.names}
        out |= {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        yield pa.RecordBatch.from_pydict(out)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (its code points).

    A null or empty page and one without a plain word give an empty text.
    Repeated rows each give a row; columns named text or n_chars are replaced;
    an empty table gives an empty result.
    """
    ship(pages.sparkSession)
    others = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    df = pages.select(*others, F.col(html_col).cast("string").alias("text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(_extracted, ", ".join([*schema, "n_chars bigint"]))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLE_SQL: dict[str, str] = {}
