"""The ten operators against brute force, on small fixtures and on the smallest tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight.llm import (
    bytesops,
    chat_format,
    decontaminate,
    exact_dedup,
    fm_index,
    html_text,
    language_id,
    license_scan,
    mixing,
    near_dedup,
    registry,
    shingles,
    suffix_dedup,
    toxicity,
)
from sievelight.llm.common import only
from sievelight.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n string"
BASE = " ".join(f"word{k} text{k % 7}" for k in range(60))
ROWS = [
    (1, BASE, "en", "a", 1, 0.5, True, "x"),
    (2, BASE.replace("word30", "other"), "en", "a", 1, None, None, None),
    (3, "  " + BASE + "\n", "en", None, 1, None, None, None),
    (4, None, None, None, None, None, None, None),
    (5, "", "", "b", 0, None, None, None),
    (6, " \t\n", "en", "b", 3, None, None, None),
    (7, "one two", "en", "b", 7, None, None, None),
    (8, "One  two", "en", "b", 8, None, None, None),
    (9, "Grüße aus Köln 😀 " * 40, "de", "b", 1, None, None, None),
    (9, "Grüße aus Köln 😀 " * 40, "de", "b", 1, None, None, None),
    (None, "no id here at all " * 30, "en", "c", 1, None, None, None),
    (10, "x" * 300 + " " + "ab" * 200, "en", "c", 1, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_words_and_hashes():
    texts = ["a b  c", "", "dd\tee", "Ünï cödé"]
    data, offsets = bytesops.utf8(pa.array([*texts, None]))
    start, end, first = bytesops.words(data, offsets, bytesops.IS_SPACE)
    found = [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]
    assert found == ["a", "b", "c", "dd", "ee", "Ünï", "cödé"] and first.tolist() == [0, 3, 3, 5, 7, 7]
    h = bytesops.word_hashes(np.frombuffer(b"abc abc abd", np.uint8), np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[1] != h[2]


def test_shingle_sets():
    sets = list(shingles.shingle_sets(pa.array(["a b c d e f", "A b C d e", "a b", None, " ", "a b c d e f a b c d e f"])))
    assert [len(s) for s in sets] == [2, 1, 1, 0, 0, 6] and sets[1][0] in sets[0]


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components(spark, few):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (7, 7), (2, 5), (20, 9), (None, 3)] + [(100 + k, 101 + k) for k in range(30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), few).collect()}
    assert {got[k] for k in (2, 3, 4, 5)} == {2} and {got[k] for k in (7, 8, 9, 20)} == {7} and {got[100 + k] for k in range(31)} == {100}
    assert connected_components(spark.createDataFrame([], "u long, v long"), few).count() == 0
    words = spark.createDataFrame([("é", "z"), ("z", "b"), ("C", "d")], "u string, v string")
    assert {r.node: r.component for r in connected_components(words, few).collect()} == {"é": "b", "z": "b", "b": "b", "C": "C", "d": "C"}


def test_only(spark):
    rows, ids = spark.range(1000).withColumnRenamed("id", "k"), spark.range(0, 1000, 10).withColumnRenamed("id", "k")
    kept = {r.k for r in only(rows, ids, "k").collect()}
    assert {r.k for r in ids.collect()} <= kept and len(kept) < 400


# exact dedup


def test_exact_dedup(docs, none):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(docs).collect()}
    by = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert (by[1].keep_id, by[3].keep_id, by[1].group_size, by[3].kept, by[1].kept) == (3, 3, 2, True, False)
    assert by[4].keep_id == by[5].keep_id == by[6].keep_id == 6 and by[4].group_size == 3
    assert by[7].keep_id == by[2].doc_id + 5 and by[9].group_size == 2 and by[9].kept and by[None].kept
    assert by[5].text_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == 11
    assert exact_dedup.exact_dedup(docs).count() == len(ROWS) and exact_dedup.exact_dedup(none).count() == 0


# near dedup


def brute_components(rows):
    def shingle_set(x):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower())
        return frozenset(b" ".join(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([b" ".join(w)]) if w else frozenset())

    sets = {i: shingle_set(x) for i, x in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            held[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in held[x] if j < i}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_dedup(spark, sf_dir, docs, none):
    got = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_duplicates(docs).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[7].component_id == by[8].component_id == 7
    assert [by[k].n_shingles for k in (4, 5, 6)] == [0, 0, 0] and by[5].component_id == 5 and by[None].component_id is None and by[None].kept
    assert near_dedup.near_duplicates(docs).count() == len(ROWS) and near_dedup.near_duplicates(none).count() == 0
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir).collect()]
    want = brute_components(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, sf_dir)).collect()}
    assert found == want


def test_near_dedup_family(spark):
    """A large family of near copies around the threshold, where centres miss links."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 7), replace=False):
            words[k] = f"v{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_sketch_estimate():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (int(600 * share), 300 - int(300 * share), 300 - int(300 * share)))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        true = len(common) / (len(common) + len(a) + len(b))
        guess = near_dedup.estimate(near_dedup.registers(x)[None], near_dedup.registers(y)[None], np.array([len(x)]), np.array([len(y)]))[0]
        assert abs(guess - true) < 0.17
        assert (np.maximum(near_dedup.registers(x), near_dedup.registers(y)) == near_dedup.registers(np.concatenate([x, y]))).all()


# suffix-array dedup


def brute_passages(rows):
    seen, out = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, z in zip(b, cover, strict=True) if not z)
        out[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 2000])
def test_suffix_dedup(spark, sf_dir, block):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf_dir).collect())
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_passages(table(spark, sf_dir), block=block).collect()}
    assert found == brute_passages(rows)


def test_suffix_dedup_cases(spark, docs, none):
    found = suffix_dedup.repeated_passages(docs).collect()
    assert len(found) == len(ROWS) and suffix_dedup.repeated_passages(none).count() == 0
    unique = [(r[0], r[1]) for r in ROWS if r[0] is not None and r[0] != 9]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_passages(docs.where("doc_id is not null and doc_id != 9")).collect()}
    assert got == brute_passages(unique)
    twice = sorted(r.n_removed for r in found if r.doc_id == 9)
    assert twice[0] < twice[1] == len((ROWS[8][1]).encode())
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdefgh "), 260))
    odd = [(k, "".join(rng.choice(list("abc "), rng.integers(0, 60))) + passage[rng.integers(0, 60) :] + "".join(rng.choice(list("xyz"), rng.integers(0, 30)))) for k in range(120)]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    for block in (1500, 1 << 20):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_passages(df, block=block).collect()}
        assert got == brute_passages(odd)


def test_previous_factors():
    rng = np.random.default_rng(0)
    parts = [bytes(rng.choice(list(b"ab"), 130).astype(np.uint8)) for _ in range(3)]
    parts += [parts[0][5:125] + b"zz", parts[1]]
    text = np.frombuffer(b"".join(parts), np.uint8)
    runs = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    got = suffix_dedup.previous_factors(text, runs, np.arange(len(text)))
    seen, want = set(), []
    for k, p in enumerate(parts):
        for j in range(len(p)):
            w = p[j : j + 100]
            want.append(len(w) == 100 and w in seen)
            if len(w) == 100:
                seen.add(w)
    assert got.tolist() == want


# decontamination


def test_fm_index():
    rng = np.random.default_rng(3)
    lengths = np.array([40, 1, 25, 60])
    symbols = rng.integers(1, 5, lengths.sum())
    index = fm_index.FMIndex(symbols, lengths, 4)
    phrases = rng.integers(1, 5, (80, 3))
    lo, hi = index.search(phrases)
    ends = np.cumsum(lengths)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [k for k in range(len(symbols) - 2) if (symbols[k : k + 3] == p).all() and (np.searchsorted(ends, k, "right") == np.searchsorted(ends, k + 2, "right"))]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(f"word{k} text{k % 7}" for k in range(20, 40))), (2, "One; TWO!"), (3, None), (4, "..."), (None, "aus Köln"), (2, "one two")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, bench, keep_text=True).collect()}
    assert [(s.first_word, s.end_word) for s in found[1].spans] == [(40, 80)] and found[1]["items"] == ["1"]
    assert [(s.first_word, s.end_word) for s in found[2].spans] == [(40, 60), (61, 80)] and found[8]["items"] == ["2"] and found[9]["items"] == [""]
    assert found[4].n_words == 0 and not found[4].spans and found[1].score == 0.5
    cut = {r.doc_id: r.text for r in decontaminate.contamination(docs, bench, cut=True).collect()}
    assert cut[8] == "" and "word25" not in cut[1] and "word19" in cut[1] and cut[4] is None
    blocks = decontaminate.contamination(docs, bench, block_chars=20)
    assert {r.doc_id: r.text for r in decontaminate.contamination(docs, bench, block_chars=20, cut=True).collect()} == cut
    assert sorted((r.doc_id or 0, len(r.spans), r.n_words) for r in blocks.collect()) == sorted((r.doc_id or 0, len(r.spans), r.n_words) for r in decontaminate.contamination(docs, bench).collect())
    assert decontaminate.contamination(none, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).count() == len(ROWS)


def test_decontamination_brute(spark, sf_dir):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda x: word.findall((x or "").encode().lower())
    windows = defaultdict(set)
    for r in table(spark, sf_dir, "benchmark").collect():
        w = words(r.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(r.item_id))
    want = {}
    for r in table(spark, sf_dir).collect():
        w, hit, items = words(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) and len(w[k : k + n]) == n:
                    hit.update(range(k, k + n))
                    items |= own
        want[r.doc_id] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.op4_decontamination(spark, sf_dir).collect()}
    assert got == want and any(v[4] for v in want.values())


# license scan


def test_license_scan(spark, none):
    rows = [
        (1, "x\nThis work is licensed under the GNU General Public License, version 3.\ny"), (2, "CC-BY and cc by; All rights reserved"), (3, None), (4, ""), (5, "general public licenses"),
        (6, "released under a mit license"), (7, "Released under the MIT license now"), (7, "Released under the MIT license now"), (None, "all rights\nreserved"),
    ]
    got = [tuple(r) for r in license_scan.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    by = {r[0]: r[1:] for r in got}
    assert by[1] == (14, 1, 8, 8, "gpl", "gpl", 1.0) and by[2][1:6] == (3, 0, 5, "cc-by,reserved", "cc-by,reserved")
    assert by[3] == by[4] == (0, 0, None, None, "", "", 0.0) and by[5][1] == 0 and by[6][5] == "" and by[7][5:] == ("mit", 1.0) and len(got) == len(rows)
    assert by[None][4] == "reserved" and license_scan.license_labels(none).count() == 0


def test_wrapped_license(spark):
    rows = [
        (1, "x\n// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files"),
        (2, " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided\n"),
        (3, "To the extent possible\nunder law, the author has waived all\ncopyright and related rights to\nthis work."), (4, "\n".join("a b Released under the MIT license".split())),
        (5, "released under\n\nthe mit license"), (6, "released under\n # \nthe mit license"), (7, "released under\n" + "word " * 40 + "\nthe mit license"), (8, "\n\n"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Words stand one after the other whatever is between them, as those of the base phrases do.
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("cc0", 1.0), **dict.fromkeys((4, 5, 6), ("mit", 1.0)), **dict.fromkeys((7, 8), ("", 0.0))}


# chat formatting


def test_chat_format(spark):
    turns = [
        (0, 1, "assistant", "hello"), (0, 0, "user", "hi"), (0, 2, "user", "a <|end|> b"), (1, 0, "user", "hi"), (1, 1, "assistant", "bye"), (1, 2, "assistant", None),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, "x"), (None, 0, "user", "lost"), (7, None, "assistant", "z"),
    ]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    by = {r.pair_id: r for r in chat_format.preference_pairs(df, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0).collect()}
    r = by[0]
    assert (r.chosen_id, r.rejected_id, r.n_prompt_turns, r.prompt) == (0, 1, 1, "<|user|>\nhi<|end|>\n")
    assert r.chosen == "<|assistant|>\nhello<|end|>\n<|user|>\na <||end|> b<|end|>\n"
    assert [r.chosen[s.first : s.stop] for s in r.chosen_spans] == ["hello<|end|>\n"] and [r.rejected[s.first : s.stop] for s in r.rejected_spans] == ["bye<|end|>\n", "<|end|>\n"]
    assert by[1].n_prompt_turns == 1 and by[1].chosen == by[1].rejected == ""
    assert by[2].rejected_id is None and by[2].n_prompt_turns == 0 and by[2].rejected == "" and by[3].chosen_id is None and set(by) == {0, 1, 2, 3}
    assert chat_format.preference_pairs(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_chat_pairs_with_prefix(spark, sf_dir, tmp_path):
    got = chat_format.op6_chat_format(spark, sf_dir).collect()
    assert sum(r.n_prompt_turns > 0 for r in got) >= len(got) / 2
    for r in got:
        if r.kind == "reply" and r.rejected:
            assert r.chosen.count("<|assistant|>") == r.rejected.count("<|assistant|>") >= 1 and r.prompt and r.chosen != r.rejected
    turns = [(-1, 0, "user", "q"), (-1, 1, "assistant", "minus one"), (-2, 0, "user", "q"), (-2, 1, "assistant", "minus two"), (1, 0, "user", "p"), (1, 1, "assistant", "one"), (0, 0, "user", "p"), (0, 1, "assistant", None), (9, 0, "user", "alone"), (None, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    by = {(r.kind, r.pair_id): r for r in chat_format.op6_chat_format(spark, str(tmp_path)).collect()}
    r = by["neighbours", -1]
    assert (r.chosen_id, r.rejected_id, r.n_prompt_turns) == (-2, -1, 1) and "minus two" in r.chosen and "minus one" in r.rejected
    assert (by["neighbours", 0].chosen_id, by["neighbours", 0].rejected_id) == (0, 1) and by["neighbours", 4].rejected_id == 9
    assert "minus one" in by["reply", -2].rejected and by["reply", 1].rejected == "<|assistant|>\n<|end|>\n" and by["reply", 9].n_prompt_turns == 1
    assert len(by) == 8


# HTML


def test_html():
    text = html_text.main_text
    page = "<nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>two\n three</b> four five six.<p>Next &lt;p&gt; para</p><script>x='</p>'</script><aside>no</aside></article><footer>&copy; me</footer>"
    assert text(page) == "A & B\nOne two three four five six.\nNext <p> para"
    assert text(None) == text("") == text("<p></p>") == "" and text("just words") == "just words"
    assert text("<div class='sidebar'>Many words of a sidebar here and there</div><div id=main><p>The real text of the page is here.</p><p>And goes on.</p></div><div class='comments'><p>I like it</p></div>") == "The real text of the page is here.\nAnd goes on."
    for source in html_text.LABELLED:
        inner = source.split("<!--begin-->")[1].split("<!--end-->")[0]
        want = [" ".join(re.sub(r"<[^>]*>", "", b).split()) for b in re.split(r"</?(?:p|h1|h2|li|ul|article|blockquote)[^>]*>", inner)]
        assert text(source) == "\n".join(x for x in want if x)


def test_html_open_elements():
    text, body = html_text.main_text, "<p>The real text of the page is here and goes on.</p><p>And it goes on for long.</p>"
    want = text(body)
    assert want.count("\n") == 1
    for before in (
        "<html><head><title>Some title of words</title><meta name=x><body>", "<head><link rel=x><script>x='<body>'</script><style>p{}</style>", "<head><title>Some title</head><body>",
        "<head><title>T</title></head><body>", "<body><svg width=1 />", "<body><svg><svg><text>no words</text></svg><text>none here</text></svg>", "<body><svg><text>no words here",
        "<body><select><option>Alpha<option>Beta", "<body><button>Press here", "<body><select><option>Alpha</select>", "<body><button><div>Press</div> here</button>", "<body><button>One<button>Two</button>",
    ):
        assert text(before + body) == want and (before[:6] != "<body>" or text(before + body + before[6:]) == want), before
    assert text("<head>\n<meta charset=x>Plain words of a page that never opens its body.") == "Plain words of a page that never opens its body."
    icon = "<svg>" + "<path d='1'/>" * 99 + "</svg>"
    assert text(f"<p>One two three {icon} four <button>Click <i>me</i></button> five six.</p>") == "One two three four five six."


def test_best_region_is_the_greatest():
    rng = np.random.default_rng(6)
    for _ in range(50):
        page = html_text.Page("")
        page.kinds = [f"k{v}" for v in rng.integers(0, 6, 20)]
        weight = {f"k{v}": float(w) for v, w in enumerate(rng.normal(0, 1, 6))}
        scores = [weight[k] for k in page.kinds]
        best = max(sum(scores[a:b]) for a in range(20) for b in range(a + 1, 21))
        region = html_text.best_region(page, weight)
        assert (region is None and best <= 0) or abs(sum(scores[slice(*region)]) - best) < 1e-9


def test_html_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    for r in html_text.extract_text(pages).join(pages, "page_id").collect():
        import html

        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    empty = spark.createDataFrame([(1, None, None, "t")], "page_id long, url string, html string, text string")
    assert html_text.extract_text(empty).first().text == "" and html_text.extract_text(empty.limit(0)).count() == 0


# language


def test_language(spark, sf_dir, docs, none):
    got = language_id.op8_language_id(spark, sf_dir).join(table(spark, sf_dir).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    models = language_id.prototypes(table(spark, sf_dir))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "the a")], "doc_id long, text string")
    by = {r.doc_id: r for r in language_id.identify(odd, models).collect()}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[4].lang_pred in models
    assert language_id.identify(docs, {}).where("lang_pred != 'und'").count() == 0 and language_id.identify(none, models).count() == 0
    assert language_id.identify(docs, models).count() == len(ROWS) and language_id.prototypes(none) == {}


# toxicity


def test_toxicity(spark, sf_dir, docs, none):
    labels = table(spark, sf_dir, "labels")
    got = toxicity.op1_toxicity(spark, sf_dir).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)
    model = toxicity.fit(toxicity.annotated_sample(table(spark, sf_dir), labels))
    scored = toxicity.scores(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored) and toxicity.scores(none, model).count() == 0
    bare = toxicity.fit(toxicity.annotated_sample(none, labels.limit(0)))
    pair = spark.createDataFrame([(1, "you stupid idiot, worthless scum"), (2, "a walk in the park")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.scores(pair, bare).orderBy("doc_id").collect()] == [1, 0]


def test_label_model():
    """Rates, dependences and classes from votes alone."""
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    rates = ((0.6, 0.02), (0.5, 0.05), (0.4, 0.4), (0.55, 0.03), (0.5, 0.04))
    votes = np.stack([np.where(y, rng.random(4000) < hit, rng.random(4000) < miss) for hit, miss in rates], 1).astype(float)
    votes = np.column_stack([np.where(rng.random(4000) < 0.03, 1 - votes[:, 0], votes[:, 0]), votes])  # the first voter nearly twice
    post, model = toxicity.label_model(votes, 0.2)
    assert ((post > 0.5) == y).mean() >= 0.93 and abs(post.mean() - 0.2) < 0.01
    assert model["parent"][0] == 1 or model["parent"][1] == 0
    assert all(abs(model["fire"][1, k + 1] - hit) < 0.15 and abs(model["fire"][0, k + 1] - miss) < 0.05 for k, (hit, miss) in enumerate(rates) if hit != miss)
    child = 0 if model["parent"][0] == 1 else 1
    log = np.log(model["table"][1] / model["table"][0])[:, child]
    assert log[1] < 0.3 * np.log(model["fire"][1, child] / model["fire"][0, child])  # its copy has said it already
    assert len(toxicity.label_model(np.zeros((0, 3)), 0.5)[0]) == 0


def test_dependence_brute():
    rng = np.random.default_rng(5)
    votes, w = (rng.random((300, 4)) < 0.4).astype(float), rng.random(300)
    votes[:, 3] = votes[:, 0]
    mass = np.stack([1 - w, w])
    got = toxicity._dependence(votes, mass)
    for i in range(4):
        for j in range(4):
            if i != j:
                want = 0.0
                for c in mass:
                    for a in (0, 1):
                        for b in (0, 1):
                            pab = (c * (votes[:, i] == a) * (votes[:, j] == b)).sum() / c.sum()
                            pa, pb = ((c * (votes[:, k] == v)).sum() / c.sum() for k, v in ((i, a), (j, b)))
                            if pab > 0:
                                want += c.sum() / 300 * pab * np.log(pab / (pa * pb))
                assert abs(got[i, j] - want) < 1e-6
    assert toxicity._parents(votes, mass, 0.1).tolist().count(-1) == 3


def test_scores_brute(spark, sf_dir, docs):
    """Scores of whole texts against plain Python over words, beginnings and patterns."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.annotated_sample(table(spark, sf_dir), labels))
    weight = {int(np.uint64(t)): w for t, w in zip(np.sort(model.terms.view(np.uint64)), model.weights, strict=False)}
    pattern = dict(zip(toxicity.PATTERNS, model.weights[len(model.terms) :], strict=False))
    plain = str.maketrans("0134578", "oieastb")

    def key(w: str, kind: int) -> int:
        body = np.frombuffer(w.encode(), np.uint8)
        return int(toxicity._keys(body, np.array([0]), np.array([len(body)]), kind)[0])

    def score(text):
        text = text or ""
        words = [w.translate(plain) for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())]
        keys = {key(w, 0) for w in words} | {key(w[:n], n) for w in words for n in toxicity.BEGINNINGS if n and len(w) > n}
        insults = sum(w in {x.translate(plain) for x in toxicity.INSULTS} for w in words)
        upper, lower = (len(re.findall(f"[{r}]", text)) for r in ("A-Z", "a-z"))
        fired = {
            "shouting": upper > lower and upper > 8, "exclaiming": text.count("!") * 10 > max(1, len(words)), "insult": insults > 0,
            "insults": insults > 2 or insults * 50 > max(1, len(words)), "address": any(w in {x.translate(plain) for x in toxicity.ADDRESS} for w in words),
        }
        total = model.weights[-1] + sum(weight.get(k, 0.0) for k in keys) + sum(pattern[p] for p, f in fired.items() if f)
        return 1 / (1 + np.exp(-total))

    rows = table(spark, sf_dir).select("doc_id", F.col("text").alias("body"), F.lit("other").alias("text")).unionByName(docs.select(F.col("doc_id") + 10**6, F.col("text").alias("body"), F.lit("other").alias("text")).toDF("doc_id", "body", "text"))
    got = toxicity.scores(rows, model, "body").collect()
    assert got and all(abs(r.score - score(r.body)) < 1e-9 and r.text == "other" for r in got)


# mixing


def test_mixing(spark, sf_dir, docs, none):
    got = mixing.op10_mixing(spark, sf_dir).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(size.values())
    assert abs(sum(t for t, _ in target.values()) - 1.5 * total) < 1e-6 * total and all(size[s] == target[s][1] for s in size)
    assert all(abs(taken[s] - target[s][0]) <= 0.05 * target[s][0] + 128 for s in size)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    open_ = [s for s in size if target[s][0] < 2 * size[s] - 1e-6]
    rates = {round(target[s][0] / weights[s], 6) for s in open_}
    assert len(rates) == 1 and all(2 * size[s] <= max(rates) * weights[s] + 1e-6 for s in size if s not in open_)
    assert sorted(map(tuple, mixing.op10_mixing(spark, sf_dir).collect())) == sorted(map(tuple, got))
    small = mixing.mix(docs).collect()
    assert len(small) == len(ROWS) and all(r.taken <= 2 * r.size for r in small) and mixing.mix(none).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        if n == 1000:
            assert np.corrcoef(got, range(n))[0, 1] < 0.2


def test_shards_are_mixed(spark, sf_dir):
    placed, slots = mixing.mix_plan(table(spark, sf_dir))
    n = slots.count()
    assert slots.select("slot").distinct().count() == n and slots.agg(F.max("slot")).first()[0] == n - 1
    assert slots.groupBy("skey", "block").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("block_tokens", [128, 7])
def test_mix_is_made(spark, docs, none, block_tokens):
    """The packed rows hold the words of the sources' streams, and taken is what they hold."""
    extra = spark.createDataFrame([(20 + k, "\n ".join(f"{k}w{i}" for i in range(k * 37)) + " ", "en", "d", 1, None, None, None) for k in range(9)], DOCS)
    both = docs.unionByName(extra)
    placed, packed = mixing.mixed(both, block_tokens=block_tokens)
    stream, texts = defaultdict(dict), defaultdict(list)
    for r in both.collect():
        texts[r.doc_id].append(re.findall(r"[^ \t-\r]+", r.text or ""))
    for r in placed.where("size > 0").collect():
        stream[r.skey].update((r.start + i, w) for i, w in enumerate(texts[r.id][0]))
    taken, seen = defaultdict(int), []
    for r in packed.collect():
        words = [(p.id, w) for p in r.pieces for w in re.findall(r"[^ \t-\r]+", p.text)]
        lo = r.block * block_tokens
        assert [w for _, w in words] == [stream[r.skey][k] for k in range(lo, min(lo + block_tokens, len(stream[r.skey])))]
        assert sum(p.n for p in r.pieces) == len(words) and r.shard == r.slot // mixing.SHARD_SLOTS
        seen.append(r.slot)
        for i, _ in words:
            taken[i] += 1
    assert sorted(seen) == list(range(len(seen))) and seen
    got = defaultdict(int)
    for r in mixing.mix(both, block_tokens=block_tokens).collect():
        got[r.doc_id] += r.taken
    assert {k: v for k, v in got.items() if v} == dict(taken)
    assert mixing.mixed(none)[1].count() == 0


def test_registry(spark, sf_dir):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(registry.queries())
