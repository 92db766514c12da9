"""Language identification against plain Python, and in small steps."""

from __future__ import annotations

import math

import numpy as np

from sievelight.llm import decontaminate, language_id

TEXTS = [(1, "the cat sat on the mat", "en"), (2, "Der Hund läuft, 12 Meter weit!", "de"), (3, "the dog, the end", "en"), (4, "über  die Straße", "de"), (5, "", "en"), (6, None, "en"), (7, "42", "de"), (8, "привет мир 漢字", "xx")]


def _letter(c):
    if not c.isalpha():
        return 0
    k = ord(c.lower()[0])
    return k - 96 if 97 <= k <= 122 else 27 + k % (language_id.LETTERS - 27)


def _vector(text):
    own = [0]
    for c in text or "":
        if _letter(c) or own[-1]:
            own.append(_letter(c))
    own += [0] if own[-1] else []
    total = [0] * language_id.DIM
    for a, b, c in zip(own, own[1:], own[2:], strict=False):
        if b:
            for d in range(language_id.DIM):
                total[d] += int(language_id._LETTER[a][d - 2]) * int(language_id._LETTER[b][d - 1]) * int(language_id._LETTER[c][d])
    return total


def _cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))


def test_brute(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    models = {}
    for _, text, lang in TEXTS:
        if text is not None:
            models[lang] = [x + y for x, y in zip(models.get(lang, [0] * language_id.DIM), _vector(text), strict=True)]
    got = language_id.prototypes(docs)
    assert {k: v.tolist() for k, v in got.items()} == models
    for r in language_id.identify(docs, got).collect():
        own = _vector(next(t for k, t, _ in TEXTS if k == r.doc_id))
        if not any(own):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        want = {k: _cosine(own, v) for k, v in models.items()}
        assert r.lang_pred == max(sorted(want), key=want.get) and abs(r.score - max(want.values())) < 1e-5


def test_steps(monkeypatch):
    rng = np.random.default_rng(1)
    row, code = np.sort(rng.integers(0, 9, 500)), rng.integers(0, language_id.LETTERS**3, 500)
    row[row == 4] = 5
    want = language_id.bundles(code, row, 10)
    monkeypatch.setattr(language_id, "STEP", 100)
    monkeypatch.setattr(language_id, "CODES", 7)
    assert np.array_equal(language_id.bundles(code, row, 10), want) and not want[4].any() and not want[9].any()
    assert language_id.bundles(code[:0], row[:0], 3).shape == (3, language_id.DIM)


def test_clashing_text(spark):
    docs = spark.createDataFrame([(1, "own", "the cat sat on the mat"), (2, None, None)], "doc_id long, text string, body string")
    got = language_id.identify(docs, language_id.prototypes(docs.selectExpr("body", "'en' lang"), "body"), "body").orderBy("doc_id").collect()
    assert [(r.text, r.lang_pred) for r in got] == [("own", "en"), (None, "und")] and "body" not in got[0]
    bench = spark.createDataFrame([(1, "cat sat")], "item_id long, text string")
    cut = decontaminate.contamination(docs, bench, "body", cut=True).orderBy("doc_id").collect()
    assert [(r.text, r.body, len(r.spans)) for r in cut] == [("own", "the  on the mat", 1), (None, None, 0)]
    assert decontaminate.contamination(docs, bench, "body").columns == ["doc_id", "text", "n_words", "spans", "items"]
