"""Anchors that stand in most texts, with and without tasks of their own."""

from __future__ import annotations

import numpy as np
import pytest
from test_llm_operators import brute_passages

from sievelight.llm import suffix_dedup


@pytest.mark.parametrize("least", [2, 8])
def test_hot_anchors(spark, monkeypatch, least):
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", least)
    rng = np.random.default_rng(4)
    letters = list("abcdefgh ")
    common = "".join(rng.choice(letters, 150))
    rows = [(k, "".join(rng.choice(letters, 90)) + common[rng.integers(0, 40) :] + "".join(rng.choice(letters, 90))) for k in range(90)]
    rows += [(k, rows[k - 90][1]) for k in range(90, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = suffix_dedup.hot_anchors(docs.selectExpr("doc_id rid", "text"), len(rows)).collect()
    assert hot and max(r.salts for r in hot) > 1
    for block in (1000, 1 << 20):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_passages(docs, block=block).collect()}
        assert got == brute_passages(rows)
