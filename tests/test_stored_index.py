"""The stored index against the index that is made at query time, and its plan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievelight.functions import text
from sievelight.operators import symbols
from sievelight.plans import fixtures
from sievelight.plans.search import Index, Settings
from sievelight.plans.stored import StoredIndex


def test_same_hits(spark, tmp_path):
    tree = fixtures._sources(spark)
    stored = StoredIndex(spark, str(tmp_path / "index"), Settings(enabled=False), buckets=1)
    stored.refresh(tree)
    made = Index.of_files(tree, symbols.definitions(tree))
    for q, options in (("helper", {}), ("session open", {"lang": "rust"}), ('"server struct"', {}), ("+helper -session", {"path": "pkg/"})):
        want = [(r.chunk, round(r.score, 9)) for r in made.bm25(q, 5, **options).collect()]
        assert want and [(r.chunk, round(r.score, 9)) for r in stored.bm25(q, 5, **options).collect()] == want
    plan = stored.bm25("helper", 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan or "EqualTo(term," in plan
    with pytest.raises(ValueError):
        stored.search("helper")


def test_truncated(spark):
    rows = [("a" * 8192,), ("a" + "é" * 4096,), ("aa" + "😀" * 2048,), ("aaa" + "😀" * 2048,), ("x",)]
    got = [r.t for r in spark.createDataFrame(rows, "v string").select(text.truncated(F.col("v")).alias("t")).collect()]
    mark = "\n[truncated]"
    assert got == [rows[0][0], "a" + "é" * 4095 + mark, "aa" + "😀" * 2047 + mark, "aaa" + "😀" * 2047 + mark, "x"]
