"""The Bloom filter of exact dedup: repeated bits, and how few unique rows are suspects."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from sievelight.llm import exact_dedup


def test_repeated_bits(spark):
    rows = [(k % 3, (k * k) % 200) for k in range(400)] + [(1, 7)] * 500 + [(0, 63), (0, 64), (2, 199)]
    df = spark.createDataFrame(rows, "range long, bit int").repartition(5)
    got = set()
    for r in exact_dedup.repeated_bits(df, 200).collect():
        got |= {r.word * 64 + k for k in range(64) if r.bits >> k & 1}
    assert got == {a * 200 + b for (a, b), n in Counter(rows).items() if n > 1}


def test_hot_text_and_few_suspects(spark, monkeypatch):
    seen = []
    old = exact_dedup.attach
    monkeypatch.setattr(exact_dedup, "attach", lambda rows, *a: (seen.append(rows.count()), old(rows, *a))[1])
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same  text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), F.lit(1).alias("kept"), F.lit("x").alias("word"))
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == 3000 and {r.group_size for r in got} == {1, 1000} and {r.keep_id for r in got if r.group_size > 1} == {0}
    assert 1000 <= seen[0] <= 1000 + 2000 // 16
