"""Mixing: targets, draws and prefix sums against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievelight.llm import mixing

SIZES = [("a", 900), ("b", 40), ("c", 500), ("d", 3), ("e", 0), ("ü", 120), ("Z", 77), (None, 60)]


def brute_targets(sizes, share, cap, weights):
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    target, full = {}, set()
    while True:
        left = share * sum(n for _, n in order) - sum(cap * n for s, n in order if s in full)
        open_ = sum(weight[s] for s, _ in order if s not in full)
        target = {s: cap * n if s in full else left * weight[s] / open_ for s, n in order}
        more = {s for s, n in order if s not in full and target[s] >= cap * n}
        if not more:
            return target
        full |= more


def sources(spark):
    return spark.createDataFrame([("n" if s is None else "s" + s, n, s) for s, n in SIZES], "skey string, source_size long, source string")


@pytest.mark.parametrize("few", [None, 0])
def test_targets(spark, few):
    got = mixing.source_targets(sources(spark), 1.5, 2.0, mixing.WEIGHTS, few=few).collect()
    want = brute_targets(SIZES, 1.5, 2.0, mixing.WEIGHTS)
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in want.items()}
    assert [r.source for r in sorted(got, key=lambda r: r.idx)] == ["Z", "a", "b", "c", "d", "e", "ü", None]


@pytest.mark.parametrize("few", [None, 0])
def test_running_sums(spark, few, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 3)
    rows = [(g, k * 2 + g, k + 1) for g in range(3) for k in range(20)]
    got = mixing.running_sums(spark.createDataFrame(rows, "g int, at long, v long"), ["g"], "at", ["v"], few=few).collect()
    assert {(r.g, r.at): r.before_v for r in got} == {(g, at): sum(v for h, x, v in rows if h == g and x < at) for g, at, _ in rows}


def test_located(spark):
    spans = [(k, lo, hi) for k, (lo, hi) in enumerate([(0.0, 0.001), (0.001, 0.002), (0.002, 3.5), (3.5, 3.6), (3.6, 4.0)])]
    points = [(k * 0.0399,) for k in range(100)] + [(0.001,), (3.5,), (0.0,)]
    found = mixing.located(spark.createDataFrame(points, "x double"), spark.createDataFrame(spans, "k int, lo double, hi double"), 4.0, len(spans)).collect()
    assert sorted((r.x, r.k) for r in found) == sorted((x, next(k for k, lo, hi in spans if lo <= x < hi)) for (x,) in points)


@pytest.mark.parametrize("shard_slots", [8192, 50])
def test_draws(spark, monkeypatch, shard_slots):
    """Each shard's source counts are whole parts and draws, no block is taken too often, and slots are numbered without gaps."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", shard_slots)
    blocks = [300, 40, 7, 1]
    want = [int(x * mixing.FRACTION) for x in (420.3, 80, 14, 1.4)]
    targets = spark.createDataFrame([(k, f"s{k}", str(k), n, w) for k, (n, w) in enumerate(zip(blocks, want, strict=True))], "idx long, skey string, source string, n_blocks long, want long")
    slots = mixing._slots(targets, 2.0, 7).collect()
    n = sum(want) // mixing.FRACTION
    shards = -(-n // shard_slots)
    size = n // shards
    assert sorted(r.slot for r in slots) == list(range(size * shards)) and all(r.shard == r.slot // size for r in slots)
    counts, qs = Counter((r.shard, r.idx) for r in slots), defaultdict(set)
    for r in slots:
        qs[r.idx].add(r.q)
    for k, b in enumerate(blocks):
        total = sum(counts[s, k] for s in range(shards))
        assert len(qs[k]) == total and max(qs[k]) < 2 * b and abs(total - want[k] / mixing.FRACTION) <= 3 + shards**0.5
        assert all(counts[s, k] >= size * want[k] // sum(want) for s in range(shards))
    if shards > 1:
        assert len({counts[s, 0] for s in range(shards)}) > 1
    assert sorted(map(tuple, mixing._slots(targets, 2.0, 7).collect())) == sorted(map(tuple, slots))


def test_many_buckets(spark):
    """A source of many buckets, rows that repeat ids and texts, null sources, and clashing names."""
    rows = [(k % 50, " ".join(f"{k}x{i}" for i in range(k % 23)), "one" if k % 3 else None, k, "x") for k in range(600)] + [(1, "same text here", "two", 0, None)] * 30 + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, bucket string")
    got = mixing.mix(docs, block_tokens=8, bucket_words=200)
    rows_out = got.collect()
    assert len(rows_out) == len(rows) and all(r.taken <= 2 * r.size for r in rows_out)
    by = got.groupBy("source").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("all")).collect()
    assert all(r["size"] == r["all"] and abs(r.taken - r.target) <= 0.1 * r.target + 24 for r in by)
