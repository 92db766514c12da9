"""The pipeline's stages on a table with nulls, repeats and copies, each against brute force on its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sievelight.llm import toxicity

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def sf(spark, sf_dir, tmp_path_factory):
    place = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = {r.doc_id: r.text for r in docs.where("doc_id < 8").collect()}
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect() if len(WORD.findall(r.text.lower().encode())) > 12)
    odd = [
        (10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, " \t", "en", None, 2),
        (10**6 + 3, some[1].replace(" ", "  "), "en", "src1", 1), (10**6 + 4, some[1] + " at last", "en", "src1", 1), (10**6 + 5, some[2], "en", "src2", 1),
        (10**6 + 6, f"{some[3]}\n{item}\n{some[4]}", "en", "src0", 1), (10**6 + 7, item, "en", "src0", 1), (None, "nobody's text stands here", "en", "src1", 1),
        (10**6 + 8, "twice the same id and text", "en", "src1", 1), (10**6 + 8, "twice the same id and text", "en", "src1", 1),
        (10**6 + 9, "word " * 10 + " ".join(f"long{k}" for k in range(120000)), "en", "hot", 1),
    ]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{place}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{place}/{name}.parquet")
    return str(place)


def _exact(rows):
    best = {}
    for r in rows:
        key = SPACE.sub("", r.text or "")
        rank = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        best[key] = min(best.get(key, (rank, r)), (rank, r), key=lambda x: x[0])
    return Counter(r for r in rows if (one := best[SPACE.sub("", r.text or "")][1]).doc_id == r.doc_id and (one.text == r.text))


def _near(rows):
    sets, parent = {}, {}
    for r in rows:
        words = [w for w in SPACE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")) if w]
        if r.doc_id is not None and words:
            sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
            parent[r.doc_id] = r.doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return Counter(r for r in rows if r.doc_id not in parent or root(r.doc_id) == r.doc_id)


def _clean(rows, bench):
    windows = set()
    for r in bench:
        w = WORD.findall((r.text or "").encode().lower())
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes, out = {len(w) for w in windows}, Counter()
    for r in rows:
        body = (r.text or "").encode()
        at = [m.span() for m in WORD.finditer(body.lower())]
        w, hit = [body[a:b].lower() for a, b in at], set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit:
            out[tuple(r)] += 1
            continue
        gone = set()
        for k in sorted(hit):
            gone.update(range(at[k][0], at[k + 1][0] if k + 1 in hit else at[k][1]))
        text = bytes(c for k, c in enumerate(body) if k not in gone).decode()
        if WORD.search(text.encode().lower()):
            out[(r.doc_id, text, r.lang, r.source, len(text))] += 1
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near-dedup", "decontamination", "mixing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = corpus_pipeline.materialise(stage(spark, docs, sf), "test-stage")
        after = Counter(map(tuple, out.collect()))
        if name == "toxicity":
            model = toxicity.learned(spark, sf)
            bad = {(r.doc_id, r.text) for r in toxicity.scores(docs, model).where(F.col("score") >= 0.5).collect()}
            assert after == Counter(tuple(r) for r in before if (r.doc_id, r.text) not in bad)
        elif name == "exact dedup":
            assert after == Counter({tuple(k): v for k, v in _exact(before).items()}) and sum(after.values()) < len(before)
        elif name == "near-dedup":
            assert after == Counter({tuple(k): v for k, v in _near(before).items()}) and sum(after.values()) < len(before)
        elif name == "decontamination":
            assert after == _clean(before, bench) and after != Counter(map(tuple, before))
        else:
            mixed = out.collect()
            size = Counter((r.doc_id, len([w for w in SPACE.split(r.text or "") if w])) for r in before)
            assert Counter((r.doc_id, r["size"]) for r in mixed) == size and all(0 <= r.taken <= 2 * r["size"] for r in mixed)
        if name != "mixing":
            assert out.columns == docs.columns
        kept.append(sum(after.values()))
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == kept[-1]


def test_empty(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
