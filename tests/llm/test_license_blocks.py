"""License paragraphs in wrapped, changed and padded texts, against brute force and the SQL."""

from __future__ import annotations

import random
import re
import textwrap

import duckdb
from compare import assert_same

from sievelight.llm import license_scan as scan


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(scan.UPPER, scan.LOWER)))
    found = {}
    for label, template, *must in scan.TEMPLATES:
        own, size = scan.sequence(template), len(set(scan.sequence(template)))
        for i in range(len(words)):
            if scan.is_notice(template):
                share = float(words[i : i + len(own)] == own)
            else:
                block = set(words[i : i + scan.block_words(template)]) & set(own)
                share = len(block) / size if len(block) >= scan.needed(size, scan.THRESHOLD) and set(must) <= block else 0.0
            if share:
                found[label] = max(found.get(label, 0.0), share)
    return found


def documents():
    rng = random.Random(3)
    filler = "lorem the of and to in software this license ipsum dolor copy or is".split()
    rows, n = [], 0
    for _, template, *_ in scan.TEMPLATES:
        words = template.split()
        for drop in (0, 1, max(1, len(words) // 6), len(words) // 3):
            kept = [w for k, w in enumerate(words) if k not in set(rng.sample(range(len(words)), drop))]
            for _ in range(drop):
                kept.insert(rng.randrange(len(kept) + 1), rng.choice(filler))
            text = " ".join(rng.choices(filler, k=30)) + "\n" + textwrap.fill(" ".join(kept).capitalize(), 40, initial_indent="// ", subsequent_indent="// ") + "\n" + " ".join(rng.choices(filler, k=30))
            rows.append((n, text))
            n += 1
    rows += [(n, "We all agree that the reserved seats have no voting rights"), (n + 1, "4 people by 0 cc licensed under x"), (n + 2, "Licensed under the Apache License,\nVersion 2.0"), (n + 3, None), (n + 4, "")]
    rows.append((n + 5, "word " * 500_000 + rows[8][1] + " word" * 500_000))
    return rows


def test_blocks(spark, tmp_path):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in scan.license_labels(df).collect()}
    for i, text in rows[:-1]:
        want = brute(text)
        assert set(got[i].labels.split(",")) - {""} == set(want) | set(got[i].base_labels.split(",")) - {""}, (i, text)
        if not got[i].n_base:
            assert abs(got[i].score - max(want.values(), default=0.0)) < 1e-12
    whole = {label for k, (label, _) in enumerate((t[0], t[1]) for t in scan.TEMPLATES)}
    assert {x for r in got.values() for x in r.labels.split(",") if x} == whole
    n = len(rows) - 6
    assert got[n].labels == got[n + 1].labels == "" and got[n + 2].labels == "apache" and got[n + 5].labels == got[8].labels != ""
    df.where("doc_id < %d" % (n + 5)).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(scan.op5_license_scan(spark, str(tmp_path)), con, scan.ORACLE_SQL["op5_license_scan"])
