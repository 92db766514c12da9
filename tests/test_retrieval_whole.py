"""Queries that must cover their whole tables."""

from __future__ import annotations

from sievelight.plans import catalogue


def test_every_user_is_scored(spark, sf_dir):
    users = {r.user_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().collect()}
    got = [r.user_id for r in catalogue.queries()["eval_scores"](spark, sf_dir).collect()]
    assert len(got) == len(users) and set(got) == users and any(u % 10 for u in users)
    assert "% 10" not in catalogue.oracle_sql()["eval_scores"]


def test_whole_texts_are_escaped(spark, tmp_path):
    texts = ["x" * 30 + "_y%" + "z" * 5000 + "\\", "50%", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.escaped for r in catalogue.queries()["like_escape"](spark, str(tmp_path)).collect()}
    assert got == {k: "".join("\\" * (c in "\\%_") + c for c in t + "50%_done\\x") for k, t in enumerate(texts)}
