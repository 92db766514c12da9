"""Every registered retrieval query against its SQL."""

from __future__ import annotations

import pytest
from compare import assert_same

from sievelight.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf_dir, duck):
    df = catalogue.queries()[name](spark, sf_dir)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert_same(df, duck, sql)
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark, sf_dir):
    from pyspark.sql import functions as F

    plan = catalogue.queries()["bm25_lang"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    plan = catalogue.queries()["bm25_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    seen = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.contains("source", F.lit("src1"))).select("doc_id")
    assert "StringContains(source,src1)" in seen._jdf.queryExecution().executedPlan().toString()
