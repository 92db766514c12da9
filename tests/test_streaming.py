from __future__ import annotations

import json

from sievelight.operators import telemetry
from sievelight.streaming import events


def test_follow(spark, tmp_path):
    log = tmp_path / "in"
    log.mkdir()
    line = lambda ms, mode="bm25": json.dumps({"kind": "search", "mode": mode, "total_ms": ms, "results": 1, "query": "q"})
    (log / "a.json").write_text(line(5) + "\n" + line(9) + "\n")
    events.follow(spark, str(log), telemetry.SCHEMA, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "summary")).first()["queries"] == 2
    (log / "b.json").write_text(line(7) + "\n")
    events.follow(spark, str(log), telemetry.SCHEMA, str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out" / "summary")).first()
    assert (row["queries"], row["p50_ms"]) == (3, 7)


def test_hourly_stream(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    q = events.hourly(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hourly").count() == events.hourly(table).count()
