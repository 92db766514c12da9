"""Snapshot diffs, refresh policy, and tables that follow a changing source."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(current: DataFrame, stored: DataFrame, key: str = "path", version: str = "mtime") -> DataFrame:
    """(key, change): added, changed (another version) or removed; unchanged rows aren't there."""
    a = current.select(F.col(key), F.col(version).alias("_now"), F.lit(True).alias("_a"))
    b = stored.select(F.col(key), F.col(version).alias("_then"), F.lit(True).alias("_b"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_now").eqNullSafe(F.col("_then")), "changed")
    return a.join(b, key, "full_outer").select(F.col(key), change.alias("change")).where("change is not null")


def policy(n_changes: int, n_current: int, force: bool = False, usable: bool = True) -> str:
    """'full', 'none' or 'delta': a delta if at most half of the current rows differ."""
    if force or not usable:
        return "full"
    if n_changes == 0:
        return "none"
    return "delta" if 2 * n_changes <= n_current else "full"


def upserted(table: DataFrame, changes: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """table without the rows of removed and changed keys, with the fresh rows of added
    and changed ones. fresh may cover all keys."""
    gone = changes.where("change in ('removed', 'changed')").select(key)
    new = changes.where("change in ('added', 'changed')").select(key)
    return table.join(gone, key, "left_anti").unionByName(fresh.join(new, key, "left_semi"))


class Store:
    """A derived table and the snapshot it was made from, in a folder.

    The table is partitioned by buckets of its key, so that a delta rewrites only the
    buckets that change; the manifest is written last, so that a broken refresh is
    made anew.
    """

    def __init__(self, spark: SparkSession, path: str, derive: Callable[[DataFrame], DataFrame], schema_version: int = 1, model: str = "", key: str = "path", buckets: int = 16, order: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.derive = spark, path.rstrip("/"), derive
        self.version, self.model, self.key, self.buckets, self.order = schema_version, model, key, buckets, order

    def _fs(self, name: str) -> tuple:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def manifest(self) -> dict | None:
        """What the store was built with; None if missing or of another version or root."""
        fs, place = self._fs("manifest.json")
        if not fs.exists(place):
            return None
        try:
            found = json.loads("\n".join(r.value for r in self.spark.read.text(str(place)).collect()))
        except ValueError:
            return None
        return found if found.get("schema_version") == self.version and found.get("root") == self.path else None

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/table").drop("_bucket")

    def snapshot(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.manifest()['snapshot']}")

    def stale(self, current: DataFrame) -> bool:
        found = self.manifest()
        return found is None or found["model"] != self.model or not diff(current, self.snapshot(), self.key).isEmpty()

    def refresh(self, source: DataFrame, force: bool = False) -> dict:
        """Bring the table up to date with source (key, mtime, ...) and say how: mode,
        files and chunks (0 if nothing had to be done)."""
        current, found = source.select(self.key, "mtime"), self.manifest()
        usable = found is not None and found["model"] == self.model
        changes = diff(current, self.snapshot(), self.key).persist() if usable and not force else None
        n_files = current.count()
        mode = policy(changes.count() if changes is not None else 0, n_files, force, usable)
        if mode == "none":
            return {"mode": mode, "files": n_files, "chunks": 0}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        staged = f"{self.path}/staged"
        if mode == "delta":
            touched = changes.select(bucket.alias("_bucket")).distinct()
            old = self.spark.read.parquet(f"{self.path}/table").join(F.broadcast(touched), "_bucket", "left_semi").drop("_bucket")  # buckets at most
            wanted = changes.where("change != 'removed'").select(self.key)
            new = upserted(old, changes, self.derive(source.join(wanted, self.key, "left_semi")), self.key)
            new.withColumn("_bucket", bucket).write.mode("overwrite").parquet(staged)
            for row in touched.collect():  # buckets at most
                self._drop(f"table/_bucket={row[0]}")
            self._laid(self.spark.read.parquet(staged)).write.mode("append").partitionBy("_bucket").parquet(f"{self.path}/table")
        else:
            self._laid(self.derive(source).withColumn("_bucket", bucket)).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/table")
        if changes is not None:
            changes.unpersist()
        turn = (found or {}).get("turn", 0) + 1
        current.write.mode("overwrite").parquet(f"{self.path}/snapshot-{turn}")
        manifest = {"schema_version": self.version, "root": self.path, "model": self.model, "turn": turn, "snapshot": f"snapshot-{turn}"}
        fs, place = self._fs("manifest.json")
        out = fs.create(place, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if found:
            self._drop(found["snapshot"])
        self._drop("staged")
        return {"mode": mode, "files": n_files, "chunks": self.table().count()}

    def _laid(self, rows: DataFrame) -> DataFrame:
        """Rows by bucket, and in a bucket by the store's order, so that a filter on it skips row groups."""
        dealt = rows.repartition("_bucket")
        return dealt.sortWithinPartitions("_bucket", *self.order) if self.order else dealt

    def _drop(self, name: str) -> None:
        fs, place = self._fs(name)
        fs.delete(place, True)
