"""A search index that is stored: chunks, postings and vectors that follow their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.text import index_tokens, made_once
from sievelight.operators import bm25, fusion, symbols, telemetry
from sievelight.operators.chunking import chunk_files, chunk_id, chunk_tokens
from sievelight.operators.snapshot import Store
from sievelight.plans.search import Index, Settings, hashed_vector


def chunks_of(files: DataFrame) -> DataFrame:
    """Chunks of files (path, text, lang): chunk, path, start, end, text, lang, breadcrumb, tok."""
    cut = chunk_files(files.select("path", "text"), symbols.definitions(files)).join(files.select("path", "lang"), "path")
    named = cut.withColumn("chunk", chunk_id(F.col("path"), F.col("start"), F.col("end")))
    return named.withColumn("tok", chunk_tokens(F.col("text"), F.coalesce("breadcrumb", F.lit(""))))


def _chunk_rows(files: DataFrame) -> DataFrame:
    return chunks_of(files).withColumn("dl", F.size(index_tokens(F.col("tok"))).cast("long")).drop("tok")


def _posting_rows(files: DataFrame) -> DataFrame:
    path = F.regexp_replace("chunk", ":[0-9]+-[0-9]+$", "")
    return bm25.postings(chunks_of(files), "chunk", "tok").withColumn("path", path)


class StoredIndex(Index):
    """Index over three stores in a folder. refresh brings them up to date with a source tree: only
    changed files are read again, or all of them if most changed; a search reads
    the postings of its terms only, and stored vectors."""

    def __init__(
        self, spark: SparkSession, path: str, settings: Settings | None = None, reranker: Callable | None = None,
        vector: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 16, log: str | None = None,
    ) -> None:
        self.spark, self.settings, self.reranker, self.log = spark, settings or Settings(), reranker, log
        self.vector = vector or (lambda df: df.withColumn("vector", made_once(hashed_vector(F.col("text")))))
        path = path.rstrip("/")
        self.stores = {
            "chunks": Store(spark, f"{path}/chunks", _chunk_rows, buckets=buckets),
            "bm25": Store(spark, f"{path}/postings", _posting_rows, buckets=buckets, order=("term",)),
        }
        if self.settings.enabled:
            rows = lambda f: self.vector(chunks_of(f).select("path", "chunk", "text")).drop("text")
            self.stores["semantic"] = Store(spark, f"{path}/vectors", rows, model=self.settings.embed_model, buckets=buckets)

    @property
    def chunks(self) -> DataFrame:
        return self.stores["chunks"].table()

    def stale(self, files: DataFrame) -> bool:
        return any(s.stale(files.select("path", "mtime")) for s in self.stores.values())

    def refresh(self, files: DataFrame, force: bool = False) -> dict[str, dict]:
        """files: path, text, lang, mtime. What was done to each store (mode, files, chunks), each told to the log."""
        build = lambda s: lambda: s.refresh(files, force)
        return {k: telemetry.recorded(self.spark, self.log, k, build(s)) if self.log else build(s)() for k, s in self.stores.items()}

    def bm25(self, query: str, limit: int = 10, lang: str | None = None, path: str | None = None) -> DataFrame:
        where, chunks = self._where(lang, path), self.chunks
        among = None if where is None else chunks.where(where)
        found = bm25.search_postings(self.stores["bm25"].table(), chunks.select("chunk", "dl"), query, "chunk", limit, among)
        return chunks.select("chunk", "path", "start", "end", "lang", "text").join(F.broadcast(found), "chunk").orderBy(F.desc("score"), "chunk")

    def dense(self, query: str, limit: int, lang: str | None = None, path: str | None = None) -> DataFrame:
        where = self._where(lang, path)
        rows = self.stores["semantic"].table()
        if where is not None:
            rows = rows.join(self.chunks.where(where).select("chunk"), "chunk", "left_semi")
        q = self.vector(self.spark.range(1).select(F.lit(query).alias("text"))).select(F.col("vector").alias("qvec"))
        return fusion.dense_topk(rows, q, "chunk", "vector", limit)
