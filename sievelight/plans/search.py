"""Search API: an index over texts or a source tree, BM25 and hybrid, with a trace."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.text import local_url, made_once, runs
from sievelight.operators import bm25, fusion
from sievelight.operators.chunking import chunk_files, chunk_id, chunk_tokens

DIM = 64


@dataclass(frozen=True)
class Settings:
    """Fixed defaults of a hybrid search."""

    enabled: bool = True
    bm25_candidates: int = 50
    dense_candidates: int = 50
    rerank_topn: int = 10
    rerank_threshold: float = 0.0
    rrf_k: int = 60
    context: int = 10
    embed_url: str = ":8081/v1/embeddings"
    rerank_url: str = ":8082/v1/rerank"
    embed_model: str = "bge-small"
    rerank_model: str = "bge-reranker"
    timeout_secs: int = 120
    embed_batch: int = 16

    def overlaid(self, **given: object) -> Settings:
        """With the given values; empty strings and zeros don't override, but a threshold always does."""
        return replace(self, **{k: v for k, v in given.items() if v is not None and (k in ("rerank_threshold", "enabled") or v not in ("", 0))})


def hashed_vector(text: Column, dim: int = DIM) -> Column:
    """A bag of words hashed to dim counts: a deterministic stand-in for an embedding model."""
    buckets = F.transform(runs(F.lower(text)), lambda w: F.pmod(F.ascii(w) * 7 + F.char_length(w) * 31 + F.ascii(F.right(w, F.lit(1))) * 3, F.lit(dim)))
    # One array, counted dim times by native scans; the outer array holds it once.
    return F.transform(F.array(buckets), lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: (F.size(own) - F.size(F.array_remove(own, b))).cast("double")))[0]


def overlap_score(text: Column, query: str) -> Column:
    """The share of a query's terms in a text, less a half: a stand-in for a reranker."""
    terms = sorted({t for t in query.lower().split() if t})
    hits = [F.when(F.contains(F.lower(text), F.lit(t)), 1.0).otherwise(0.0) for t in terms]
    return sum(hits[1:], hits[0]) / len(hits) - 0.5 if hits else F.lit(0.0)


class HttpEmbedder:
    """Embeddings from a server, in batches; a rejected batch is sent text by text, an
    over-long text is halved until accepted or below 64 bytes. No connection is an error."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings

    def _post(self, texts: list[str]) -> list[list[float]] | None:
        url = f"http://localhost{self.s.embed_url}" if self.s.embed_url.startswith(":") else self.s.embed_url
        body = json.dumps({"model": self.s.embed_model, "input": texts}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.s.timeout_secs) as r:
                return [x["embedding"] for x in json.load(r)["data"]]
        except urllib.error.HTTPError:
            return None

    def one(self, text: str) -> list[float]:
        while (found := self._post([text])) is None:
            if len(text.encode()) <= 64:
                raise RuntimeError("the embedding server rejects a text of 64 bytes")
            text = text[: len(text) // 2]
        return found[0]

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), self.s.embed_batch):
            batch = texts[k : k + self.s.embed_batch]
            out += self._post(batch) or [self.one(t) for t in batch]
        return out


class HttpReranker:
    """Scores from a server, one for each text; a text that the answer leaves out has none."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings

    def __call__(self, query: str, texts: list[str]) -> list[float | None]:
        url = f"http://localhost{self.s.rerank_url}" if self.s.rerank_url.startswith(":") else self.s.rerank_url
        body = json.dumps({"model": self.s.rerank_model, "query": query, "documents": texts}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=self.s.timeout_secs) as r:
            found = {x["index"]: x["relevance_score"] for x in json.load(r)["results"]}
        return [found.get(k) for k in range(len(texts))]


def reranked(hits: DataFrame, query: str, rerank: Callable[[str, list[str]], list[float | None]], text_col: str = "text", out: str = "score") -> DataFrame:
    """hits (a hundred or so, brought to one partition) with a scorer's score for each."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(rerank(query, b.tolist()), dtype="float64")

    return hits.coalesce(1).withColumn(out, scores(F.col(text_col)))


def embedded(df: DataFrame, text_col: str, embed: Callable[[list[str]], list[list[float]]], out: str = "vector") -> DataFrame:
    """df with a vector for each text, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(embed(b.fillna("").tolist()))

    return df.withColumn(out, vectors(F.col(text_col)))


class Index:
    """Ranked search over chunks (path, start, end, text, lang, breadcrumb)."""

    def __init__(
        self, chunks: DataFrame, settings: Settings | None = None, vectors: DataFrame | None = None, reranker: Callable[[str, list[str]], list[float | None]] | None = None
    ) -> None:
        self.settings, self.reranker = settings or Settings(), reranker
        self.chunks = chunks.withColumn("chunk", chunk_id(F.col("path"), F.col("start"), F.col("end")))
        self.vectors = vectors

    @classmethod
    def of_files(cls, files: DataFrame, definitions: DataFrame, settings: Settings | None = None) -> Index:
        """Of source files (path, text, lang) and their definitions."""
        chunks = chunk_files(files.select("path", "text"), definitions)
        return cls(chunks.join(files.select("path", "lang"), "path"), settings)

    @staticmethod
    def _where(lang: str | None, path: str | None) -> Column | None:
        where = None
        if lang:
            where = F.col("lang") == lang.lower()
        if path and path.strip():
            held = F.contains("path", F.lit(path))
            where = held if where is None else where & held
        return where

    def bm25(self, query: str, limit: int = 10, lang: str | None = None, path: str | None = None) -> DataFrame:
        tokens = self.chunks.withColumn("_tok", chunk_tokens(F.col("text"), F.coalesce("breadcrumb", F.lit(""))))
        return bm25.search(tokens, query, "chunk", "_tok", limit, self._where(lang, path), ("path", "start", "end", "lang", "text"))

    def dense(self, query: str, limit: int, lang: str | None = None, path: str | None = None) -> DataFrame:
        spark = self.chunks.sparkSession
        where = self._where(lang, path)
        rows = self.chunks if where is None else self.chunks.where(where)
        if self.vectors is None:
            rows, q = rows.select("*", made_once(hashed_vector(F.col("text"))).alias("_v")), spark.range(1).select(made_once(hashed_vector(F.lit(query))).alias("qvec"))
        else:
            rows, q = rows.join(self.vectors.withColumnRenamed("vector", "_v"), "chunk"), embedded(spark.createDataFrame([(query,)], "text string"), "text", HttpEmbedder(self.settings), "qvec")
        return fusion.dense_topk(rows, q, "chunk", "_v", limit)

    def search(self, query: str, limit: int = 10, lang: str | None = None, path: str | None = None, mode: str = "hybrid") -> DataFrame:
        """Hits: path, start, end, lang, score, text. hybrid fuses BM25 and dense candidates,
        narrows them to the lines around their match, and puts what the scorer accepts first."""
        if mode == "bm25" or (mode == "hybrid" and not self.settings.enabled):
            if mode == "hybrid":
                raise ValueError("hybrid search is disabled")
            return self.bm25(query, limit, lang, path).drop("chunk")
        s = self.settings
        lexical = fusion.ranked(self.bm25(query, s.bm25_candidates, lang, path).select("chunk", "score"), "score", "chunk")
        dense = fusion.ranked(self.dense(query, s.dense_candidates, lang, path), "score", "chunk")
        fused = fusion.fuse(lexical, dense, ["chunk"])  # a hundred rows at most
        hits = self.chunks.select("chunk", "path", "start", "end", "lang", "text").join(F.broadcast(fused), "chunk")
        hits = fusion.rerank_window(hits, "text", "start", F.lit(query), s.context)
        hits = reranked(hits, query, self.reranker) if self.reranker else hits.withColumn("score", overlap_score(F.col("text"), query))
        chosen = fusion.select_survivors(hits, "score", "place", fusion.wanted_rows(limit, s.rerank_topn), s.rerank_threshold)
        return chosen.select("path", "start", "end", "lang", "score", "text")

    def batch(self, queries: DataFrame, k: int, mode: str) -> DataFrame:
        """For an evaluation: q, hits, ms and error of every query (few) in a mode."""
        rows = []
        for (q,) in queries.select("q").collect():
            found, event = self.traced(q, mode, limit=k)
            rows.append((q, [(h.path, h.start, h.end) for h in found], event.get("total_ms"), event.get("error")))
        return self.chunks.sparkSession.createDataFrame(rows, "q string, hits array<struct<path: string, start: bigint, end: bigint>>, ms long, error string")

    def traced(self, query: str, mode: str = "hybrid", **options: object) -> tuple[list, dict]:
        """The hits as rows, and an event for telemetry."""
        began = time.time()
        event = {"kind": "search", "mode": mode, "query": query}
        try:
            rows = self.search(query, mode=mode, **options).collect()
        except Exception as e:
            return [], event | {"error": str(e)[:200]}
        return rows, event | {"total_ms": int((time.time() - began) * 1000), "results": len(rows), "fallback": False}


def endpoint(spark: SparkSession, url: str) -> str:
    return spark.range(1).select(local_url(F.lit(url)).alias("u")).first().u
