"""A training corpus from documents: STAGES in order, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import materialise, small, table
from sievelight.llm.decontaminate import contamination
from sievelight.llm.exact_dedup import exact_dedup
from sievelight.llm.language_id import fold
from sievelight.llm.mixing import mix
from sievelight.llm.near_dedup import near_duplicates
from sievelight.llm.toxicity import annotated_sample, fit, scores


def _without(docs: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """docs whose key isn't in gone; rows with a null in the key stay."""
    gone = materialise(gone.distinct(), "gone")
    return docs.join(small(gone, gone.count()), key, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from annotated
    documents whose crc32(doc_id as text) modulo 5 isn't 0."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = fit(annotated_sample(docs.select("doc_id", "text"), labels))
    return scores(docs, model).where("predicted = 0").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document; rows that repeat both its id and its text are that
    document and stay, and so does a row without an id."""
    gone = exact_dedup(docs.select("doc_id", "text")).where("not kept").select("doc_id", "row_hash")
    keyed = docs.withColumn("row_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return _without(keyed, gone, ["doc_id", "row_hash"]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id, with all rows of that id; rows
    without an id are linked with nothing and stay."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id")
    return _without(docs, gone, ["doc_id"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the passages of the benchmark cut from their texts (n_chars
    follows); those with nothing else in them go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), cut=True)
    hit = F.size("spans") > 0
    left = found.where(~(hit & (F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")) == 0)))
    n_chars = F.when(hit, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of the sources to their target weights takes of each document: a row for
    each row of docs, repeated ones too."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("near-dedup", near),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Null and blank texts are documents like others (equal to
    each other, so one stays); empty tables give an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), free=True)
    return STAGES[-1][1](spark, docs, sf_dir)
