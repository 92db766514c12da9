"""Exact dedup by two-pass Bloom filtering (native DataFrame functions only).

Pass 1: each task sets one bit a row in a sparse bit array for each hash range, once or
again (two states a bit), and the tasks' arrays are merged range by range; the
bits that were set again, by one task or by two, are the filter. Pass 2 looks
every row up in it: a row whose bit was set once has a unique text and passes
straight through; only the others shuffle by their digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import SPACE, attach, materialise, small, table, text_or_empty

#: Bits for each row, and the rows of a task that share a range on average. Ranges
#: and bits grow with the rows: the filter takes unique rows for suspects at one rate
#: (one in BITS_PER_ROW), whatever their number.
BITS_PER_ROW, CELL_ROWS = 64, 32


def _again(bits: Column) -> Column:
    """The bits that a sorted array has more than once, once each."""
    twice = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x)))
    return F.transform(F.array(F.sort_array(bits)), twice)[0]


def repeated_bits(rows: DataFrame, range_bits: int) -> DataFrame:
    """(word, bits): the 64-bit words of the bits that two rows or more set; rows: range, bit.

    A task's array holds each bit that it set as a number, and those that it set again
    once more, so that a text with many copies takes two numbers of a task.
    """
    cells = rows.withColumn("task", F.spark_partition_id()).groupBy("range", "task").agg(F.collect_list("bit").alias("bits"))
    cells = cells.select("range", F.concat(F.array_distinct("bits"), _again(F.col("bits"))).alias("bits"))
    merged = cells.groupBy("range").agg(F.flatten(F.collect_list("bits")).alias("bits"))
    again = merged.select("range", F.explode(_again(F.col("bits"))).alias("bit"))
    again = again.select((F.col("range") * F.lit(range_bits) + F.col("bit")).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    return again.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(one).alias("bits"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, row_hash (of the
    text as it is, to tell rows with one id apart).

    Texts are equal when identical after deleting ASCII white space. Null texts
    count as empty and equal each other. Of equal texts the one with the most
    code points, then the smallest id stays; a null id comes after all others.
    Rows that repeat an id and its text are one document: all of them carry the
    same keep_id and all are kept if their id is. Other columns are not read.
    An empty table gives an empty result.
    """
    text = text_or_empty(F.col(text_col))
    digests = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(F.regexp_replace(text, f"[{SPACE}]+", ""), 256)).alias("digest"),
            F.char_length(text).cast("long").alias("n_points"),
            F.xxhash64(text).alias("row_hash"),
        ),
        "digests",
    )
    n, n_tasks = digests.select(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)), F.coalesce(F.max("task") + 1, F.lit(1))).first()
    n_ranges = max(1, n // n_tasks // CELL_ROWS)
    range_bits = -(-max(1, n) * BITS_PER_ROW // n_ranges)
    placed = digests.withColumn("range", F.pmod(F.xxhash64("digest"), F.lit(n_ranges)).cast("long")).withColumn(
        "bit", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(range_bits)).cast("int")
    )
    words = materialise(repeated_bits(placed.select("range", "bit"), range_bits), "bits")
    # The filter is broadcast if it is small; of a larger one rows meet their word by a
    # shuffle of what digests holds, the texts stay where they are.
    p = F.col("range") * F.lit(range_bits) + F.col("bit")
    probed = placed.withColumn("p", p).withColumn("word", F.shiftright("p", 6)).join(small(words, words.count()), "word", "left")
    hit = F.coalesce(F.getbit("bits", F.col("p").bitwiseAND(63).cast("int")), F.lit(0)) == 1
    probed = materialise(probed.select("id", "digest", "n_points", "row_hash", hit.alias("suspect")), "suspects")

    unique = probed.where("not suspect").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest", "row_hash"
    )
    suspects = probed.where("suspect").drop("suspect")
    groups = suspects.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct(-F.col("n_points"), F.col("id").isNull(), F.col("id"))).alias("best"),
    ).select("digest", "group_size", F.col("best.id").alias("keep_id"))
    found = attach(suspects, groups, "digest", "group_size", n)
    return unique.unionByName(found.select("id", "keep_id", "group_size", "digest", "row_hash")).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_hash",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row_hash")


SQL = r"""
WITH h AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLE_SQL = {"op3_exact_dedup": SQL}
