"""Texts into line chunks: overlapping windows, definition regions, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_LINES, OVERLAP = 64, 8


def effective_lines(text: Column) -> Column:
    """A text's lines; the one empty tail after a trailing line feed isn't one, and an
    empty text has none."""
    lines = F.split(text, "\n")
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", none).when(F.endswith(text, F.lit("\n")), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def window_starts(lo: Column, hi: Column, size: int = WINDOW_LINES, overlap: int = OVERLAP) -> Column:
    """First lines of overlapping windows over lines lo to hi; the last one reaches hi."""
    step = size - overlap
    starts = F.sequence(lo, hi, F.lit(step))
    needed = F.filter(starts, lambda s: (s == lo) | (s - step + size - 1 < hi))
    return F.when(lo <= hi, needed).otherwise(F.array().cast("array<int>"))


def windows(regions: DataFrame, lines_col: str, lo: str, hi: str, size: int = WINDOW_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Explodes each region (lines lo to hi of an array column) to its windows: start, end, text."""
    cut = regions.where(F.col(lo) <= F.col(hi)).withColumn("start", F.explode(window_starts(F.col(lo), F.col(hi), size, overlap)))
    cut = cut.withColumn("end", F.least(F.col("start") + size - 1, F.col(hi)))
    text = F.array_join(F.slice(lines_col, F.col("start"), F.col("end") - F.col("start") + 1), "\n")
    return cut.withColumn("text", text).withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))


def window_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole texts as windows, untrimmed: id, start, end, text."""
    lines = docs.select(F.col(id_col), effective_lines(F.col(text_col)).alias("_lines"))
    lines = lines.withColumn("_lo", F.lit(1)).withColumn("_hi", F.size("_lines"))
    return windows(lines, "_lines", "_lo", "_hi").select(id_col, "start", "end", "text")


def outer_regions(regions: DataFrame, id_col: str) -> DataFrame:
    """Regions (id, start, end) without those inside an earlier one: in order of (start,
    end) one stays if its end is beyond all ends before."""
    order = Window.partitionBy(id_col).orderBy("start", "end", *[c for c in regions.columns if c not in (id_col, "start", "end")])
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return regions.withColumn("_before", before).where("_before is null or end > _before").drop("_before")


def gaps(regions: DataFrame, lengths: DataFrame, id_col: str) -> DataFrame:
    """The line ranges (id, start, end) that outer regions leave: before, between and after
    them; all lines of an id without a region. lengths: id, n_lines."""
    order = Window.partitionBy(id_col).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    between = regions.select(F.col(id_col), (reach + 1).cast("long").alias("start"), (F.col("start") - 1).cast("long").alias("end"))
    last = regions.groupBy(id_col).agg(F.max("end").alias("_last"))
    tail = lengths.join(last, id_col, "left").select(
        F.col(id_col), (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("start"), F.col("n_lines").cast("long").alias("end")
    )
    return between.unionByName(tail).where("start <= end")


def trimmed(ranges: DataFrame, lines_col: str, lo: str = "start", hi: str = "end") -> DataFrame:
    """Ranges of lines cut to their first and last line that isn't blank; blank ones go."""
    filled = F.filter(F.sequence(F.col(lo).cast("int"), F.col(hi).cast("int")), lambda i: F.trim(F.element_at(F.col(lines_col), i)) != "")
    cut = ranges.withColumn("_filled", filled).where(F.size("_filled") > 0)
    return cut.withColumn(lo, F.array_min("_filled").cast("long")).withColumn(hi, F.array_max("_filled").cast("long")).drop("_filled")


def chunk_files(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """Chunks of source files: path, start, end, text, breadcrumb.

    files: path, text. definitions: path, name, start, end, parent. Top-level
    definitions are chunks with their name as breadcrumb, long ones in windows;
    lines between them, without blank edges, are anonymous ones. A file without a
    definition is cut to windows as it is.
    """
    lines = files.select("path", effective_lines(F.col("text")).alias("_lines"))
    top = outer_regions(definitions.where("parent is null").select("path", "start", "end", "name"), "path").withColumnRenamed("name", "breadcrumb")
    lengths = lines.select("path", F.size("_lines").alias("n_lines"))
    known = top.select("path").distinct()
    free = gaps(top, lengths.join(known, "path", "left_semi"), "path").withColumn("breadcrumb", F.lit(None).cast("string"))
    whole = lengths.join(known, "path", "left_anti").select("path", F.lit(1).cast("long").alias("start"), F.col("n_lines").cast("long").alias("end"), F.lit(None).cast("string").alias("breadcrumb"))
    free = trimmed(free.join(lines, "path"), "_lines")
    named = top.select("path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "breadcrumb").unionByName(whole).join(lines, "path")
    ranges = named.unionByName(free).withColumn("_lo", F.col("start").cast("int")).withColumn("_hi", F.least(F.col("end").cast("int"), F.size("_lines"))).drop("start", "end")
    return windows(ranges, "_lines", "_lo", "_hi").select("path", "start", "end", "text", "breadcrumb")


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def chunk_tokens(text: Column, breadcrumb: Column) -> Column:
    """What the index reads of a chunk: its breadcrumb before its text."""
    return F.concat_ws("\n", F.when(breadcrumb != "", breadcrumb), text)
