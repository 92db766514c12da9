"""Joins of symbols: nesting by line ranges, references, importers, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(inner: DataFrame, outer: DataFrame, inner_id: str) -> DataFrame:
    """inner rows (path, line, inner_id) with the first outer row (path, outer_id, start,
    end; by start, end, id) whose lines hold them. An equi-join on the file with a range
    condition; each inner row keeps one match by a partial aggregate."""
    i, o = inner.alias("i"), outer.select("path", "outer_id", "start", "end").alias("o")
    both = i.join(o, (F.col("i.path") == F.col("o.path")) & F.col("i.line").between(F.col("o.start"), F.col("o.end"))).select("i.*", "o.outer_id", "o.start", "o.end")
    rest = [c for c in inner.columns if c not in ("path", inner_id)]
    best = F.min(F.struct("start", "end", "outer_id", *rest))
    found = both.groupBy("path", inner_id).agg(best.alias("b"))
    return found.select("path", inner_id, *[F.col(f"b.{c}").alias(c) for c in rest], F.col("b.outer_id").alias("outer_id"))


def orphans(inner: DataFrame, outer: DataFrame, inner_id: str) -> DataFrame:
    """inner rows that no outer row holds."""
    held = (F.col("i.path") == F.col("o.path")) & F.col("i.line").between(F.col("o.start"), F.col("o.end"))
    return inner.alias("i").join(outer.alias("o"), held, "left_anti")


def references_only(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """References without those on a definition's own line."""
    return references.join(definitions.select("path", "line").distinct(), ["path", "line"], "left_anti")


def by_parent(functions: DataFrame, types: DataFrame) -> DataFrame:
    """functions (name, parent) with belongs: 'type' if the parent is a known type's name,
    'other' if it isn't, 'none' without a parent."""
    known = types.select(F.col("name").alias("parent")).distinct().withColumn("_known", F.lit(True))
    belongs = F.when(F.col("parent").isNull(), "none").when(F.col("_known"), "type").otherwise("other")
    return functions.join(known, "parent", "left").withColumn("belongs", belongs).drop("_known")


def importers(edges: DataFrame, symbol: str, boundary: bool = False) -> DataFrame:
    """Distinct sources whose target ends with the symbol; with boundary at a path's segment only."""
    ends: Column = F.endswith("target", F.lit(symbol))
    if boundary:
        before = F.substring("target", F.char_length("target") - len(symbol), F.lit(1))
        ends = ends & ((F.char_length("target") == len(symbol)) | before.isin(":", ".", "/", "\\"))
    return edges.where(ends).select("source").distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.distinct().groupBy("target").agg(F.count(F.lit(1)).alias("importers"))


def groups(definitions: DataFrame) -> DataFrame:
    """Per name the sorted distinct kinds and the number of definitions."""
    return definitions.groupBy("name").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.count(F.lit(1)).alias("count"))


def dangling(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose target no known source answers to."""
    return edges.join(known.select(F.col("name").alias("target")).distinct(), "target", "left_anti")
