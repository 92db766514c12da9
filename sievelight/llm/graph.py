"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.bytesops import frugal
from sievelight.llm.common import materialise

#: Edges that one file (and one task that writes it) holds, and edges that one task joins alone.
FILE_EDGES, FEW_EDGES = 200_000, 1 << 20


@frugal
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges of a task, by union-find; ids are compared as Spark does."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in parts])
    kind = ends.type
    nodes, at = np.unique(ends.to_numpy(zero_copy_only=False), return_inverse=True)
    n_edges = len(at) // 2
    up = list(range(len(nodes)))
    for x, y in zip(at[:n_edges].tolist(), at[n_edges:].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    root = np.array(up)
    while (root != root[root]).any():
        root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[root], kind)], ["node", "component"])


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.select(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _stars(pairs: DataFrame) -> DataFrame:
    """Adds to each pair the least of u's partners. A hot u is pre-aggregated, and in
    the join back its pairs are split by Spark's skew join."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("least")), "u")


def connected_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) of all nodes in edges (u, v); component: the least node reachable.

    Loops and rows with nulls are left out; repeated edges count once. Up to few edges
    (counted first) are joined in one task. More are joined in rounds, each
    written to the shared folder; the rounds grow with the logarithm of the nodes.
    """
    e = edges.where("u is not null and v is not null and u != v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    now = _state(e)
    if 0 < now[0] <= few:
        kind = e.schema["u"].dataType.simpleString()
        return materialise(e.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"), "components")
    # Few edges make few files: the rows only get fewer from round to round.
    files = 1 + now[0] // FILE_EDGES
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _stars(both).where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        )
        large = materialise(large.coalesce(files), "large")
        small = _stars(large)
        small = small.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            small.select("u", F.col("least").alias("v"))
        ).distinct()
        e = materialise(small.coalesce(files), "edges")
        before, now = now, _state(e)
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
