"""Near-duplicate classes by SetSketch registers.

A document's sketch holds, for each of M hash functions, the least hash value
of its shingles as an exponential variable, truncated to powers of BASE
(Ertl's SetSketch). Registers are mergeable (by maximum) and locality-sensitive:
bands of ROWS registers propose candidates, the joint likelihood of two
sketches estimates their similarity, and links are confirmed on full sets.

Documents with equal sets form one class and enter the search once. Within a
band's bucket all classes are held against one centre, drawn anew for each
bucket, never each against each. What this leaves apart inside a family
of classes that share buckets is settled by holding every class outside the
family's largest component against all of the family, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm.bytesops import frugal, mix64
from sievelight.llm.common import attach, materialise, only, ship, small, table
from sievelight.llm.graph import connected_components
from sievelight.llm.shingles import shingle_sets

#: Registers, bands of ROWS registers, base, rate and highest register value. A
#: link of similarity 0.75 shares no band with a probability of 5e-6.
M, BANDS, ROWS, BASE, RATE, TOP = 128, 32, 4, 1.02, 20.0, 1022
#: Similarity in per cent; below MAYBE the estimate (deviation 0.04 at 0.75)
#: isn't confirmed on full sets; below KIN two classes aren't of one family.
PERCENT, SURE, MAYBE, KIN = 75, 0.8, 0.55, 0.3
#: Shingles of a family's block, and what a class counts besides its own: a task holds
#: two blocks (8 bytes a shingle) of at most BLOCK / CLASS classes, or a single larger class.
BLOCK, CLASS = 1 << 17, 512

_rng = np.random.Generator(np.random.PCG64(77))
_FACTOR = (_rng.integers(0, 2**31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFT = _rng.integers(0, 2**32, M, dtype=np.uint32)[:, None]


def registers(hashes: np.ndarray) -> np.ndarray:
    """The M registers of a set of 64-bit hashes."""
    least = np.full(M, 2**32 - 1, np.uint32)
    h = (mix64(hashes) >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), 2048):
        x = _FACTOR * h[None, k : k + 2048]
        x += _SHIFT
        np.minimum(least, x.min(axis=1), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest joint likelihood of pairs of sketches (rows of a
    and b) of sets of known sizes, from the counts of greater, less and equal registers."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * most[:, None]
    p = np.clip(_share(u[:, None] - v[:, None] * grid), 1e-9, 1)
    q = np.clip(_share(v[:, None] - u[:, None] * grid), 1e-9, 1)
    rest = np.clip(1 - p - q, 1e-9, 1)
    score = above[:, None] * np.log(p) + below[:, None] * np.log(q) + (M - above - below)[:, None] * np.log(rest)
    return grid[np.arange(len(grid)), score.argmax(1)]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of PERCENT or more."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


@frugal
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, fa, fb, regs = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            fa.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
            fb.append(int(mix64(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).astype(np.int64)))
            regs.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(regs, pa.binary())],
            ["id", "n", "fa", "fb", "regs"],
        )


@frugal
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, done = 0, []

        def flush(at: int, done: list, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(done)), pa.array(done, pa.binary())], ["id", "items"])

        size = 0
        for s in shingle_sets(batch.column(1)):
            done.append(s.tobytes())
            size += 8 * len(s)
            if size > 1 << 23:
                yield flush(at, done)
                at, done, size = at + len(done), [], 0
        if done:
            yield flush(at, done)


@frugal
def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in (2, 3))
            n_a, n_b = (part.column(c).to_numpy().astype(float) for c in (4, 5))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(estimate(a, b, n_a, n_b))], ["a", "b", "likely"])


@frugal
def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        good = [linked(np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64)) for k in range(batch.num_rows)]
        good = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["u", "v"])


def _settled(group: pa.Table) -> pa.Table:
    """Links between a block's classes and its strays, for each stray and other component one."""
    regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, M)
    items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
    n = np.array([len(x) for x in items], float)
    ids, comp = group.column("id"), group.column("component").to_pylist()
    stray = np.array(group.column("stray").to_pylist(), bool)
    of = np.unique(np.array([str(c) for c in comp]), return_inverse=True)[1]
    members, u, v = np.flatnonzero(~stray), [], []
    for s in np.flatnonzero(stray):
        near = members[(of[members] != of[s]) & (np.minimum(n[members], n[s]) * 100 >= PERCENT * np.maximum(n[members], n[s]))]
        if not len(near):
            continue
        likely = estimate(regs[near], np.broadcast_to(regs[s], (len(near), M)), n[near], np.full(len(near), n[s]))
        done: set[int] = set()
        for k in near[np.argsort(-likely)][: int((likely >= MAYBE).sum())]:
            if of[k] not in done and linked(items[s], items[k]):
                done.add(of[k])
                u.append(s)
                v.append(k)
    return pa.table({"u": ids.take(pa.array(u, pa.int64())), "v": ids.take(pa.array(v, pa.int64()))})


def _ids(id_type: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(x, id_type) for x in names]


def _confirm(pairs: DataFrame, sets: DataFrame, id_type: T.DataType) -> DataFrame:
    """The pairs (a, b) whose sets are linked, as (u, v)."""
    with_b = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
    return both.select("a", "b", "items_a", "items_b").mapInArrow(_confirmed, T.StructType(_ids(id_type, "u", "v")))


def _labelled(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """nodes (id, ...) with component: the one it has, else its own id."""
    return nodes.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Linked are documents whose sets of 5-word shingles (all words as one shingle
    if there are fewer) have a similarity of 0.75 or more; component_id is the
    smallest id that links reach. Null, empty and blank texts have no shingle
    and are linked with nothing. Rows that repeat an id are one document with
    several texts. A row with a null id is linked with nothing, its component_id
    is null and it is kept. Other columns are not read; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*_ids(id_type, "id"), *[T.StructField(x, T.LongType()) for x in ("n", "fa", "fb")], T.StructField("regs", T.BinaryType())])
    sketched = materialise(source.mapInArrow(_sketched, schema), "sketched")
    able = sketched.where("n > 0 and id is not null")
    classes = materialise(
        able.groupBy("fa", "fb", "n")
        .agg(F.min(F.struct("id", "regs")).alias("rep"), F.count(F.lit(1)).alias("copies"))
        .select("fa", "fb", "n", "copies", F.col("rep.id").alias("id"), F.xxhash64("rep.id").alias("h"), F.col("rep.regs").alias("regs")),
        "classes",
    )

    # Nodes go by a hash of their id here; h ^ key is another order of a bucket's
    # members for every bucket, and the first in that order is its centre.
    keyed = classes.select("h", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda k: F.xxhash64(k, F.substring(F.col("regs"), k * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )).alias("key"))
    turned = F.col("h").bitwiseXOR(F.col("key"))
    buckets = keyed.groupBy("key").agg(F.min(turned).alias("least"), F.max(turned).alias("most")).where("least != most")
    buckets = materialise(buckets.select("key", F.col("least").bitwiseXOR(F.col("key")).alias("centre")), "buckets", free=True)
    shared = keyed.join(small(buckets, buckets.count()), "key").where("h != centre")
    pairs = shared.select(F.least("h", "centre").alias("ha"), F.greatest("h", "centre").alias("hb")).distinct()
    side = lambda x: classes.select(F.col("h").alias(f"h{x}"), F.col("id").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n").alias(f"n_{x}"))
    sized = pairs.join(side("a"), "ha").join(side("b"), "hb").select("a", "b", "regs_a", "regs_b", "n_a", "n_b")
    schema = T.StructType([*_ids(id_type, "a", "b"), T.StructField("likely", T.DoubleType())])
    likely = materialise(sized.mapInArrow(_estimated, schema).where(F.col("likely") >= KIN), "likely", free=True)

    # Of each class two partners are confirmed: the likeliest, and of those that are
    # likely enough the one that most others share.
    involved = materialise(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
    texts = only(source.where("id is not null"), involved)
    schema = T.StructType([*_ids(id_type, "id"), T.StructField("items", T.BinaryType())])
    sets = materialise(texts.mapInArrow(_sets, schema).where("length(items) > 0"), "sets", free=True)
    test = likely.where(F.col("likely") >= MAYBE)
    both = test.select(F.col("a").alias("x"), F.col("b").alias("y"), "likely").unionByName(test.select(F.col("b").alias("x"), F.col("a").alias("y"), "likely"))
    hub = F.min(F.when(F.col("likely") >= SURE, F.struct(F.xxhash64("y"), F.col("y"))))
    best = both.groupBy("x").agg(F.max_by("y", "likely").alias("likeliest"), hub.alias("hub")).select("x", F.explode(F.array("likeliest", "hub.y")).alias("y"))
    best = best.where("y is not null").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = materialise(_confirm(best, sets, id_type), "links", free=True)
    parts = connected_components(links)

    ends = _labelled(likely.withColumnRenamed("a", "id"), parts).withColumnRenamed("id", "a").withColumnRenamed("component", "ca")
    cross = _labelled(ends.withColumnRenamed("b", "id"), parts).withColumnRenamed("id", "b").withColumnRenamed("component", "cb")
    strays = _settle(cross.where("ca != cb"), involved, parts, classes, sets, id_type)
    if not strays.isEmpty():
        parts = connected_components(links.unionByName(strays))

    of_class = _labelled(classes.select("id", "fa", "fb", "n", "copies"), parts).drop("id")
    found = attach(able.select("id", "n", "fa", "fb"), of_class, ["fa", "fb", "n"], "copies", sketched.count())
    alone = sketched.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    return found.select("id", "n", "component").unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def _settle(cross: DataFrame, involved: DataFrame, parts: DataFrame, classes: DataFrame, sets: DataFrame, id_type: T.DataType) -> DataFrame:
    """Links that join the components of one family of classes, found without fail:
    each class outside the family's largest component against all its classes."""
    kin = connected_components(cross.select(F.col("ca").alias("u"), F.col("cb").alias("v")))
    if kin.isEmpty():
        return kin.select(F.col("node").alias("u"), F.col("component").alias("v"))
    weighed = _labelled(involved, parts).join(classes.select("id", (F.col("n") + CLASS).alias("weight")), "id")
    family = weighed.join(kin.select(F.col("node").alias("component"), F.col("component").alias("family")), "component")
    size = family.groupBy("family", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))
    largest = size.groupBy("family").agg(F.max(F.struct("size", "component", "weight")).alias("most"), F.sum("weight").alias("all"))
    n_blocks = lambda w: F.ceil(w / BLOCK).cast("long")
    cut = largest.select("family", F.col("most.component").alias("main"), n_blocks(F.col("all")).alias("blocks"), n_blocks(F.col("all") - F.col("most.weight")).alias("s_blocks"))
    member = materialise(family.join(cut, "family"), "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    stray = member.where("component != main")
    # A family's blocks and its strays' blocks meet pairwise; a stray's row goes to every block.
    rows = member.withColumn("s_block", F.explode(F.expr("sequence(0L, s_blocks - 1)"))).withColumn("stray", F.lit(False))
    strays = stray.withColumn("s_block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("s_blocks")))
    strays = strays.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("stray", F.lit(True))
    keep = ["id", "component", "family", "block", "s_block", "stray"]
    ids = member.select("id").distinct()
    known = only(classes.select("id", "regs"), ids).join(only(sets, ids), "id")
    full = rows.select(*keep).unionByName(strays.select(*keep)).join(known, "id")
    found = full.groupBy("family", "block", "s_block").applyInArrow(_settled, T.StructType(_ids(id_type, "u", "v")))
    return materialise(found, "strays", free=True)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE_SQL: dict[str, str] = {}
