"""Mixing sources to target weights (native DataFrame functions only).

Each source's documents are dealt by a hash to buckets; a bucket's documents, in
a pseudorandom order, are packed into blocks of a fixed number of tokens. Every output
shard draws how many of its slots each source gets as a multinomial: the whole
parts of the expected counts are sure, the rest is drawn by the fractional parts
(residual sampling), so that the sums over the shards stay near the targets.
Slot q of a source takes block P(q mod n) of its n blocks, P being another
pseudorandom permutation for each pass over the source. Blocks join slots by
index, and each text is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm.common import FEW_KEYS, SPACE, attach, few_rows, held, materialise, small, table, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
#: Tokens of a block, most slots of an output shard, rounds of a permutation,
#: words of a bucket, slots made from one row at a time, rows of a prefix-sum's part.
BLOCK_TOKENS, SHARD_SLOTS, ROUNDS, BUCKET_WORDS, CHUNK, PART = 128, 8192, 12, 1 << 19, 1 << 14, 4096
#: Wanted slots are counted in these fractions, so that their sums are exact.
FRACTION = 1 << 16


def permuted(i: Column, n: Column, *keys: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 at i, by the swap-or-not shuffle
    (Hoang, Morris and Rogaway, 2012); keys choose the permutation."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *keys), n) - x, n)
        swap = F.xxhash64(r, F.greatest(x, other), *keys).bitwiseAND(F.lit(1)) == 0
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i.cast("long"), turn)


def running_sums(rows: DataFrame, group: list[str], at: str, cols: list[str], few: int | None = None) -> DataFrame:
    """rows with before_<col> for each of cols (whole numbers): its sum over the group's rows
    with a lesser at (whole numbers, distinct within a group), the lineage cut.

    Few rows are summed by the driver. Of more no task gets more than PART rows, or a
    row for each PART numbers, of one group: they are summed in two levels.
    """
    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"before_{c}", rows.schema[c].dataType) for c in cols]])
    own = few_rows(rows, few)
    if own is not None:
        sums, out = {}, []
        for r in sorted(own, key=lambda r: r[at]):
            before = sums.setdefault(tuple(r[g] for g in group), [type(r[c])(0) for c in cols])
            out.append((*r, *before))
            before[:] = [x + r[c] for x, c in zip(before, cols, strict=True)]
        return rows.sparkSession.createDataFrame(out, schema)
    wide = rows.withColumn("_part", F.expr(f"{at} div {PART}"))
    inside = Window.partitionBy(*group, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = wide.groupBy(*group, "_part").agg(*[F.sum(c).alias(c) for c in cols])
    heads = parts.select(*group, "_part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in cols])
    sums = wide.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in cols]).join(heads, [*group, "_part"])
    before = [(F.col(f"_{c}") + F.col(f"_in_{c}")).cast(rows.schema[c].dataType).alias(f"before_{c}") for c in cols]
    return materialise(sums.select(*rows.columns, *before), "sums")


def located(points: DataFrame, spans: DataFrame, total: float, n: int) -> DataFrame:
    """points (x, ...) joined with the span [lo, hi) of spans (lo, hi, ...) that holds x.

    Both meet by bin: the n spans that fill [0, total) lie in 2n of n equal bins at most,
    so that a point drawn evenly meets two spans on average, however unequal they are.
    """
    width = F.lit(float(total) / n)
    bins = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.least("hi", F.lit(float(total))) / width))))
    bins = small(bins, n)
    return points.withColumn("_bin", F.floor(F.col("x") / width)).join(bins, "_bin").where("lo <= x and x < hi").drop("_bin", "lo", "hi")


def even(*keys: Column) -> Column:
    """An evenly drawn number in [0, 1) from a hash of keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def source_targets(sources: DataFrame, share: float, cap: float, weights: Sequence[float], few: int | None = None) -> DataFrame:
    """sources (skey, source, source_size, ...) with idx and target.

    idx is the source's place by code point (null last), which gives its weight. target: share
    of all sizes by weight, at most cap times a source's size; the excess is dealt to the
    others by weight until none is above. Few sources are ordered by the driver, more
    by ranges; each round of dealing is one sum: nothing needs all sources in one task.
    """
    spark, schema = sources.sparkSession, T.StructType([*sources.schema.fields, T.StructField("idx", T.LongType())])
    rows = few_rows(sources, few)
    if rows is not None:
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python and Spark order text by code point
        s = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema)
    else:
        ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
        nth = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
        ranged = materialise(ranged.withColumn("_nth", nth), "sources")
        parts = running_sums(ranged.groupBy("_part").count().withColumn("_one", F.lit(0)), ["_one"], "_part", ["count"])
        s = ranged.join(F.broadcast(parts.select("_part", "before_count")), "_part")
        s = s.select(*sources.columns, (F.col("before_count") + F.col("_nth")).alias("idx"))
    table_of = F.array(*[F.lit(float(w)) for w in weights])
    weight = table_of[F.pmod("idx", F.lit(len(weights))).cast("int")]
    most = F.lit(float(cap)) * F.col("source_size")

    def dealt(rate: float) -> tuple[int, float, float]:
        """How many sources are full at a rate, what they get, and the weight of the others."""
        if rows is None:
            full = most <= F.lit(rate) * weight
            return s.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (full.cast("long"), F.when(full, most), F.when(~full, weight))]).first()
        own = [(cap * r["source_size"], float(weights[k % len(weights)])) for k, r in enumerate(rows)]
        full = [(m, w) for m, w in own if m <= rate * w]
        return len(full), sum(m for m, _ in full), sum(w for _, w in own) - sum(w for _, w in full)

    total = s.agg(F.sum("source_size")).first()[0] if rows is None else sum(r["source_size"] for r in rows)
    goal, rate, n_full = float(share) * (total or 0), -1.0, 0
    _, spent, open_ = dealt(rate)
    while open_:
        rate = (goal - spent) / open_
        n, spent, open_ = dealt(rate)
        if n == n_full:
            break
        n_full = n
    return s.withColumn("target", F.least(most, F.lit(rate) * weight) if open_ else most)


def _slots(targets: DataFrame, cap: float, seed: int) -> DataFrame:
    """(idx, skey, source, q, slot, shard, n_blocks): the slots of all shards, drawn by multinomials.

    targets: idx, skey, source, n_blocks, want (slots in FRACTIONs). q numbers a source's
    slots, each below cap times its blocks; slot numbers those of the mix.
    """
    spark = targets.sparkSession
    base = ["idx", "skey", "source", "n_blocks"]
    none = targets.limit(0).select(*base[:3], F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("shard"), "n_blocks")
    rows = few_rows(targets)
    targets = materialise(targets, "wanted") if rows is None else spark.createDataFrame(rows, targets.schema)
    all_want = targets.agg(F.sum("want")).first()[0] if rows is None else sum(r["want"] for r in rows)
    n_slots = all_want // FRACTION
    if not n_slots:
        return none
    shards = -(-n_slots // SHARD_SLOTS)
    size = n_slots // shards
    whole = F.lit(all_want).cast("decimal(20,0)")
    expected = F.lit(size).cast("decimal(18,0)") * F.col("want").cast("decimal(20,0)")
    t = targets.withColumn("sure", F.expr(f"(cast({size} as decimal(18,0)) * cast(want as decimal(20,0))) div cast({all_want} as decimal(20,0))"))
    t = t.withColumn("rest", (expected - F.col("sure").cast("decimal(18,0)") * whole).cast("decimal(38,0)")).withColumn("room", F.floor(F.lit(cap) * F.col("n_blocks")).cast("long"))
    t = running_sums(t.withColumn("one", F.lit(0)), ["one"], "idx", ["sure", "rest"])
    sure, n_rest, chunks = t.agg(F.sum("sure"), F.sum((F.col("rest") > 0).cast("long")), F.sum(F.ceil(F.col("sure") * shards / CHUNK))).first()
    drawn = size - sure

    # The sure slots: few small rows that grow to many, in a number of partitions that is given.
    made = t.where("sure > 0").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (sure * {shards}L - 1) div {CHUNK})")))
    made = made.repartition(max(1, min(int(chunks), 20_000)), "idx", "chunk")
    made = made.withColumn("q", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(sure * {shards}L, (chunk + 1) * {CHUNK}) - 1)")))
    made = made.select(*base, "q", F.expr("q div sure").alias("shard"), (F.col("before_sure") + F.expr("q % sure")).alias("i"))
    if drawn:
        # Each shard draws the others by the sources' fractional parts.
        edge = lambda c: (c / whole).cast("double")
        after = F.col("before_rest") + F.col("rest")
        last = after == F.lit(drawn).cast("decimal(18,0)") * whole
        spans = t.where("rest > 0").select(*base, "sure", "room", edge(F.col("before_rest")).alias("lo"), F.when(last, drawn + 1.0).otherwise(edge(after)).alias("hi"))
        points = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.expr(f"sequence(0L, {drawn - 1}L)")).alias("k"))
        points = points.withColumn("x", even(F.lit(seed), F.col("shard"), F.col("k")) * F.lit(float(drawn)))
        picks = located(points, spans, float(drawn), int(n_rest))
        counts = running_sums(picks.groupBy("idx", "shard").count(), ["idx"], "shard", ["count"])
        within = F.row_number().over(Window.partitionBy("idx", "shard").orderBy("k")) - 1
        picks = picks.withColumn("nth", within).join(counts, ["idx", "shard"])
        picks = held(picks.select(*base, "room", "shard", "k", (F.col("sure") * shards + F.col("before_count") + F.col("nth")).alias("q")), "picks")
        fits = picks.where("q < room").select(*base, "q", "shard", (F.lit(sure) + F.col("k")).alias("i"))
        made = made.unionByName(fits)
        over = picks.where("q >= room").select("shard", "k")
        if not over.isEmpty():
            # Draws beyond a source's room are drawn again from what room is left.
            used = picks.groupBy("idx").agg(F.count(F.lit(1)).alias("used"))
            left = t.join(used, "idx", "left").withColumn("first", F.col("sure") * shards + F.coalesce("used", F.lit(0)))
            left = left.withColumn("free", F.greatest(F.col("room") - F.col("first"), F.lit(0))).drop("before_sure", "before_rest")
            left = running_sums(left, ["one"], "idx", ["free"]).where("free > 0")
            total, n = left.agg(F.coalesce(F.sum("free"), F.lit(0)), F.count(F.lit(1))).first()
            numbered = running_sums(over.withColumn("one", F.lit(0)).withColumn("at", F.col("shard") * drawn + F.col("k")).withColumn("unit", F.lit(1)), ["one"], "at", ["unit"])
            numbered = numbered.where(F.col("before_unit") < total).withColumn("x", permuted(F.col("before_unit"), F.lit(total), F.lit(seed + 2)))
            spans = left.select(*base, "first", F.col("before_free"), F.col("before_free").alias("lo"), (F.col("before_free") + F.col("free")).alias("hi"))
            again = located(numbered, spans, float(total), int(n)) if total else None
            if again is not None:
                made = made.unionByName(again.select(*base, (F.col("first") + F.col("x") - F.col("before_free")).alias("q"), "shard", (F.lit(sure) + F.col("k")).alias("i")))
    slot = F.col("shard") * size + permuted(F.col("i"), F.lit(size), F.lit(seed + 3), F.col("shard"))
    return made.select(*base[:3], "q", slot.alias("slot"), "shard", "n_blocks")


def _plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: float = 2.0,
    weights: Sequence[float] = WEIGHTS,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 7,
    bucket_words: int = BUCKET_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed documents, placed documents with their text, slots); see mix_plan."""
    text = text_or_empty(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("skey"),
        F.size(F.array_remove(F.split(text, f"[{SPACE}]+"), "")).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("place"),
        text.alias("text"),
    )
    sized = materialise(rows.drop("text"), "sized")
    sources = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    sources = sources.withColumn("source", F.when(F.col("skey") != "n", F.expr("substring(skey, 2)")))
    sources = sources.withColumn("n_buckets", F.ceil((F.col("source_size") + 1) / F.lit(bucket_words)).cast("long"))
    targets = source_targets(sources, share, cap, weights)
    n_sources, n_docs = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_docs"), F.lit(0))).first()

    def bucketed(rows: DataFrame, *more: str) -> DataFrame:
        own = targets.select("skey", "idx", "source", "source_size", "target", "n_buckets", "source_docs")
        with_source = rows.join(F.broadcast(own), "skey") if n_sources <= FEW_KEYS else attach(rows, own, "skey", "source_docs", n_docs)
        return with_source.select("id", "source", "skey", "size", "source_size", "target", "place", *more, "idx", F.pmod("place", "n_buckets").alias("bucket"))

    blocks = F.ceil(F.col("bsize") / F.lit(block_tokens)).cast("long")
    buckets = bucketed(sized).groupBy("idx", "bucket").agg(F.sum("size").alias("bsize")).withColumn("b_blocks", blocks)
    buckets = running_sums(buckets, ["idx"], "bucket", ["b_blocks"])
    n_blocks = buckets.groupBy("idx").agg(F.sum("b_blocks").alias("n_blocks")).where("n_blocks > 0")
    want = F.round(F.col("target") * F.col("n_blocks") / F.col("source_size") * FRACTION).cast("long")
    slots = _slots(targets.join(n_blocks, "idx").select("idx", "skey", "source", "n_blocks", want.alias("want")), cap, seed)
    take = permuted(F.expr("q % n_blocks"), F.col("n_blocks"), F.lit(seed + 1), F.col("skey"), F.expr("q div n_blocks"))
    slots = slots.select("idx", "skey", "source", "slot", "shard", take.alias("block"))
    offsets = buckets.select("idx", "bucket", F.col("before_b_blocks").alias("boff"), "b_blocks")
    where = offsets.where("b_blocks > 0").select("idx", "bucket", F.explode(F.expr("sequence(boff, boff + b_blocks - 1)")).alias("block"))
    # Blocks and slots meet by index; both are slim, and Spark takes them for small.
    slots = slots.join(where.hint("merge"), ["idx", "block"])

    def placed(rows: DataFrame, *more: str) -> DataFrame:
        # Rows that tie have one id and one text.
        inside = Window.partitionBy("idx", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
        local = F.col("upto") - F.col("size")
        return (
            bucketed(rows, *more).withColumn("upto", F.sum("size").over(inside))
            .join(offsets.select("idx", "bucket", "boff"), ["idx", "bucket"])
            .select("id", "source", "skey", "size", "source_size", "target", (F.col("boff") * block_tokens + local).alias("start"), "idx", "bucket", *more)
        )

    return placed(sized), placed(rows.where("size > 0"), "text"), slots


def mix_plan(docs: DataFrame, id_col: str = "doc_id", **options) -> tuple[DataFrame, DataFrame]:
    """(placed documents, slots).

    placed: one row per input row: id, source, skey, size (words), source_size,
    target, start (its first word's place in the source's stream, in which a bucket
    begins with a block of its own).
    slots: slot (0.. in the mix), shard, skey, block, source; one row per block taken.

    A null text has size 0, a null source is a source of its own that comes last.
    Rows that repeat an id are separate documents; rows that repeat id and text are
    packed one after the other. Same input, same mix.
    """
    placed, _, slots = _plan(docs, id_col, **options)
    return placed, slots


def pieces(texts: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Placed documents cut at the bounds of blocks: idx, bucket, block, id, start, n (words), text
    (as it stands in the document, with the white space after its words)."""
    size = F.lit(block_tokens)
    # As many words before a text as its first block already has: then every block_tokens words are a piece.
    pad = (F.col("start") % size).cast("int")
    led = F.concat(F.repeat(F.lit("x "), pad), F.ltrim("text", F.lit(" \t\n\x0b\x0c\r")))
    parts = F.regexp_extract_all(led, F.lit(f"(?:[^{SPACE}]++[{SPACE}]*+){{1,{block_tokens}}}+"), F.lit(0))
    cut = texts.where("size > 0").select("idx", "bucket", "id", "start", "size", pad.alias("pad"), F.posexplode(parts).alias("k", "part"))
    block = F.expr(f"start div {block_tokens}") + F.col("k")
    n = F.least(F.col("start") + F.col("size"), (block + 1) * size) - F.greatest(F.col("start"), block * size)
    text = F.when(F.col("k") == 0, F.expr("substring(part, 2 * pad + 1)")).otherwise(F.col("part"))
    return cut.select("idx", "bucket", block.alias("block"), "id", "start", n.alias("n"), text.alias("text"))


def packed_blocks(texts: DataFrame, slots: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix: one row per slot: shard, slot, skey, source, block, pieces (start, id, n, text;
    in the order of the bucket; together block_tokens words, fewer in its last block).
    Texts stay in the partitions that their buckets were dealt to; the slots come to them."""
    parts = pieces(texts, block_tokens)
    blocks = parts.groupBy("idx", "bucket", "block").agg(F.sort_array(F.collect_list(F.struct("start", "id", "n", "text"))).alias("pieces"))
    return blocks.join(slots.hint("shuffle_hash"), ["idx", "bucket", "block"]).select("shard", "slot", "skey", "source", "block", "pieces")


def mixed_documents(placed: DataFrame, packed: DataFrame) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words
    that the packed rows hold of it, repeats counted)."""
    words = packed.select("skey", F.explode("pieces").alias("piece")).select("skey", "piece.start", "piece.n")
    taken = words.groupBy("skey", "start").agg(F.sum("n").alias("taken"))
    # Documents with words have starts of their own.
    held = placed.where("size > 0").join(taken.hint("merge"), ["skey", "start"], "left")
    same = ["id", "source", "size", "source_size", "target"]
    none = placed.where("size = 0").select(*same, F.lit(0).cast("long").alias("taken"))
    return held.select(*same, F.coalesce("taken", F.lit(0).cast("long")).alias("taken")).unionByName(none)


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> tuple[DataFrame, DataFrame]:
    """(placed documents, the mix as written): see mix_plan and packed_blocks."""
    spark, option = docs.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition"
    placed, texts, slots = _plan(docs, id_col, **options)
    packed = packed_blocks(texts, slots, options.get("block_tokens", BLOCK_TOKENS))
    # A bucket's blocks may be joined where the bucket is, though a block is asked for too.
    before = spark.conf.get(option)
    spark.conf.set(option, "false")
    try:
        return placed, materialise(packed, "mix", free=True, codec="zstd")
    finally:
        spark.conf.set(option, before)


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document what a mix to target weights takes of it, counted in the mix; see mixed."""
    return mixed_documents(*mixed(docs, id_col, **options)).withColumnRenamed("id", id_col)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLE_SQL: dict[str, str] = {}
