"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of LENGTH bytes around it also starts earlier. Every
window of LENGTH bytes is reached through its anchor, the K-byte gram of least
hash in it: equal windows have equal anchors. A run of windows with one anchor,
with the bytes they cover, is a context.

1. A pass over the texts emits (anchor, hash of the context, place); contexts
   equal to an earlier one of the same Arrow batch are settled on the spot.
2. Sorted by anchor, contexts equal to an earlier one are settled, anchors with
   one context only are done, and the others' contexts are fetched.
3. Contexts meet by anchor in blocks. A block's suffix array (prefix doubling)
   brings equal windows together; previous and next smaller positions in suffix
   order tell which windows have an earlier match (longest previous factor of
   LENGTH or more). An anchor with more contexts than a block holds is dealt to
   several; the windows that stay first in theirs are compared by hash: up to NEAR
   neighbours share one row, keyed by the bytes common to all of them.

Anchors with many different contexts are told from a sample of the texts and dealt
to several tasks by their contexts' hashes. That decides only where contexts
meet: results are the same whatever the sample holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm import bytesops
from sievelight.llm.bytesops import frugal, mix64
from sievelight.llm.common import materialise, only, ship, table, text_or_empty
from sievelight.llm.decontaminate import merged

#: Bytes of a repeat, of an anchor, of the windows worked on at a time, of a block's
#: contexts; neighbouring windows that go together where an anchor is split.
LENGTH, K, SLAB, BLOCK, NEAR = 100, 32, 1 << 19, 1 << 20, 8
#: Texts (about) of the sample; an anchor is hot with LEAST_HOT different contexts in it
#: or more, if they are at least one in HOT of the sample's contexts: fewer than HOT are.
SAMPLE_TEXTS, LEAST_HOT, HOT = 4096, 64, 4096
_PLACE = np.uint64((1 << 24) - 1)

MARKS = "rid bigint, first int, stop int"


def contexts(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first byte in the text, length, anchor, hash) of all contexts of some texts."""
    n_windows = len(body) - LENGTH + 1
    for a in range(0, max(0, n_windows), SLAB):
        part = body[a : a + SLAB + LENGTH - 1]
        n = len(part) - K + 1
        at = np.arange(n)
        gram = bytesops.word_hashes(part, at, at + K)
        least = (gram & ~_PLACE) | at.astype(np.uint64)
        wide, size = LENGTH - K + 1, 1
        while size * 2 <= wide:
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        rest = wide - size
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        where = np.arange(a, a + len(least))
        text = np.searchsorted(offsets, where, "right") - 1
        valid = where + LENGTH <= offsets[text + 1]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
        first, stop = np.flatnonzero(new), np.flatnonzero(last) + LENGTH
        place = (least[first] & _PLACE).astype(np.int64)
        h = mix64(bytesops.word_hashes(part, first, stop) + (place - first).astype(np.uint64))
        yield text[first], first + a - offsets[text[first]], stop - first, gram[place].view(np.int64), h.view(np.int64)


@frugal
def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = batch.column(0).to_numpy()
        data, offsets = bytesops.utf8(batch.column(1))
        found = []
        for lo, hi in bytesops.chunks(offsets):
            own = offsets[lo : hi + 1] - offsets[lo]
            found += [(x[0] + lo, *x[1:]) for x in contexts(data[offsets[lo] : offsets[hi]], own)]
        if not found:
            continue
        text, first, length, anchor, h = (np.concatenate(x) for x in zip(*found, strict=True))
        ids = rid[text]
        order = np.lexsort((first, ids)) if (np.diff(rid) < 0).any() else np.arange(len(ids))
        order = order[np.argsort((anchor ^ mix64(h.view(np.uint64)).view(np.int64))[order], kind="stable")]
        ids, first, length, anchor, h = ids[order], first[order], length[order], anchor[order], h[order]
        again = np.zeros(len(ids), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (h[1:] == h[:-1])
        for k in range(0, len(ids), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield _rows(again[s], anchor[s], h[s], ids[s], first[s], length[s])


def _rows(kind: np.ndarray, anchor: np.ndarray, h: np.ndarray, rid: np.ndarray, first: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Rows of kind 0 (a context), 1 (bytes that go) or 2 (a window that is first in its block)."""
    return pa.RecordBatch.from_arrays(
        [pa.array(kind.astype(np.int8)), pa.array(anchor), pa.array(h), pa.array(rid), pa.array(first.astype(np.int32)), pa.array(length.astype(np.int32))],
        _NAMES,
    )


ROWS = "kind tinyint, anchor bigint, h bigint, rid bigint, first int, length int"
_NAMES = ["kind", "anchor", "h", "rid", "first", "length"]


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, hash and place: repeated contexts go; the first of
    each context passes if its anchor has another one too (a hot one does, maybe elsewhere)."""
    at, seen, many, waiting = None, None, False, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        anchor, h, rid, first, length = (batch.column(x).to_numpy() for x in ("anchor", "h", "rid", "first", "length"))
        same = np.concatenate([[anchor[0] == at], anchor[1:] == anchor[:-1]])
        again = same & np.concatenate([[h[0] == seen], h[1:] == h[:-1]])
        group = np.cumsum(~same)  # 0: goes on from the last batch
        fresh = np.bincount(group[~again], minlength=group[-1] + 1)
        fresh[group[batch.column("salt").to_numpy() > 0]] += 2
        if group[0] == 0:
            if waiting and fresh[0]:
                yield waiting.pop()
                many = True
            if many or waiting:
                fresh[0] += 1 + many
        passes = ~again & (fresh[group] > 1)
        end = group[-1]
        if end or group[0] != 0:
            many, waiting = False, None
        if not many and fresh[end] > 1:
            many, waiting = True, None
        elif not many and not waiting:
            own = np.flatnonzero((group == end) & ~again)
            waiting = [_rows(np.zeros(1), *(x[own[:1]] for x in (anchor, h, rid, first, length)))] if len(own) else waiting
        at, seen = anchor[-1], h[-1]
        keep = again | passes
        if keep.any():
            yield _rows(again[keep], anchor[keep], h[keep], rid[keep], first[keep], length[keep])


@frugal
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts. Columns rid, text, wanted (anchor, salt, first, length)."""
    for batch in batches:
        data, offsets = bytesops.utf8(batch.column(1))
        wanted = batch.column(2)
        ends = np.asarray(wanted.offsets)
        ends = ends - ends[0]
        flat = wanted.flatten()
        anchor, salt, first, length = (np.asarray(flat.field(k)) for k in range(4))
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        rid = batch.column(0).to_numpy()[row]
        start = offsets[row] + first
        for k in range(0, len(row), 1 << 14):
            s = slice(k, k + (1 << 14))
            size = length[s].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(size)])
            index = np.arange(upto[-1]) + np.repeat(start[s] - upto[:-1], size)
            piece = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[s]), pa.array(salt[s]), pa.array(rid[s]), pa.array(first[s]), piece], ["anchor", "salt", "rid", "first", "piece"])


def suffix_ranks(text: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes by their first 64 bytes, by prefix doubling. runs numbers
    the contexts; a suffix ends with its context, so that it equals no longer one."""
    n = len(text)
    end = np.searchsorted(runs, runs, "right")  # the end of each suffix's context
    rank = text.astype(np.int64) + 1
    step = 1
    while step < 64:
        beyond = np.arange(step, n + step)
        next_rank = np.where(beyond < end, rank[np.minimum(beyond, n - 1)], 0)
        key = rank * (n + 257) + next_rank
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        step *= 2
    return rank


def previous_factors(text: np.ndarray, runs: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each suffix's longest previous factor has LENGTH bytes or more: whether
    its first LENGTH bytes also start at a smaller place. Suffixes of fewer bytes: False.

    In suffix order those with a common prefix of LENGTH bytes stand together;
    such a stretch holds an earlier match of a suffix if, before or after it, there
    is a smaller place (the previous and next smaller positions).
    """
    n = len(text)
    out = np.zeros(n, bool)
    end = np.searchsorted(runs, runs, "right")
    able = np.flatnonzero(np.arange(n) + LENGTH <= end)
    if not len(able):
        return out
    rank = suffix_ranks(text, runs)
    key = rank[able] * (n + 1) + rank[able + LENGTH - 64]
    order = able[np.argsort(key, kind="stable")]
    ordered = np.sort(key)
    stretch = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    # Minima that start anew with each stretch, from either side.
    span = int(place.max()) + 1
    forth = np.minimum.accumulate((stretch[-1] - stretch) * span + place[order]) - (stretch[-1] - stretch) * span
    back = np.minimum.accumulate((stretch * span + place[order])[::-1])[::-1] - stretch * span
    out[order] = (forth < place[order]) | (back < place[order])
    return out


MATCHED = ROWS + ", starts array<int>, hashes array<bigint>"


def _with_windows(rows: pa.RecordBatch, at: np.ndarray | None = None, starts: np.ndarray | None = None, hashes: np.ndarray | None = None) -> pa.RecordBatch:
    """rows with lists of windows: list k has the entries at[k] to at[k + 1]."""
    if at is None:
        at, starts, hashes = np.zeros(rows.num_rows + 1, int), np.zeros(0, int), np.zeros(0, np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (starts.astype(np.int32), hashes)]
    return pa.RecordBatch.from_arrays([*rows.columns, *lists], [*rows.schema.names, "starts", "hashes"])


def _survivors(
    text: np.ndarray, runs: np.ndarray, size: np.ndarray, start: np.ndarray, left: np.ndarray, where: np.ndarray, rid: np.ndarray, anchor: int
) -> Iterator[pa.RecordBatch]:
    """The windows (at the places left) of one anchor's contexts that are first in their block.

    Windows whose anchor stands NEAR * r to NEAR * r + NEAR - 1 bytes after their start
    share the bytes from there on; a row has those of one context, under a hash of
    these common bytes and r. Equal windows have equal keys.
    """
    if not len(left):
        return
    at = np.arange(len(text) - K + 1)
    gram = bytesops.word_hashes(text, at, at + K).view(np.int64)
    places = np.flatnonzero((gram == anchor) & (at + K <= (start + size)[runs[at]]))
    place = places[np.searchsorted(places, left)]
    r = (place - left) // NEAR
    new = np.concatenate([[True], (runs[left][1:] != runs[left][:-1]) | (r[1:] != r[:-1]) | (place[1:] != place[:-1])])
    cut = np.flatnonzero(new)
    shared = place[cut] - NEAR * r[cut]
    key = mix64(bytesops.word_hashes(text, shared, shared + LENGTH - NEAR + 1) + r[cut].astype(np.uint64)).view(np.int64)
    h = bytesops.word_hashes(text, left, left + LENGTH).view(np.int64)
    first = left[cut]
    rows = _rows(np.full(len(cut), 2), np.full(len(cut), anchor), key, rid[runs[first]], where[first], np.full(len(cut), LENGTH))
    yield _with_windows(rows, np.append(cut, len(left)), where[left], h)


def _matched(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def settle(rid: np.ndarray, first: np.ndarray, pieces: list[bytes], split: int | None) -> Iterator[pa.RecordBatch]:
        text = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        runs = np.repeat(np.arange(len(pieces)), size)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        inner = np.arange(len(text)) - start[runs]
        # Places: contexts in order of (rid, first); windows of one text are apart or the same.
        where = first[runs] + inner
        order = np.lexsort((where, rid[runs]))
        new = np.concatenate([[True], (rid[runs][order][1:] != rid[runs][order][:-1]) | (where[order][1:] != where[order][:-1])])
        place = np.empty(len(text), np.int64)
        place[order] = np.cumsum(new)
        goes = previous_factors(text, runs, place)
        able = inner + LENGTH <= size[runs]
        edge = goes & ~np.concatenate([[False], goes[:-1] & (runs[1:] == runs[:-1])])
        last = goes & ~np.concatenate([goes[1:] & (runs[1:] == runs[:-1]), [False]])
        a, b = np.flatnonzero(edge), np.flatnonzero(last)
        zero = np.zeros(len(a), np.int64)
        yield _with_windows(_rows(zero + 1, zero, zero, rid[runs[a]], where[a], b - a + LENGTH))
        if split is not None:
            yield from _survivors(text, runs, size, start, np.flatnonzero(able & ~goes), where, rid, split)

    @frugal
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # whole anchors
        done_size = 0
        now: list[tuple] = []  # of the anchor at hand
        now_size, at, split = 0, (None, 0), False

        def flush(rows: list[tuple], anchor: int | None) -> Iterator[pa.RecordBatch]:
            if rows:
                yield from settle(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], anchor)

        for batch in batches:
            for anchor, salt, rid, first, piece in zip(*(batch.column(x).to_pylist() for x in ("anchor", "salt", "rid", "first", "piece")), strict=True):
                if (anchor, salt) != at:
                    if split:
                        yield from flush(now, at[0])
                    else:
                        done += now
                        done_size += now_size
                    now, now_size, split, at = [], 0, salt > 0, (anchor, salt)
                    if done_size >= block:
                        yield from flush(done, None)
                        done, done_size = [], 0
                now.append((rid, first, piece))
                now_size += len(piece)
                if now_size >= block:
                    split = True
                    yield from flush(now, at[0])
                    now, now_size = [], 0
        if split:
            yield from flush(now, at[0])
        else:
            done += now
        yield from flush(done, None)

    return match


@frugal
def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: n_bytes, spans, kept text's hash. Columns rid, text, marks (first, stop)."""
    for batch in batches:
        data, offsets = bytesops.utf8(batch.column(1))
        marks = batch.column(2)
        ends = np.asarray(marks.offsets)
        ends = (ends - ends[0]).tolist()
        flat = marks.flatten()
        first, stop = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
        n_removed, n_spans, digests, spans = [], [], [], []
        for k in range(batch.num_rows):
            a, b = merged(first[ends[k] : ends[k + 1]], stop[ends[k] : ends[k + 1]])
            body = data[offsets[k] : offsets[k + 1]].tobytes()
            cuts = [0, *np.stack([a, b], 1).ravel().tolist(), len(body)]
            digest = hashlib.sha256()
            for x, y in zip(cuts[::2], cuts[1::2], strict=True):
                digest.update(body[x:y])
            n_removed.append(int((b - a).sum()))
            n_spans.append(len(a))
            digests.append(digest.hexdigest())
            spans.append([{"first": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        span = pa.struct([("first", pa.int64()), ("stop", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(span))],
            ["rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def hot_anchors(rows: DataFrame, n: int) -> DataFrame:
    """Anchors with many different contexts in a sample of the n rows, and how many tasks
    share each: (anchor, salts), fewer than HOT rows, kept by the driver."""
    sample = rows if n <= SAMPLE_TEXTS else rows.sample(SAMPLE_TEXTS / n, 5)
    met = sample.select("rid", "text").mapInArrow(_placed, ROWS).where("kind = 0")
    counts = met.select("anchor", "h").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("own"))
    summed = counts.agg(F.sum("own").alias("total"), F.collect_list(F.when(F.col("own") >= LEAST_HOT, F.struct("own", "anchor"))).alias("many")).first()
    hot = [(r.anchor, -(-r.own * HOT // summed.total)) for r in summed.many if r.own * HOT >= summed.total]
    return rows.sparkSession.createDataFrame(hot, "anchor bigint, salts bigint")


def _salted(contexts: DataFrame, hot: DataFrame) -> DataFrame:
    """contexts with salt: 0, or from 1 by the hash of a hot anchor's context."""
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.col("h"), F.col("salts")) + 1).otherwise(0).cast("int")
    return contexts.join(F.broadcast(hot), "anchor", "left").withColumn("salt", salt).drop("salts")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans
    (byte ranges [first, stop) that go).

    A byte goes if it lies in a string of 100 bytes that also starts earlier: in a
    row with a smaller id, or earlier in the same text. Null and empty texts have
    no bytes. Rows with equal ids are ordered by a hash of their texts, identical rows
    anyhow, and rows with a null id come last, so that the first copy stays. Other
    columns are not read; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    ids = rows.agg(F.count("id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    whole = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if whole and ids["n"] == ids["all"] and rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.select("id", F.col("id").cast("long").alias("rid"), "text")
    else:  # row numbers that grow with the id
        rows = materialise(rows.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text")).withColumn("rid", F.monotonically_increasing_id()), "rows")

    hot = hot_anchors(rows, ids["all"])
    placed = _salted(rows.select("rid", "text").mapInArrow(_placed, ROWS), hot)
    # Settled rows need no company; they are spread by their place.
    key = F.when(F.col("kind") == 0, F.col("anchor")).otherwise(F.xxhash64("rid"))
    met = placed.withColumns({"anchor": key, "salt": F.when(F.col("kind") == 0, F.col("salt")).otherwise(0)})
    met = met.repartition("anchor", "salt").sortWithinPartitions("kind", "anchor", "h", "rid", "first")
    sifted = materialise(met.mapInArrow(_sifted_kinds, ROWS), "sifted", free=True)

    wanted = _salted(sifted.where("kind = 0"), hot).groupBy("rid").agg(F.collect_list(F.struct("anchor", "salt", "first", "length")).alias("wanted"))
    wanted = materialise(wanted, "wanted", free=True)
    texts = only(rows.select("rid", "text"), wanted.select("rid"), "rid")
    pieces = texts.join(wanted, "rid").select("rid", "text", "wanted").mapInArrow(_cut, "anchor bigint, salt int, rid bigint, first int, piece binary")
    pieces = pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "rid", "first")
    matched = materialise(pieces.mapInArrow(_matched(block), MATCHED), "matched", free=True)
    # Of an anchor's blocks: rows with common bytes in several, then their equal windows.
    several = F.count(F.lit(1)).over(Window.partitionBy("anchor", "h"))
    near = matched.where("kind = 2").withColumn("several", several).where("several > 1")
    windows = near.select("anchor", "rid", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select("anchor", "rid", F.col("w.starts").alias("first"), F.col("w.hashes").alias("h"))
    order = Window.partitionBy("anchor", "h").orderBy("rid", "first")
    late = windows.withColumn("nth", F.row_number().over(order)).where("nth > 1").select("rid", "first", F.lit(LENGTH).alias("length"))

    place = ["rid", "first", "length"]
    going = sifted.where("kind = 1").select(*place).unionByName(matched.where("kind = 1").select(*place)).unionByName(late)
    marks = going.groupBy("rid").agg(F.collect_list(F.struct(F.col("first"), (F.col("first") + F.col("length")).alias("stop"))).alias("marks"))
    marks = materialise(marks, "marks", free=True)
    schema = "rid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<first: bigint, stop: bigint>>"
    marked = only(rows.select("rid", "text"), marks.select("rid"), "rid").join(marks, "rid").select("rid", "text", "marks")
    changed = materialise(marked.mapInArrow(_removed, schema), "changed", free=True)
    same = rows.select(
        "id", "rid", F.octet_length("text").cast("long").alias("all_bytes"), F.sha2("text", 256).alias("text_sha256")
    ).join(changed, "rid", "left")
    return same.select(
        F.col("id").alias(id_col),
        F.col("all_bytes").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "text_sha256").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<first: bigint, stop: bigint>>")).alias("spans"),
    )


@frugal
def _sifted_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sifts the contexts, which come first; passes settled rows through."""

    def open_rows() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = int((batch.column("kind").to_numpy() == 0).sum())
            if n < batch.num_rows:
                settled.append(batch.slice(n).select(_NAMES))
            yield batch.slice(0, n)

    settled: list[pa.RecordBatch] = []
    for out in _sifted(open_rows()):
        yield out
        while settled:
            yield settled.pop()
    while settled:
        yield settled.pop()


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
