"""Benchmark decontamination by an FM-index per training shard.

A task's texts form shards. Only runs of words that the benchmark knows can
hold one of its windows, so a shard's index covers those runs: all windows are
searched backward through wavelet-tree ranks, occurrences are located by
sampled suffix positions and merged to spans. Nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm import bytesops
from sievelight.llm.bytesops import frugal
from sievelight.llm.common import materialise, ship, table, text_or_empty
from sievelight.llm.fm_index import FMIndex

#: Words of a window; characters of benchmark text that one pass over the
#: documents looks for (a larger benchmark takes several passes, in blocks, and
#: the driver holds two blocks at a time); known words of a shard; windows searched at once.
WINDOW, BLOCK_CHARS, SHARD_WORDS, AT_ONCE = 10, 1 << 24, 1 << 19, 1 << 16
#: Bytes that separate words once A-Z are in lower case.
IS_GAP = np.zeros(256, bool)
IS_GAP[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

SPAN = pa.struct([(x, pa.int64()) for x in ("first_word", "end_word", "first_byte", "end_byte")])


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of texts: (row of the first text, word hashes, byte start and end
    of each word in its text, index of each text's first word)."""
    data, offsets = bytesops.utf8(column)
    for lo, hi in bytesops.chunks(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        body = bytesops.LOWER[data[offsets[lo] : offsets[hi]]]
        start, end, first = bytesops.words(body, own, IS_GAP)
        h = bytesops.word_hashes(body, start, end)
        base = np.repeat(own[:-1], np.diff(first))
        yield lo, h, start - base, end - base, first


class Windows:
    """The distinct windows of a block of benchmark items, as symbols 1.. of their words:
    places in the items' words laid one after another, and the items that own them."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW) -> None:
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, h, _, _, first in hashed_words(pa.array([t for _, t in items], pa.string())):
            hashes.append(h)
            sizes.append(np.diff(first))
        h, size = np.concatenate(hashes), np.concatenate(sizes)
        self.vocabulary = np.unique(h)
        self.words = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)
        begin = np.cumsum(size) - size
        owner = np.array([number[i] for i, _ in items], np.int32)
        #: (words, first word of each distinct window, where its owners begin, owners) by length
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(np.minimum(size[size > 0], width)).tolist():
            own = np.flatnonzero(np.minimum(size, width) == n)
            times = size[own] - n + 1
            start = np.arange(times.sum()) + np.repeat(begin[own] - np.cumsum(times) + times, times)
            whole = np.lib.stride_tricks.sliding_window_view(self.words, n)[start]
            _, of = np.unique(np.ascontiguousarray(whole).view(np.dtype((np.void, 4 * n))).ravel(), return_inverse=True)
            pair = np.unique(of.astype(np.int64) * len(self.ids) + np.repeat(owner[own], times))
            place = np.zeros(of.max() + 1, np.int32)
            place[of] = start
            at = np.searchsorted(pair // len(self.ids), np.arange(len(place) + 1)).astype(np.int32)
            self.groups.append((n, place, at, (pair % len(self.ids)).astype(np.int32)))
        self.least = min((g[0] for g in self.groups), default=0)

    def owners(self, group: int, windows: np.ndarray) -> list[str]:
        """The items that own any of the windows (distinct numbers) of a group."""
        _, _, at, own = self.groups[group]
        times = at[windows + 1] - at[windows]
        index = np.arange(times.sum()) + np.repeat(at[windows] - np.cumsum(times) + times, times)
        return [self.ids[k] for k in np.unique(own[index]).tolist()]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's symbol, 0 if the benchmark doesn't know it."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class _Shard:
    """Runs of known words of some texts, until they are indexed and searched."""

    def __init__(self, windows: Windows) -> None:
        self.windows, self.parts, self.n = windows, [], 0

    def add(self, lo: int, symbols: np.ndarray, first: np.ndarray) -> None:
        known = symbols > 0
        edge = np.zeros(len(symbols) + 1, bool)
        edge[first] = True
        begins, ends = known.copy(), known.copy()
        begins[1:] &= ~known[:-1] | edge[1:-1]
        ends[:-1] &= ~known[1:] | edge[1:-1]
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = b - a >= self.windows.least
        a, b = a[long], b[long]
        if len(a):
            lengths = b - a
            index = np.arange(lengths.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            row = np.searchsorted(first, index, "right") - 1
            self.parts.append((symbols[index], lengths, row + lo, index - first[row]))
            self.n += len(index)

    def search(self) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """(rows, first words, group, window numbers) of all occurrences."""
        if not self.parts:
            return
        symbols, lengths, row, word = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        index = FMIndex(symbols, lengths, len(self.windows.vocabulary))
        for group, (n, start, _, _) in enumerate(self.windows.groups):
            for k in range(0, len(start), AT_ONCE):
                phrases = self.windows.words[start[k : k + AT_ONCE, None] + np.arange(n)]
                lo, hi = index.search(phrases)
                hit = np.flatnonzero(hi > lo)
                times = hi[hit] - lo[hit]
                if len(hit):
                    at = np.arange(times.sum()) + np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
                    place = index.locate(at)
                    yield row[place], word[place], group, np.repeat(hit + k, times)
        self.parts, self.n = [], 0


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the ranges [first, end), touching ones joined."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return first[new], np.concatenate([end[:-1][new[1:]], end[-1:]])


def _scan(windows: Windows, text_col: str, keep_text: bool, cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            found: list = []
            bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            shard = _Shard(windows)
            for lo, h, start, end, first in hashed_words(batch.column(batch.schema.get_field_index(text_col))):
                n_words[lo : lo + len(first) - 1] = np.diff(first)
                shard.add(lo, windows.symbols(h), first)
                if shard.parts:  # byte places are kept only of texts with a long known run
                    for r in np.unique(shard.parts[-1][2]).tolist():
                        if r >= lo:
                            part = slice(first[r - lo], first[r - lo + 1])
                            bounds[r] = (start[part].astype(np.int32), end[part].astype(np.int32))
                if shard.n >= SHARD_WORDS:
                    found.extend(shard.search())
            found.extend(shard.search())
            ranges: dict[int, list] = {}
            items: dict[int, set] = {}
            for rows, word, group, window in found:
                n = windows.groups[group][0]
                order = np.argsort(rows, kind="stable")
                rows, word, window = rows[order], word[order], window[order]
                begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])).tolist()
                for a, b in zip(begins, [*begins[1:], len(rows)], strict=True):
                    r = int(rows[a])
                    ranges.setdefault(r, []).append((word[a:b], word[a:b] + n))
                    items.setdefault(r, set()).update(windows.owners(group, np.unique(window[a:b])))
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for r, own in ranges.items():
                first = np.concatenate([x for x, _ in own] + [np.array([s["first_word"] for s in old_spans[r]], np.int64)])
                end = np.concatenate([x for _, x in own] + [np.array([s["end_word"] for s in old_spans[r]], np.int64)])
                first, end = merged(first, end)
                begin, stop = bounds[r]
                old_spans[r] = [
                    {"first_word": a, "end_word": b, "first_byte": int(begin[a]), "end_byte": int(stop[b - 1])}
                    for a, b in zip(first.tolist(), end.tolist(), strict=True)
                ]
                old_items[r] = sorted({*old_items[r], *items[r]})
            out = {x: batch.column(x) for x in batch.schema.names if x != text_col or keep_text}
            if cut and any(old_spans):
                out[text_col] = _cut(batch.column(text_col), old_spans)
            out |= {"n_words": pa.array(n_words), "spans": pa.array(old_spans, pa.list_(SPAN)), "items": pa.array(old_items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(out)

    return scan


def _blocks(bench: DataFrame, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of at most block_chars characters, or one item."""
    block, size = [], 0
    for row in bench.toLocalIterator():
        if block and size + len(row.text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.item, row.text))
        size += len(row.text)
    if block:
        yield block


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    keep_text: bool = False,
    cut: bool = False,
) -> DataFrame:
    """docs without text_col (with it if keep_text or cut), with n_words, spans and items.

    spans: the merged ranges of words and bytes that occurrences of benchmark
    windows cover (ten consecutive words of an item, all words of a shorter
    one). items: the sorted ids, as strings, of the items they belong to.
    Words are runs of letters, digits and non-ASCII characters, A-Z in lower
    case. With cut, the spans' bytes are taken out of the texts; spans are places in
    the texts as they were. A null or empty text has no words, an item without words no window;
    an item with a null id goes under the id ''. Repeated items count once,
    repeated rows of docs each give a row. Other columns of docs stay, but those
    named n_words, spans or items are replaced; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    keep_text = keep_text or cut
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_or_empty(F.col(bench_text_col)).alias("text"))
    state = "array<struct<first_word: bigint, end_word: bigint, first_byte: bigint, end_byte: bigint>>"
    df = docs.drop("n_words", "spans", "items").withColumns({
        "n_words": F.lit(0).cast("long"),
        "spans": F.array().cast(state),
        "items": F.array().cast("array<string>"),
        text_col: F.col(text_col).cast("string"),
    })
    blocks = _blocks(items.where("text != ''"), block_chars)
    now = next(blocks, [])
    while (after := next(blocks, None)) is not None:  # a block at a time, so that neither driver nor task holds them all
        df = materialise(df.mapInArrow(_scan(Windows(now), text_col, True, False), df.schema), "screened")
        now = after
    schema = T.StructType([f for f in df.schema.fields if f.name != text_col or keep_text])
    return df.mapInArrow(_scan(Windows(now), text_col, keep_text, cut), schema)


def _cut(texts: pa.Array, spans: list[list[dict]]) -> pa.Array:
    """Texts without the bytes of their spans."""
    out = texts.to_pylist()
    for r, own in enumerate(spans):
        if own:
            body = out[r].encode()
            places = [0, *[s[x] for s in own for x in ("first_byte", "end_byte")], len(body)]
            out[r] = b"".join(body[a:b] for a, b in zip(places[::2], places[1::2], strict=True)).decode()
    return pa.array(out, pa.string())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE_SQL: dict[str, str] = {}
