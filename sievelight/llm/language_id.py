"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a trigram's vector binds (multiplies)
its letters' vectors, permuted (rotated) by place; a text's vector bundles (adds)
those of its trigrams, a language's prototype those of its training texts. A text
takes the language whose prototype has the greatest cosine with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import bytesops
from sievelight.llm.bytesops import frugal
from sievelight.llm.common import ship, table

#: Dimensions and letters: 0 is any gap between letters, 1 to 26 are a to z,
#: other letters share the rest by code point.
DIM, LETTERS = 1024, 64
#: Counts (rows times distinct trigrams) and distinct trigrams that are worked on at a time.
STEP, CODES = 1 << 22, 1 << 13

_rng = np.random.Generator(np.random.PCG64(11))
_LETTER = (_rng.integers(0, 2, (LETTERS, DIM), dtype=np.int8) * 2 - 1).astype(np.int8)
_FIRST, _SECOND = np.roll(_LETTER, 2, axis=1), np.roll(_LETTER, 1, axis=1)


def _symbol(point: int) -> int:
    x = chr(point)
    if not x.isalpha():
        return 0
    c = ord(x.lower()[0])
    return c - 96 if 97 <= c <= 122 else 27 + c % (LETTERS - 27)


_TABLE = np.array([_symbol(k) for k in range(0x3000)], np.uint8)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """One row for each trigram code a * LETTERS**2 + b * LETTERS + c."""
    a, b, c = codes // LETTERS**2, codes // LETTERS % LETTERS, codes % LETTERS
    return _FIRST[a] * _SECOND[b] * _LETTER[c]


def symbols(points: np.ndarray) -> np.ndarray:
    far = points >= len(_TABLE)
    out = _TABLE[np.where(far, 0, points)]
    if far.any():
        some, back = np.unique(points[far], return_inverse=True)
        out[far] = np.array([_symbol(int(p)) for p in some], np.uint8)[back]
    return out


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of texts: (first row, rows, row in the chunk and code of each trigram).

    Trigrams are centred on a letter; gaps between letters count as one symbol,
    each text begins and ends with one.
    """
    data, offsets = bytesops.utf8(column)
    for lo, hi in bytesops.chunks(offsets):
        body = data[offsets[lo] : offsets[hi]]
        points = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
        own = lead[offsets[lo : hi + 1] - offsets[lo]]
        rows = np.repeat(np.arange(hi - lo), np.diff(own))
        s = np.zeros(len(points) + hi - lo + 1, np.int64)
        place = np.arange(len(points)) + rows + 1
        s[place] = symbols(points)
        row = np.zeros(len(s), np.int64)
        row[place] = rows
        kept = np.flatnonzero((s != 0) | np.concatenate([[True], s[:-1] != 0]))
        s, row = s[kept], row[kept]
        code = s[:-2] * LETTERS**2 + s[1:-1] * LETTERS + s[2:]
        centred = s[1:-1] != 0
        yield lo, hi - lo, row[1:-1][centred], code[centred]


def bundles(code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the sum of its trigrams' vectors; row is in order. Rows and
    distinct codes are taken in steps, so that no step counts over STEP entries or one row."""
    out = np.zeros((n, DIM), np.float32)
    seen = np.zeros(LETTERS**3, np.int64)
    lo = 0
    while lo < n:
        begin, hi = np.searchsorted(row, lo), n
        while hi - lo > 1:
            seen[:] = 0
            seen[code[begin : np.searchsorted(row, hi)]] = 1
            if (hi - lo) * int(seen.sum()) <= STEP:
                break
            hi = lo + (hi - lo) // 2
        stop = np.searchsorted(row, hi)
        own = code[begin:stop]
        seen[:] = 0
        seen[own] = 1
        some = np.flatnonzero(seen)
        seen[some] = np.arange(len(some))
        counts = np.bincount((row[begin:stop] - lo) * len(some) + seen[own], minlength=(hi - lo) * len(some)).reshape(hi - lo, len(some))
        for k in range(0, len(some), CODES):
            out[lo:hi] += counts[:, k : k + CODES].astype(np.float32) @ trigram_vectors(some[k : k + CODES]).astype(np.float32)
        lo = hi
    return out


@frugal
def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sum of text vectors by language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for lo, n, row, code in trigrams(batch.column(0)):
            names, of = np.unique(langs[lo : lo + n].astype(str), return_inverse=True)
            order = np.argsort(of[row], kind="stable")
            for name, own in zip(names.tolist(), bundles(code[order], of[row][order], len(names)), strict=True):
                total[name] = total.get(name, 0) + own.astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "bundle"]
    )


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The bundle of all texts of each language, whatever their number; rows with
    a null text or language teach nothing."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    sums = (
        rows.mapInArrow(_bundled, "lang string, bundle array<double>")
        .select("lang", F.posexplode("bundle").alias("k", "x"))
        .groupBy("lang", "k").agg(F.sum("x").alias("x"))
    )
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages times DIM numbers
        out.setdefault(r.lang, np.zeros(DIM))[r.k] = r.x
    return {k: out[k] for k in sorted(out) if np.any(out[k])}


def _compared(models: dict[str, np.ndarray], text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = np.array([*models, "und"], object)
    unit = np.array([v / np.linalg.norm(v) for v in models.values()], np.float32).reshape(-1, DIM)

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.full(batch.num_rows, len(names) - 1)
            score = np.zeros(batch.num_rows)
            for lo, n, row, code in trigrams(batch.column(batch.schema.get_field_index(text_col))):
                vector = bundles(code, row, n)
                length = np.linalg.norm(vector, axis=1)
                live = np.unique(row) if len(unit) else np.zeros(0, int)
                cosine = vector[live] @ unit.T / np.maximum(length[live], 1e-9)[:, None]
                best[lo + live] = cosine.argmax(1) if len(live) else 0
                score[lo + live] = np.clip(cosine.max(1), 0, 1) if len(live) else 0
            out = {x: batch.column(x) for x in batch.schema.names if x != text_col}
            out |= {"lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(score)}
            yield pa.RecordBatch.from_pydict(out)

    return compare


def identify(docs: DataFrame, models: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs without text_col, with lang_pred and score (the cosine, 0 to 1).

    A null text and one without a letter get 'und' and 0, as do all if no model
    was learned. Equal cosines go to the language that sorts first. Repeated
    rows each give a row; columns named lang_pred or score are replaced; an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    df = docs.drop("lang_pred", "score").withColumn(text_col, F.col(text_col).cast("string"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text_col]
    return df.mapInArrow(_compared(models, text_col), ", ".join([*schema, "lang_pred string", "score double"]))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = prototypes(docs.where(fold("doc_id", 3) != 1).select("text", "lang"))
    return identify(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), models)


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}
