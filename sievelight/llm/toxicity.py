"""Toxicity by weak supervision.

Voters are lexicons (fixed insults, each a voter of its own, and terms that were mined
from a bounded sample of annotated texts: words and beginnings of words) and
patterns (shouting, exclamation, address, many insults). A generative label model
estimates from the voters' agreements alone how often each fires for either
class and on which other voter it depends; annotations enter it only by the share
of toxic texts. A linear classifier is trained on its posterior labels and
scores every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import bytesops
from sievelight.llm.bytesops import frugal
from sievelight.llm.common import materialise, ship, table
from sievelight.llm.decontaminate import IS_GAP
from sievelight.llm.language_id import fold

#: Annotated texts that the model is fitted on at most (a pseudorandom part of
#: them if there are more), terms of the classifier, terms that are voters,
#: texts a term must be in.
MAX_ANNOTATED, MAX_TERMS, VOTERS, LEAST_TEXTS = 16_000, 2048, 192, 5
#: Lengths, in characters, of the word beginnings that are terms; 0: the word.
BEGINNINGS = (0, 4, 5, 6, 7)
#: Fixed words: insults in four languages, and forms of address.
INSULTS = (
    "idiot idiots stupid moron morons imbecile fool loser losers trash garbage scum pathetic worthless disgusting clown dumb jerk ugly hate vermin filth"
    " dummkopf idioten abschaum widerlich wertlos erbärmlich dreck versager hässlich verlierer"
    " imbécile crétin abruti ordure pathétique dégoûtant minable raclure nul déchet"
    " idiota estúpido imbécil basura escoria patético asqueroso inútil payaso perdedor"
).split()
ADDRESS = "you your u du dein ihr sie tu toi vous ton te usted vosotros eres".split()
PATTERNS = ("shouting", "exclaiming", "insult", "insults", "address")
#: Digits that stand for letters inside words.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[ord(c) for c in "0134578"]] = [ord(c) for c in "oieastb"]


def _words(lowered: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of texts in lower case: (first row, bytes, start, end and first word of words);
    digits inside words are read as the letters they stand for."""
    data, offsets = bytesops.utf8(lowered)
    for lo, hi in bytesops.chunks(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        body = data[offsets[lo] : offsets[hi]]
        start, end, first = bytesops.words(body, own, IS_GAP)
        yield lo, _PLAIN[body], start, end, first


def terms_of(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of term: (kind, words that have one, byte start, byte end)."""
    lead = np.flatnonzero((body & 0xC0) != 0x80)
    at, stop = np.searchsorted(lead, start), np.searchsorted(lead, end)
    for n in BEGINNINGS:
        if n:
            has = np.flatnonzero(stop - at > n)
            yield n, has, start[has], lead[at[has] + n]
        else:
            yield 0, np.arange(len(start)), start, end


def _keys(body: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
    return bytesops.mix64(bytesops.word_hashes(body, start, end) + np.uint64(kind))


def _hashed(words: list[str]) -> np.ndarray:
    body = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    return np.sort(_keys(_PLAIN[body], end - np.diff(end, prepend=0), end, 0))


def _member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys


@frugal
def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of terms: texts, and toxic ones. Columns text, toxic."""
    for batch in batches:
        toxic = np.array(batch.column(1).to_pylist(), np.int64)
        keys, rows = [], []
        for lo, body, start, end, first in _words(pc.utf8_lower(batch.column(0))):
            row = np.repeat(np.arange(len(first) - 1), np.diff(first)) + lo
            for kind, has, a, b in terms_of(body, start, end):
                keys.append(_keys(body, a, b, kind))
                rows.append(row[has])
            if sum(map(len, keys)) > 1 << 18 or lo + len(first) - 1 == batch.num_rows:
                key, of = np.concatenate(keys).view(np.int64), np.concatenate(rows)
                order = np.lexsort((of, key))
                key, of = key[order], of[order]
                once = np.ones(len(key), bool)
                once[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                key, of = key[once], of[once]
                if len(key):
                    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    counts, bad = np.diff(np.append(cut, len(key))), np.add.reduceat(toxic[of], cut)
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(counts), pa.array(bad)], ["term", "n", "n_toxic"])
                keys, rows = [], []


class Features:
    """What a text shows: which terms it holds, and which patterns fire."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = np.sort(terms.astype(np.int64).view(np.uint64)) if len(terms) else np.zeros(0, np.uint64)
        self.insults, self.address = _hashed(INSULTS), _hashed(ADDRESS)
        self.size = len(self.terms) + len(PATTERNS)

    def of(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For chunks of texts: (first row, rows, row and number of each feature, once each)."""
        column = column.fill_null("") if column.null_count else column
        raw, offsets = bytesops.utf8(column)
        for lo, body, start, end, first in _words(pc.utf8_lower(column)):
            n = len(first) - 1
            row = np.repeat(np.arange(n), np.diff(first))
            found = []
            insults = np.zeros(n, np.int64)
            spoken = np.zeros(n, bool)
            for kind, has, a, b in terms_of(body, start, end):
                keys = _keys(body, a, b, kind)
                if not kind:
                    insults = np.bincount(row[_member(keys, self.insults)], minlength=n)
                    spoken[row[_member(keys, self.address)]] = True
                if len(self.terms):
                    at = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
                    good = self.terms[at] == keys
                    found.append(row[has[good]] * self.size + at[good])
            own = offsets[lo : lo + n + 1]
            part = raw[own[0] : own[-1]]
            sums = [np.concatenate([[0], np.cumsum(x)])[own - own[0]] for x in ((part >= 65) & (part <= 90), (part >= 97) & (part <= 122), part == 33)]
            upper, lower, bang = (np.diff(x) for x in sums)
            n_words = np.maximum(np.diff(first), 1)
            fired = np.stack([(upper > lower) & (upper > 8), bang * 10 > n_words, insults > 0, (insults > 2) | (insults * 50 > n_words), spoken])
            which, rows = np.nonzero(fired)
            found.append(rows * self.size + len(self.terms) + which)
            code = np.unique(np.concatenate(found))
            yield lo, n, code // self.size, code % self.size


def _shown(features: Features) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @frugal
    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, row, k in features.of(batch.column(0)):
                at = np.searchsorted(row, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, n), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(k, pa.int32()))], ["toxic", "shown"]
                )

    return show


def _dependence(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Conditional mutual information, in nats, of each two voters given the class."""
    n, total = len(votes), np.zeros((votes.shape[1],) * 2)
    for w in mass:
        both = (votes * w[:, None]).T @ votes
        one, all_ = np.diag(both), w.sum()
        cells = (both, one[:, None] - both, one[None, :] - both, all_ - one[:, None] - one[None, :] + both)
        sides = [(a, b) for a in (one, all_ - one) for b in (one, all_ - one)]
        for cell, (a, b) in zip((cells[0], cells[1], cells[2], cells[3]), sides, strict=True):
            cell, alone = np.clip(cell, 1e-9, None), np.clip(a[:, None] * b[None, :], 1e-9, None)
            total += cell / n * np.log(cell * max(all_, 1e-9) / alone)
    return total


def _parents(votes: np.ndarray, mass: np.ndarray, least: float) -> np.ndarray:
    """For each voter the one it depends on, or -1: the heaviest forest of dependences above least."""
    gain = _dependence(votes, mass)
    m = len(gain)
    parent, done = np.full(m, -1), np.zeros(m, bool)
    best, of = np.full(m, -np.inf), np.full(m, -1)
    for _ in range(m):
        k = int(np.argmax(np.where(done, -np.inf, best)))
        if not np.isfinite(best[k]) or done[k]:
            k = int(np.flatnonzero(~done)[0])  # a new tree
        else:
            parent[k] = of[k]
        done[k] = True
        closer = ~done & (gain[k] > np.maximum(best, least))
        best[closer], of[closer] = gain[k][closer], k
    return parent


def _balanced(log_odds: np.ndarray, share: float) -> np.ndarray:
    """Probabilities of log_odds, shifted so that their mean is share."""
    lo, hi = -40.0 - log_odds.max(), 40.0 - log_odds.min()
    for _ in range(60):
        mid = (lo + hi) / 2
        p = 1 / (1 + np.exp(-np.clip(log_odds + mid, -30, 30)))
        lo, hi = (mid, hi) if p.mean() < share else (lo, mid)
    return p


def label_model(votes: np.ndarray, prior: float, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior probabilities of class 1, and the model: prior, fire (the rate at
    which each voter fires for class 0 and 1), parent (the voter it depends on, or -1)
    and table[class, parent's vote, voter] (the rate of firing given both).

    votes: a row for each text, a column for each voter, 1 if it fires; a voter that doesn't
    fire abstains (a lexicon says nothing of texts in other languages). prior: the share of
    class 1. No label of a text is seen: expectation maximisation starts from the texts on
    which the rarest voters fire, and learns rates and dependences (a forest of voters)
    from which voters fire together. A voter is assumed to fire for class 1 at
    least as often as for class 0. The posteriors' mean is held at the share of class 1.
    """
    n, m = votes.shape
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    if not n or not m:
        return np.full(n, prior), {"prior": prior, "fire": np.zeros((2, m)), "parent": np.full(m, -1), "table": np.zeros((2, 2, m))}
    rate = np.clip(votes.mean(0), 1 / n, 1)
    strength = votes @ -np.log(rate)
    first = np.argsort(-strength, kind="stable")[: max(1, round(prior * n))]
    post = np.full(n, 0.05)
    post[first[strength[first] > 0]] = 0.9
    parent, table, fire = np.full(m, -1), np.zeros((2, 2, m)), np.zeros((2, m))
    for k in range(rounds):
        mass = np.stack([1 - post, post])
        if k in (3, 8, 16):
            parent = _parents(votes, mass, 0.5 * np.log(n) / n * 4)
        fire = (mass @ votes + rate) / (mass.sum(1)[:, None] + 1)
        fire[1] = np.maximum(fire[1], fire[0])
        on = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0.0)
        for b, side in ((0, 1 - on), (1, on)):
            for c in (0, 1):
                seen = mass[c] @ side
                table[c, b] = (mass[c] @ (side * votes) + 2 * fire[c]) / (seen + 2)
            table[1, b] = np.maximum(table[1, b], table[0, b])
        table = np.clip(table, 1e-6, 1 - 1e-6)
        hit, miss = np.log(table[1] / table[0]), np.log((1 - table[1]) / (1 - table[0]))
        said = (votes * np.where(on > 0, hit[1], hit[0])).sum(1)
        new = _balanced(said + ((1 - votes) * np.where(on > 0, miss[1], miss[0])).sum(1), prior)
        done = np.abs(new - post).max() < 1e-4 and k > 16
        post = new
        if done:
            break
    return _balanced(said, prior), {"prior": prior, "fire": fire, "parent": parent, "table": table, "posterior": post}


def linear_classifier(row: np.ndarray, col: np.ndarray, target: np.ndarray, size: int, rounds: int = 300, ridge: float = 0.3, rate: float = 0.05) -> np.ndarray:
    """Logistic regression on 0/1 features against probabilities; the bias comes last.
    Gradient descent with adaptive steps (Adam) on the mean loss with a ridge penalty, a stronger one for few texts."""
    n = len(target)
    ridge += 60 / n
    w = np.zeros(size + 1)
    prior = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + w[-1], -30, 30)))
        grad = np.append(np.bincount(col, (p - target)[row], size), (p - target).sum()) / n
        grad[:-1] += ridge / n * w[:-1]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        w -= rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return w


class ToxicityModel:
    """The fitted classifier: terms, weights, and the label model it was trained from."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, voters: dict) -> None:
        self.terms, self.weights, self.voters = terms, weights, voters


def annotated_sample(docs: DataFrame, labels: DataFrame, text_col: str = "text", most: int = MAX_ANNOTATED) -> DataFrame:
    """(text, toxic) of the annotated texts, of at most about most of them, chosen by
    a hash of their ids. The chosen labels are that few, so they are broadcast."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return docs.join(F.broadcast(known), "doc_id").select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), "toxic")


def fit(sample: DataFrame) -> ToxicityModel:
    """Fit on (text, toxic 0/1) rows, a bounded number. Without rows the model scores
    by the fixed lexicon and patterns alone."""
    spark = sample.sparkSession
    ship(spark)
    sample = materialise(sample, "annotated")
    n, n_toxic = sample.select(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    terms, voters = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n:
        mined = sample.mapInArrow(_mined, "term bigint, n bigint, n_toxic bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("k"))
        rate = (n_toxic + 1) / (n + 2)
        lift = F.log((F.col("k") + 0.5) / (F.col("n") + 1) / F.lit(rate))
        # How surprising the toxic texts among those with the term are, either way.
        gain = F.abs(F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        top = mined.where(F.col("n") >= LEAST_TEXTS).withColumn("gain", gain).withColumn("lift", lift)
        rows = top.orderBy(F.desc("gain"), "term").limit(MAX_TERMS).collect()
        terms = np.array(sorted(r["term"] for r in rows), np.int64)
        good = [r["term"] for r in rows if r["lift"] > 0.7 and r["k"] * 2 > r["n"]]
        voters = np.array(good[:VOTERS], np.int64)
    features = Features(terms)
    shown = sample.select("text", "toxic").mapInArrow(_shown(features), "toxic int, shown array<int>").collect() if n else []
    row = np.repeat(np.arange(len(shown)), [len(r["shown"]) for r in shown])
    col = np.array([k for r in shown for k in r["shown"]], np.int64)
    # Voters: terms of the lexicons, fixed and mined, and the patterns.
    number = np.full(features.size, -1)
    lexicon = np.unique(np.concatenate([np.searchsorted(features.terms, np.sort(voters.view(np.uint64))), np.flatnonzero(_member(features.terms, features.insults))]))
    number[lexicon] = np.arange(len(lexicon))
    number[len(terms) :] = np.arange(len(PATTERNS)) + len(lexicon)
    votes = np.zeros((len(shown), len(lexicon) + len(PATTERNS)))
    seen = number[col] >= 0
    votes[row[seen], number[col[seen]]] = 1
    if n:
        posterior, model = label_model(votes, n_toxic / n)
        weights = linear_classifier(row, col, posterior, features.size)
    else:
        model, weights = {}, np.array([0.0, 0.5, 3.0, 3.0, 0.0, -2.0])
    return ToxicityModel(terms, weights, model)


def _scored(model: ToxicityModel, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.terms)
        for batch in batches:
            total = np.full(batch.num_rows, model.weights[-1])
            for lo, n, row, k in features.of(batch.column(batch.schema.get_field_index(text_col))):
                total[lo : lo + n] += np.bincount(row, model.weights[k], n)
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            out = {x: batch.column(x) for x in batch.schema.names} | {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(out)

    return score


def scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5).

    A null text counts as empty; an empty text gets the score of one without any
    feature. Repeated rows each give a row; columns named score or predicted are
    replaced; other columns pass through; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    df = docs.drop("score", "predicted")
    df = df.withColumn(text_col, F.col(text_col).cast("string"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], "score double", "predicted int"])
    return df.mapInArrow(_scored(model, text_col), schema)


def learned(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    """Fitted on annotated documents whose crc32(doc_id as text) modulo 5 isn't 0."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return fit(annotated_sample(table(spark, sf_dir, "documents").select("doc_id", "text"), labels))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return scores(docs, learned(spark, sf_dir)).drop("text")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict[str, str] = {}
