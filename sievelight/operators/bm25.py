"""BM25: term statistics, ranked search, phrase search, and the inverted index."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.text import index_tokens, made_once

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Query:
    """A parsed query: any of terms, all of must, none of must_not, all phrases."""

    terms: tuple[str, ...] = ()
    must: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = field(default=())

    @property
    def scored(self) -> tuple[str, ...]:
        words = [*self.terms, *self.must, *[w for p in self.phrases for w in p]]
        return tuple(dict.fromkeys(words))


def parse_query(text: str) -> Query:
    """Words in lower case, combined by OR; "a b" is a phrase, as is a word of several
    tokens such as a_b; + demands and - forbids. Never fails: stray marks are dropped."""
    terms, must, must_not, phrases = [], [], [], []
    for sign, quoted, word in re.findall(r'([+-]?)(?:"([^"]*)"|([^\s"]+))', text or ""):
        tokens = re.findall("[a-z0-9]+", (quoted or word).lower())
        if not tokens:
            continue
        if sign == "-":
            must_not += tokens
        elif len(tokens) > 1:
            phrases.append(tuple(tokens))
        else:
            (must if sign == "+" else terms).append(tokens[0])
    return Query(tuple(terms), tuple(must), tuple(must_not), tuple(phrases))


def has_phrase(tokens: Column, phrase: tuple[str, ...]) -> Column:
    """Whether the words of a phrase stand one after another."""
    if len(phrase) == 1:
        return F.array_contains(tokens, phrase[0])

    def at(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(tokens, i + k) == F.lit(w) for k, w in enumerate(phrase)])

    places = F.sequence(F.lit(0), F.greatest(F.size(tokens) - len(phrase), F.lit(0)))
    return F.coalesce(F.exists(places, at), F.lit(False))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search(docs: DataFrame, query: str | Query, id_col: str, text_col: str, limit: int = 10, where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The best limit rows by BM25: id, keep columns, score. Ties go by id.

    Statistics cover all of docs; where filters what is returned. One scan adds up
    the statistics to a single row, one scores every text beside it: nothing but
    sums and the top rows shuffles.
    """
    q = parse_query(query) if isinstance(query, str) else query
    words = q.scored
    if not words or limit <= 0:
        return docs.select(F.col(id_col), *keep, F.lit(0.0).alias("score")).limit(0)
    tokens = docs.select(F.col(id_col), *([text_col] if where is not None else []), *keep, *_columns(where, docs, {id_col, text_col, *keep}), made_once(index_tokens(F.col(text_col))).alias("_tokens"))
    tf = [_occurrences("_tokens", w).alias(f"_tf{k}") for k, w in enumerate(words)]
    counted = tokens.select("*", F.size("_tokens").alias("_dl"), *tf)
    stats = counted.agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avgdl"), *[F.count_if(F.col(f"_tf{k}") > 0).alias(f"_df{k}") for k in range(len(words))]
    )
    score = reduce(
        lambda a, b: a + b,
        [idf(F.col("_n"), F.col(f"_df{k}")) * term_weight(F.col(f"_tf{k}"), F.col("_dl"), F.col("_avgdl")) for k in range(len(words))],
    )
    hit = reduce(lambda a, b: a | b, [F.col(f"_tf{k}") > 0 for k in range(len(words))])
    for w in q.must:
        hit = hit & F.array_contains("_tokens", w)
    for w in q.must_not:
        hit = hit & ~F.array_contains("_tokens", w)
    for p in q.phrases:
        hit = hit & has_phrase(F.col("_tokens"), p)
    rows = counted.where(hit & where if where is not None else hit).crossJoin(F.broadcast(stats))  # one row
    return rows.select(F.col(id_col), *keep, score.alias("score")).orderBy(F.desc("score"), F.col(id_col)).limit(limit)


def _occurrences(tokens: str, word: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, word))


def _columns(where: Column | None, docs: DataFrame, have: set[str]) -> list[str]:
    return [] if where is None else [c for c in docs.columns if c not in have]


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The inverted index: term, id, tf, positions (ascending)."""
    tokens = docs.select(F.col(id_col), F.posexplode(index_tokens(F.col(text_col))).alias("pos", "term"))
    return tokens.groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, df (texts that hold it), cf (its places in all texts)."""
    tokens = docs.select(F.col(id_col), F.explode(index_tokens(F.col(text_col))).alias("term"))
    per_text = tokens.groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))
    return per_text.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _phrase_at(phrase: tuple[str, ...]) -> Column:
    """Whether some place of the first word has each next word one place on."""
    places = [F.coalesce(F.try_element_at("at", F.lit(w)), F.array().cast("array<int>")) for w in phrase]
    return F.exists(places[0], lambda s: reduce(lambda a, b: a & b, [F.array_contains(x, s + k) for k, x in enumerate(places)]))


def search_postings(index: DataFrame, lengths: DataFrame, query: str, id_col: str, limit: int = 10, among: DataFrame | None = None) -> DataFrame:
    """BM25 over a stored index: index (term, id, tf, positions), lengths (id, dl).
    The query's few terms are pushed down to the scan of the index. among: the ids (distinct)
    that may be found; statistics are those of all."""
    q = parse_query(query)
    hits = index.where(F.col("term").isin(*q.scored))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    one = F.broadcast(df.crossJoin(F.broadcast(stats)))  # a row for each of the query's terms
    scored = hits.join(one, "term").join(lengths, id_col)
    part = idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    found = scored.groupBy(id_col).agg(F.sum(part).alias("score"), F.collect_set("term").alias("terms"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    for w in q.must:
        found = found.where(F.array_contains("terms", w))
    for p in q.phrases:
        found = found.where(_phrase_at(p))
    if q.must_not:
        barred = index.where(F.col("term").isin(*q.must_not)).select(id_col).distinct()
        found = found.join(barred, id_col, "left_anti")
    if among is not None:
        found = found.join(among.select(id_col), id_col, "left_semi")
    return found.select(id_col, "score").orderBy(F.desc("score"), F.col(id_col)).limit(max(0, limit))
