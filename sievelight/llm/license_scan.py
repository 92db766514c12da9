"""License scan by an exact set-similarity join (native DataFrame functions only).

A template is a paragraph of a license, a set of words. A text block, any run of consecutive
words a quarter longer than the template, holds it if it has the threshold's share of the
template's words. Templates' words are ordered by their frequency in the whole corpus, rarest
first. A block that reaches the threshold has one of the first few of them (prefix
filter), so only the words around such a word are looked at; the template's words among
them must be enough (length filter), and from the first shared one on both sides must have
enough words left (positional filter). What passes is verified in every block.
A notice of few words must stand word for word.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import table, text_or_empty

#: Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Share of a template's words that a block must hold, words of a block for each of the
#: template's, and distinct words below which a template is a notice, which must stand word for word.
THRESHOLD, SPREAD, NOTICE = 0.8, 1.25, 12
#: Paragraphs and notices of public licenses, by label. A third entry is
#: a word without which it isn't this license (families share most of their words).
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "affero"),
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0", "apache"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "released under the bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version", "lesser"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0"),
    ("public-domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("reserved", "all rights reserved"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, whether A-Z are in lower case or not.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sequence(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text)


def template_words(text: str) -> list[str]:
    return sorted(set(sequence(text)))


def is_notice(text: str) -> bool:
    return len(template_words(text)) < NOTICE


def block_words(text: str) -> int:
    """Words of the blocks that a template is looked for in."""
    return math.ceil(SPREAD * len(sequence(text)) - 1e-9)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP + "+"), "")


def needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def _array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _alternatives(words: list[str]) -> str:
    """Matches a text with one of the words, as a whole word in any case of A-Z."""
    return rf"(?i)(?:^|{GAP})(?:{'|'.join(map(re.escape, words))})(?:{GAP}|$)"


def _may_hold(text: Column, *words: str) -> Column:
    """False only for texts that hold none of the words (lower case, letters that no other
    character becomes in lower case but K by the Kelvin sign): a byte search before a pattern."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])


def word_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in the whole corpus."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    # They only order words, so that plain lower case will do.
    words = docs.select(F.explode(F.split(F.lower(text_or_empty(F.col(text_col))), GAP + "+")).alias("word"))
    counts = words.join(F.broadcast(known), "word").groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}  # one row a word of the templates at most
    return {w: found.get(w, 0) for w in vocabulary}


def similarity_join(
    docs: DataFrame,
    text_col: str = "text",
    templates: tuple[tuple[str, ...], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """docs (less text_col) joined with every (template, label, containment) that one of
    their blocks reaches; containment is the greatest one around a rare word of the
    template, so that a document and template may have several rows."""
    spark = docs.sparkSession
    sets = [template_words(t[1]) for t in templates]
    freq = word_frequencies(docs, text_col, sorted(set().union(*sets)))
    rank = {w: k for k, w in enumerate(sorted(freq, key=lambda w: (freq[w], w)))}
    need = [len(s) if is_notice(t[1]) else needed(len(s), threshold) for s, t in zip(sets, templates, strict=True)]
    ordered = [sorted(s, key=rank.__getitem__) for s in sets]
    postings = [
        (w, k, t[0], len(s), p, need[k], s, t[2] if len(t) > 2 else None, sequence(t[1]) if is_notice(t[1]) else None, block_words(t[1]))
        for k, (s, t) in enumerate(zip(ordered, templates, strict=True))
        for p, w in enumerate(s[: len(s) - need[k] + 1])
    ]
    index = spark.createDataFrame(
        postings, "word string, template int, label string, t_size int, t_place int, needed int, t_words array<string>, must string, phrase array<string>, width int"
    )
    by_rank = _array(sorted(rank, key=rank.__getitem__))

    wanted = sorted({p[0] for p in postings})
    text = text_or_empty(F.col(text_col))
    most = max(block_words(t[1]) for t in templates)
    # The words around each rare word: what a block that holds it can hold.
    around = lambda w: F.filter(
        F.transform(w, lambda x, i: F.when(x.isin(wanted), F.struct(x.alias("word"), F.least(i, F.lit(most - 1)).alias("at"), F.slice(w, F.greatest(i - most + 2, F.lit(1)), F.lit(2 * most - 1)).alias("near")))),
        lambda x: x.isNotNull(),
    )
    held = docs.where(_may_hold(text, *wanted) & text.rlike(_alternatives(wanted))).withColumn("_words", words_of(text)).drop(text_col)
    cut = held.withColumn("_cut", F.explode(F.transform(F.array("_words"), around)[0])).drop("_words")
    cut = cut.select("*", F.col("_cut.word").alias("word"), F.col("_cut.at").alias("_at"), F.col("_cut.near").alias("_near")).drop("_cut")
    probe = cut.join(F.broadcast(index), "word")
    probe = probe.withColumn("_near", F.slice("_near", F.greatest(F.col("_at") - F.col("width") + 2, F.lit(1)), F.least(F.col("_at") + 1, F.col("width")) + F.col("width") - 1))
    # The template words around in global order, as far as the rare word: the first shared one.
    probe = probe.withColumn("_shared", F.array_intersect(by_rank, F.array_intersect("_near", "t_words")))
    first = F.array_position("_shared", F.col("word")) - 1
    # A block whose rarest word this is has only shared words from this one on.
    kept = probe.where((F.size("_near") >= F.col("needed")) & (F.size("_shared") - first >= F.col("needed")))
    kept = kept.where(F.col("must").isNull() | F.array_contains("_shared", F.col("must")))

    def best(near: Column) -> Column:
        starts = F.filter(F.transform(near, lambda x, i: F.when(F.array_contains("t_words", x), i)), lambda i: i.isNotNull())
        held = lambda i: F.array_intersect(F.slice(near, i + 1, F.col("width")), F.col("t_words"))
        whole = lambda i: F.when(F.col("must").isNull() | F.array_contains(held(i), F.col("must")), F.size(held(i))).otherwise(0)
        said = lambda i: F.when(F.slice(near, i + 1, F.size("phrase")) == F.col("phrase"), F.col("t_size")).otherwise(0)
        return F.array_max(F.transform(starts, lambda i: F.when(F.col("phrase").isNotNull(), said(i)).otherwise(whole(i))))

    kept = kept.withColumn("_common", F.transform(F.array("_near"), best)[0]).where(F.col("_common") >= F.col("needed"))
    return kept.withColumn("containment", F.col("_common") / F.col("t_size")).select(*[c for c in docs.columns if c != text_col], "template", "label", "containment")


def n_words(text: Column) -> Column:
    """How many words a text has: the pieces between gaps, without the empty ones at the ends."""
    return F.size(F.array_remove(F.split(text, GAP + "+"), "")).cast("long")


def base_scan(text: Column) -> dict[str, Column]:
    """Of a text: n_words, base (the places and labels where a phrase's words stand)."""
    gap = GAP + "+"
    held = _alternatives([]).replace("(?:)", "(?:" + "|".join(gap.join(p.split()) for p in PHRASES) + ")")
    words = words_of(text)

    def places(w: Column) -> Column:
        def at(i: Column) -> Column:
            def phrase(p: str) -> Column:
                return reduce(lambda a, b: a & b, [F.get(w, i + k) == F.lit(x) for k, x in enumerate(p.split())])

            labels = F.array(*[F.when(phrase(p), F.lit(label)) for p, label in PHRASES.items()])
            return F.struct(i.cast("long").alias("place"), F.array_compact(labels).alias("labels"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1), at), lambda x: F.size(x["labels"]) > 0)

    none = F.array().cast("array<struct<place: bigint, labels: array<string>>>")
    longest = [max(p.split(), key=len) for p in PHRASES]
    # The alternatives hold two words at least, so a text that has one isn't empty.
    return {
        "n_words": n_words(text),
        "base": F.when(_may_hold(text, *longest) & text.rlike(held), F.transform(F.array(words), places)[0]).otherwise(none),
    }


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text counts as empty: no words, empty labels, score 0. score is 1 for
    a text with a base phrase, else the greatest containment of a template that
    reaches the threshold, else 0. A text under the lesser or the affero license has
    gpl among its labels too, as the base phrase stands in their names. Rows that repeat id and text each give a row.
    Null ids are kept. Other columns are not read; an empty table gives an
    empty result.
    """
    text = text_or_empty(F.col(text_col))
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    keyed = slim.withColumn("text_hash", F.xxhash64("text"))
    base = keyed.select("id", "text_hash", *[c.alias(k) for k, c in base_scan(F.col("text")).items()])
    found = (
        similarity_join(keyed, "text", **options)
        .groupBy("id", "text_hash")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
        .select(F.col("id").alias("f_id"), F.col("text_hash").alias("f_hash"), "more", "most")
    )
    both = base.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    labels = F.flatten(F.transform("base", lambda x: x["labels"]))
    places = F.transform("base", lambda x: x["place"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(labels).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def _sql() -> str:
    notices = [(label, sequence(t)) for label, t, *_ in TEMPLATES if is_notice(t)]
    longer = [(k, t) for k, t in enumerate(TEMPLATES) if not is_notice(t[1])]
    at = lambda words: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    phrase = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label FROM places WHERE {at(p.split())}" for p, label in PHRASES.items())
    notice = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, 1.0 AS c FROM places WHERE {at(words)}" for label, words in notices)
    rows = ", ".join(f"({k}, '{t[0]}', {template_words(t[1])!r}, {needed(len(template_words(t[1])), THRESHOLD)}, {block_words(t[1])}, {repr(t[2]) if len(t) > 2 else 'NULL'})" for k, t in longer)
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '{WORD}') AS w FROM d),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
hits AS ({phrase}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(label) AS ls FROM hits GROUP BY doc_id),
templates(k, label, tw, needed, width, must) AS (VALUES {rows}),
able AS (SELECT doc_id, w, templates.* FROM words, templates WHERE len(list_intersect(w, tw)) >= needed),
spots AS (SELECT * FROM (SELECT doc_id, k, label, tw, needed, width, must, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM able) WHERE list_contains(tw, word)),
blocks AS (SELECT a.doc_id, a.k, a.label, a.i, any_value(len(a.tw)) AS size, any_value(a.needed) AS needed, count(DISTINCT b.word) AS n, any_value(a.must) IS NULL OR bool_or(b.word = a.must) AS ok
           FROM spots a JOIN spots b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i >= a.i AND b.i < a.i + a.width GROUP BY a.doc_id, a.k, a.label, a.i),
found AS (SELECT doc_id, list(label) AS ls, max(c) AS most FROM (
           SELECT doc_id, label, n / size AS c FROM blocks WHERE ok AND n >= needed UNION ALL {notice}) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(list_distinct(coalesce(base.ls, []))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
FROM d JOIN words USING (doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE_SQL = {"op5_license_scan": _sql()}
