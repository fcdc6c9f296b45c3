"""Licence scans by a positional rare-token index (operator 10): DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values. Base phrases and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Fixed values. Short notices: label, wording, key phrases of which every one must stand in the matched place.
TEMPLATES = [
    ("mit-notice", "released under the mit license", ["mit license"]),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-notice", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it", "gnu general public license"]),
    ("lgpl-notice", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl-notice", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-notice", "licensed under the bsd license", ["bsd license"]),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-notice", "licensed under a creative commons attribution license", ["creative commons"]),
    ("public-domain", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("all-rights-reserved", "copyright all rights reserved", ["all rights reserved"]),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies"]),
    ("apache-2.0", "apache license version 2 0 january 2004", ["apache license version 2 0"]),
    ("gpl-2.0", "gnu general public license version 2 june 1991", ["gnu general public license version 2"]),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", ["gnu general public license version 3"]),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", ["gnu lesser general public license version 2 1"]),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", ["gnu lesser general public license version 3"]),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", ["gnu affero general public license version 3"]),
    ("gfdl-notice", "gnu free documentation license", ["free documentation license"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ["may be used to endorse or promote products derived from this software"]),
    ("mpl-1.1", "mozilla public license version 1 1", ["mozilla public license version 1 1"]),
    ("mpl-2.0", "mozilla public license version 2 0", ["mozilla public license version 2 0"]),
    ("epl-2.0", "eclipse public license v 2 0", ["eclipse public license v 2 0"]),
    ("epl-2.0", "eclipse public license version 2 0", ["eclipse public license version 2 0"]),
    ("eupl-1.2", "european union public licence v 1 2", ["european union public licence"]),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ["will the authors be held liable for any damages arising from the use of this software"]),
    ("bsl-1.0", "boost software license version 1 0", ["boost software license"]),
    ("artistic-2.0", "the artistic license 2 0", ["artistic license 2 0"]),
    ("ofl-1.1", "sil open font license version 1 1", ["sil open font license"]),
    ("cddl-notice", "common development and distribution license", ["common development and distribution license"]),
    ("cc0-1.0", "cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("ms-pl", "microsoft public license ms pl", ["microsoft public license"]),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ["use copy modify and distribute this software and its documentation", "without a written agreement is hereby granted"]),
]

#: Words of each key phrase by which its notice is looked up: those that the fewest files hold.
RAREST = 2

#: Words before and after the matched place within which key phrases count.
SLACK = 3

#: What separates words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, SEPARATORS), "")


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def phrase_words() -> list[tuple[int, int, str, int]]:
    """(template, phrase, word, place in the template) of all words of key phrases."""
    found = []
    for k, (_, text, phrases) in enumerate(TEMPLATES):
        words = text.split()
        for j, phrase in enumerate(p.split() for p in phrases):
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            found += [(k, j, w, at + i) for i, w in enumerate(phrase)]
    return found


def index(files: dict[str, int]) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """(postings, least): postings (template, word, place) of each phrase's RAREST words of highest IDF, given how many files hold each word,
    the first on ties; least: how many postings of a template align wherever one of its phrases stands, at least.

    So a place with all of a template's phrases is always found, whatever words are chosen, and words that many files hold are
    looked up only where a phrase has no rarer ones.
    """
    of: dict[tuple[int, int], list[tuple[int, int, str]]] = {}
    for k, j, w, i in phrase_words():
        of.setdefault((k, j), []).append((files.get(w, 0), i, w))
    chosen = {key: sorted(words)[:RAREST] for key, words in of.items()}
    least: dict[int, int] = {}
    for (k, _), words in chosen.items():
        least[k] = min(least.get(k, RAREST), len(words))
    return sorted({(k, w, i) for (k, _), words in chosen.items() for _, i, w in words}), least


def _postings(spark, files: dict[str, int], n: int) -> DataFrame:
    """The postings, each word's share of its template's IDF, and each template's figures: some 100 rows, whatever the input."""
    postings, least = index(files)
    idf = {w: math.log((n + 2.0) / (files.get(w, 0) + 1.0)) for _, w, _ in postings}
    whole: dict[int, float] = {}
    for k, w, _ in postings:
        whole[k] = whole.get(k, 0.0) + idf[w]
    rows = ", ".join(f"({k}, '{w}', {i}, CAST({idf[w] / whole[k]!r} AS DOUBLE), {least[k]}, {len(TEMPLATES[k][1].split())})" for k, w, i in postings)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, word, place, share, least, n)")


def _files(docs: DataFrame) -> dict[str, int]:
    """How many files hold each word of the key phrases."""
    known = _literals(sorted({w for _, _, w, _ in phrase_words()}))
    rows = docs.select(F.explode(F.array_intersect(_words(F.col("text")), known)).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in rows.collect()}  # a row for each of these words


def _starts(hits: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, given (w, i) of all places of its words."""
    found = None
    def of(word: str, j: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - j)

    for j, word in enumerate(phrase.split()):
        own = of(word, j)
        found = own if found is None else F.array_intersect(found, own)
    return found


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: all places where a phrase of BASE stands. The method counts in how many files the words of key phrases stand, looks up a
    file's words of highest IDF (see index) in the notices' postings, keeps notices of which the words of a phrase stand at one
    relative position, and verifies all their key phrases there; its labels are added to the base ones.
    score: the largest share of a verified notice's IDF (of its postings) that stands in place, to six digits, at least 0.5 if there
    is a base place, else 0. A null text is empty; repeated rows give a row each; an empty table gives none;
    columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    files, n = _files(docs), docs.count()
    vocabulary = sorted({w for _, w, _ in index(files)[0]} | {w for p in BASE for w in p.split()})
    one = docs.select(F.col("doc_id"), F.explode(F.array(_words(F.col("text")))).alias("words"))  # explode: so the words are made once
    seen = one.select("doc_id", "words", F.size(F.array_intersect("words", _literals(vocabulary))).alias("known"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(vocabulary))
    compact = seen.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.col("known") > 0, hits).alias("hits"),
        F.when(F.col("known") > 1, F.array_join("words", " ")).alias("norm"),  # a notice has two different words at least
    )
    compact = written(compact.withColumn("rid", F.monotonically_increasing_id()), "licence-hits")

    marked = compact.where("norm is not null")
    places = marked.select("rid", F.explode("hits").alias("h")).select("rid", F.col("h.w").alias("word"), F.col("h.i").alias("i"))

    votes = (
        places.join(F.broadcast(_postings(spark, files, n)), "word")
        .select("rid", "template", "least", "n", (F.col("i") - F.col("place")).alias("at"), "share")
        .groupBy("rid", "template", "least", "n", "at")
        .agg(F.count("*").alias("aligned"), F.sum("share").alias("share"))
        .where(F.col("aligned") >= F.col("least"))
        .groupBy("rid")
        .agg(F.collect_list(F.struct("template", "at", "n", "share")).alias("votes"))
    )
    phrases = F.array(*[_literals(t[2]) for t in TEMPLATES])
    names = _literals([t[0] for t in TEMPLATES])

    def near(words: Column, v: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(F.slice(words, F.greatest(v["at"] - SLACK, F.lit(0)) + 1, v["n"] + 2 * SLACK), " "), F.lit(" "))

    def holds(words: Column, v: Column) -> Column:
        place = near(words, v)
        return F.forall(F.get(phrases, v["template"]), lambda p: F.contains(place, F.concat(F.lit(" "), p, F.lit(" "))))

    # a file's words are split once, whatever the number of its votes
    split = votes.join(marked.select("rid", "norm"), "rid").select("rid", "votes", F.explode(F.array(F.split("norm", " "))).alias("words"))
    kept = split.select("rid", F.filter("votes", lambda v: holds(F.col("words"), v)).alias("votes")).where(F.size("votes") > 0)
    verified = kept.select(
        "rid",
        F.array_distinct(F.transform("votes", lambda v: F.get(names, v["template"]))).alias("more"),
        F.round(F.array_max(F.transform("votes", lambda v: F.least(F.lit(1.0), v["share"]))), 6).alias("share"),
    )
    empty = F.array().cast("array<string>")
    starts = {label: _starts(F.col("hits"), phrase) for phrase, label in BASE.items()}
    based = compact.where("hits is not null").select("rid", *[s.alias(f"s_{label}") for label, s in starts.items()])
    every = F.concat(*[F.col(f"s_{label}") for label in starts])
    based = based.where(F.size(every) > 0).select(
        "rid",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(F.col(f"s_{label}")) > 0, F.lit(label)) for label in starts])).alias("base"),
    )
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base, more = F.coalesce("base", empty), F.coalesce("more", empty)
    return (
        compact.select("rid", "doc_id", "n_words")
        .join(based, "rid", "left")
        .join(verified, "rid", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
            "first_word",
            "last_word",
            joined(base).alias("base_labels"),
            joined(F.concat(base, more)).alias("labels"),
            F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        )
    )


def scan_sql() -> str:
    """The scan of `documents` (doc_id, text; one row a doc_id) in DuckDB's SQL."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    vocabulary = sorted({w for _, _, w, _ in phrase_words()} | {w for p in BASE for w in p.split()})
    words = ", ".join(f"({k}, {j}, '{w}', {i}, {len(TEMPLATES[k][1].split())}, '{TEMPLATES[k][0]}')" for k, j, w, i in phrase_words())
    phrases = " OR ".join("(template = {} AND {})".format(k, " AND ".join(f"contains(near, ' {p} ')" for p in t[2])) for k, t in enumerate(TEMPLATES))
    bases = " UNION ALL ".join(
        "SELECT h0.doc_id, h0.i, '{}' AS label FROM hits h0 {} WHERE h0.word = '{}'".format(
            label, " ".join(f"JOIN hits h{j} ON h{j}.doc_id = h0.doc_id AND h{j}.i = h0.i + {j} AND h{j}.word = '{w}'" for j, w in enumerate(phrase.split()) if j), phrase.split()[0]
        )
        for phrase, label in BASE.items()
    )
    return f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') AS words FROM documents),
hits AS (SELECT doc_id, word, i - 1 AS i FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d) WHERE word IN ({quoted(vocabulary)})),
counts AS (SELECT word, count(DISTINCT doc_id) AS files FROM hits GROUP BY word),
phrases(template, phrase, word, place, n, label) AS (VALUES {words}),
chosen AS (SELECT *, row_number() OVER (PARTITION BY template, phrase ORDER BY coalesce(files, 0), place) AS nth FROM phrases LEFT JOIN counts USING (word) QUALIFY nth <= {RAREST}),
least AS (SELECT template, min(k) AS least FROM (SELECT template, phrase, count(*) AS k FROM chosen GROUP BY template, phrase) GROUP BY template),
postings AS (SELECT DISTINCT template, word, place, n, label, ln(((SELECT count(*) FROM d) + 2.0) / (coalesce(files, 0) + 1.0)) AS idf FROM chosen),
whole AS (SELECT template, sum(idf) AS whole FROM postings GROUP BY template),
votes AS (SELECT doc_id, template, least, n, label, i - place AS off, count(*) AS aligned, sum(idf / whole) AS share FROM hits JOIN postings USING (word) JOIN whole USING (template) JOIN least USING (template) GROUP BY ALL HAVING count(*) >= least),
places AS (SELECT votes.*, ' ' || array_to_string(words[greatest(off - {SLACK}, 0) + 1 : greatest(off - {SLACK}, 0) + n + {2 * SLACK}], ' ') || ' ' AS near FROM votes JOIN d USING (doc_id)),
verified AS (SELECT doc_id, label, least(1.0, share) AS share FROM places WHERE {phrases}),
base AS ({bases}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM verified) GROUP BY doc_id),
s AS (SELECT doc_id, round(max(share), 6) AS share FROM verified GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""


def scan_one(text: str | None) -> tuple[int, list[int], list[str]]:
    """Words, base places and base labels of one text in plain Python, to test against."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), sorted(places), sorted(labels)
