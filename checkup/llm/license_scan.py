"""Operator 8: licence scans by an exact set-similarity join.

A block is a window of consecutive words, over line ends, as long as the template
in question with its repeated words, and an eighth more. A block matches a
template when it holds at least ``NUM / DEN`` of the template's distinct words
(containment) and all of its telling words, if it has any. Words are put into one
global order, rarest in the corpus first, and

* *prefix filter*: a matching block holds one of the template's first
  ``|T| - o + 1`` words, o being the overlap that is needed. Documents without
  any such word take no further part; each place of such a word in the others
  meets the templates in an equi-join on the word (the templates are a fixed
  list, broadcast);
* *length filter*: the words around that place, a window's length to each side,
  must hold o words of the template;
* *positional filter*: the word must be the block's first one in the global order,
  and the template must have o words left from it.

Only pairs that pass have the overlap of each window around the place counted. Long
texts are cut into overlapping stretches of words first, so that a row stays bounded. Separately, fixed
phrases are located in the whole text. Only Spark SQL functions are used.

Defined results: null and empty texts have no words, labels or places and
score 0; repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkup.llm.common import lower_ascii

NUM, DEN = 9, 10
SLACK = 8  # a window is longer than its template by one SLACK-th
STRETCH = 2_000  # words of a text that one row holds, besides a window to each side
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Notices and opening paragraphs of public licences.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
               "in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

# Words without which a block is no notice of that licence.
TELLING = {"lgpl": ["lesser"]}


def all_words(text: str) -> list[str]:
    """A template's words (ASCII texts), in reading order."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def template_words(text: str) -> list[str]:
    """A template's distinct words, in reading order."""
    return list(dict.fromkeys(all_words(text)))


def window_of(text: str) -> int:
    """The number of words of the blocks that are compared with a template."""
    n = len(all_words(text))
    return n + n // SLACK


def needed(size: int, num: int = NUM, den: int = DEN) -> int:
    return -(-num * size // den)


def words_of(text) -> Column:
    return F.array_remove(F.split(text, BREAKS), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def global_order(docs: DataFrame, vocabulary: list[str], text_col: str) -> list[str]:
    """The templates' words, rarest first by how many documents hold them.
    Other words are in no template and need no place in the order."""
    words = words_of(lower_ascii(F.col(text_col)))
    counts = {r["w"]: r["n"] for r in (
        docs.select(F.explode(F.array_intersect(words, _strings(vocabulary))).alias("w"))
        .groupBy("w").agg(F.count("*").alias("n")).collect())}  # one row per template word at most
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _places(words: Column, phrase: str) -> Column:
    """Indices at which the phrase's words stand one after the other."""
    parts = phrase.split(" ")

    def here(i):
        cond = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            cond = cond & (F.get(words, i + k) == p)
        return cond

    return F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)


def license_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None,
                 num: int = NUM, den: int = DEN, stretch: int = STRETCH) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for _, t in templates for w in all_words(t)})
    order = {w: k for k, w in enumerate(global_order(docs, vocabulary, text_col))}
    index, prefix_words, reach = [], set(), max((window_of(t) for _, t in templates), default=1)
    for number, (label, text) in enumerate(templates):
        t = sorted(template_words(text), key=order.__getitem__)
        o = needed(len(t), num, den)
        prefix = t[:len(t) - o + 1]
        prefix_words.update(prefix)
        index += [(w, number, label, t, TELLING.get(label, []), o, window_of(text), len(t) - k)
                  for k, w in enumerate(prefix)]
    index = spark.createDataFrame(index, "token string, template int, label string, t array<string>, telling array<string>, "
                                         "o int, width int, rest int")
    prefix_words = sorted(prefix_words)

    low = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    base = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                        low.alias("low"), words_of(low).alias("words")))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    base = base.withColumn("n_words", F.size("words").cast("long")).withColumn("joined", joined)
    nowhere = F.array().cast("array<int>")
    for k, (phrase, _) in enumerate(PHRASES):
        base = base.withColumn(f"p{k}", F.when(F.col("joined").contains(f" {phrase} "),
                                               _places(F.col("words"), phrase)).otherwise(nowhere))
    spots = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    named = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))

    base = base.select(
        "row", "doc_id", "n_words", F.size(spots).cast("long").alias("n_base"),
        F.array_min(spots).cast("long").alias("first_word"), F.array_max(spots).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(named)).alias("base"),
        F.when(F.arrays_overlap("words", _strings(prefix_words)), F.col("words")).alias("words"))

    # stretches of words, and in each the places of prefix words with the words around them
    def stretch_at(k):
        start = F.greatest(k * stretch - reach, F.lit(0))
        return F.struct((k * stretch - start).alias("first"),
                        F.slice("words", start + 1, (k + 1) * stretch + reach - start).alias("ws"))

    n_stretches = F.floor((F.size("words") - 1) / stretch).cast("int")
    parts = base.withColumn("part", F.explode_outer(F.transform(F.sequence(F.lit(0), n_stretches), stretch_at))).drop("words")
    ws, first = F.col("part.ws"), F.col("part.first")
    places = F.array_compact(F.transform(ws, lambda w, i: F.when(
        w.isin(*prefix_words) & (i >= first) & (i < first + stretch),
        F.struct(w.alias("token"), F.least(i, F.lit(reach - 1)).alias("at"),
                 F.slice(ws, F.greatest(i - reach + 1, F.lit(0)) + 1,
                         F.least(i, F.lit(reach - 1)) + reach).alias("around")))))
    cand = parts.withColumn("place", F.explode_outer(places)).drop("part").select("*", "place.*").drop("place")
    met = cand.join(F.broadcast(index), "token", "left")

    def common(start):
        return F.array_intersect("t", F.slice("around", start + 1, F.col("width")))  # in the template's order

    starts = F.filter(F.sequence(F.greatest(F.col("at") - F.col("width") + 1, F.lit(0)), F.col("at")),
                      lambda i: F.array_contains("t", F.get("around", i)))
    counted = F.array_max(F.transform(F.transform(starts, common), lambda c: F.when(
        (F.get(c, F.lit(0)) == F.col("token")) & (F.size(F.array_intersect("telling", c)) == F.size("telling")),
        F.size(c)).otherwise(0)))
    passed = (F.col("rest") >= F.col("o")) & (F.size(F.array_intersect("t", "around")) >= F.col("o"))
    overlap = F.when(passed, counted)
    hit = F.col("overlap") >= F.col("o")
    rows = (met.withColumn("overlap", overlap)
            .groupBy("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base")
            .agg(F.collect_set(F.when(hit, F.col("label"))).alias("found"),
                 F.max(F.when(hit, F.col("overlap") / F.size("t"))).alias("best")))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                       F.array_join("base", ",").alias("base_labels"),
                       F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
                       F.coalesce("best", F.lit(0.0)).alias("score"))


def oracle_sql() -> str:
    """The same in DuckDB, with every window against every template."""
    words = "list_filter(string_split_regex(low, '%s'), lambda w: w <> '')" % BREAKS
    quote = lambda ws: "[" + ", ".join("'" + w + "'" for w in ws) + "]"
    phrases = ", ".join(f"({quote(p.split(' '))}, '{label}')" for p, label in PHRASES)
    listed = ", ".join(
        f"('{label}', {quote(template_words(t))}, {quote(TELLING.get(label, []))}::VARCHAR[], {window_of(t)}, "
        f"{needed(len(template_words(t)))})" for label, t in TEMPLATES)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
w AS (SELECT r, doc_id, low, {words} AS ws FROM d),
phrases(p, label) AS (VALUES {phrases}),
templates(label, ts, telling, width, o) AS (VALUES {listed}),
places AS (
  SELECT r, label, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + len(p)] = p)) AS pos FROM w, phrases),
base AS (
  SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS names
  FROM places GROUP BY r),
cand AS (SELECT r, ws, templates.* FROM w, templates WHERE len(list_intersect(ts, ws)) >= o),
best AS (
  SELECT r, label, o, len(ts) AS size, list_max(list_transform(
    list_filter(range(0, len(ws)), lambda i: list_contains(ts, ws[i + 1])),
    lambda i: CASE WHEN list_has_all(ws[i + 1:i + width], telling) THEN len(list_intersect(ts, ws[i + 1:i + width])) ELSE 0 END)) AS n
  FROM cand),
hits AS (SELECT r, label, n / size AS score FROM best WHERE n >= o),
found AS (SELECT r, list(DISTINCT label) AS names, max(score) AS score FROM hits GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.names), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.names, []), coalesce(found.names, [])))), ',') AS labels,
       CAST(coalesce(found.score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""
