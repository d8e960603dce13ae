"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are lines, sets are their distinct words.  A template is found in a block that has at least ``THRESHOLD`` of the
template's distinct words.  Words are ordered by the number of blocks they occur in, rare ones first, counted over all
documents.  Of two sets that share enough words, the first shared one lies early in both orders: only the first words of
a template are looked up, in the first words of blocks that have enough words at all (prefix and length filters), and
only where the words behind it suffice for what is still needed (positional filter).  Candidates are verified exactly.

Besides, fixed phrases give labels wherever their words stand one after the other.  Words are runs of ASCII letters,
digits and characters beyond ASCII, with A-Z in lower case.  Only words of templates ever matter to the join, so nothing
that is broadcast or brought to the driver grows with the corpus: it is bounded by the templates.

Defined results: null and empty texts have no words and no labels ('' for both, score 0); repeated rows count alike.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, row_key, settled, text_or_empty

THRESHOLD = 0.8

# fixed values: phrases with their labels, and wordings of notices
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
              "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_IN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
# capitals are word characters before they are folded
_BREAK_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_IN_WORD_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _folded(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.filter(F.split(_folded(text), f"{_BREAK}+"), lambda w: w != "")


def template_words(text: str) -> list[str]:
    folded = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    return sorted(set("".join(c if c.isalnum() or ord(c) > 127 else " " for c in folded).split()))


def need(size: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(round(threshold * size, 9))


def with_phrases(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and __base (labels, sorted)."""
    text = text_or_empty("text")
    spelled = {p: p.split(" ") for p in phrases}
    any_of = "|".join(f"{_BREAK_ANY}+".join(p) for p in spelled.values())
    has_one = text.rlike(f"(?i)(?<!{_IN_WORD_ANY})(?:{any_of})(?!{_IN_WORD_ANY})")

    def places(w: Column) -> Column:
        def of(phrase: list[str]) -> Column:
            starts = F.when(F.size(w) >= len(phrase), F.sequence(F.lit(0), F.size(w) - len(phrase))).otherwise(
                F.array().cast("array<int>"))
            for k, word in enumerate(phrase):
                starts = _following(starts, w, k, word)
            return starts

        return F.array(*(of(p) for p in spelled.values()))

    found = F.when(has_one, bound(words(text), places))
    df = docs.withColumns({"n_words": F.regexp_count(text, F.lit(f"{_IN_WORD_ANY}+")).cast("long"), "__found": found})
    every = F.coalesce(F.flatten("__found"), F.array().cast("array<int>"))
    labels = [F.when(F.size(F.get("__found", F.lit(k))) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
              for k, label in enumerate(phrases.values())]
    return df.withColumns({
        "n_base": F.size(every).cast("long"), "first_word": F.array_min(every).cast("long"),
        "last_word": F.array_max(every).cast("long"),
        "__base": F.array_sort(F.array_distinct(F.flatten(F.array(*labels))))}).drop("__found")


def _following(starts: Column, w: Column, k: int, word: str) -> Column:
    def hit(i: Column) -> Column:
        return F.get(w, i + k) == word

    return F.filter(starts, hit)


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(__k1, __k2, pos, label, containment) of every line of every text that holds a template."""
    spark = docs.sparkSession
    sets = [(label, template_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    least = min(need(len(s), threshold) for _, s in sets)
    k1, k2 = row_key("doc_id", "text")
    lines = docs.select(k1.alias("__k1"), k2.alias("__k2"), F.posexplode(F.split(text_or_empty("text"), "\n", -1)).alias("pos", "line"))

    def in_templates(w: Column) -> Column:
        return w.isin(*vocabulary)

    hits = F.array_distinct(F.filter(F.split(_folded(F.col("line")), f"{_BREAK}+"), in_templates))
    blocks = settled(lines.withColumn("words", hits).filter(F.size("words") >= least).select("__k1", "__k2", "pos", "words"), "blocks")
    counts = dict(blocks.select(F.explode("words").alias("w")).groupBy("w").count().collect())  # words of templates
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for k, (label, s) in enumerate(sets):
        ordered = sorted(s, key=rank.get)
        n = need(len(s), threshold)
        index += [(w, k, i, len(s), n) for i, w in enumerate(ordered[:len(s) - n + 1])]
    index = F.broadcast(spark.createDataFrame(index, "word string, template int, tpos int, tsize int, need int"))
    whole = F.broadcast(spark.createDataFrame([(k, label, s) for k, (label, s) in enumerate(sets)],
                                              "template int, label string, twords array<string>"))
    ranked = blocks.withColumn("words", F.array_intersect(F.array(*map(F.lit, order)), "words"))  # in the order of the first
    probes = ranked.select("__k1", "__k2", "pos", "words", F.size("words").alias("size"), F.posexplode("words").alias("bpos", "word"))
    met = probes.join(index, "word").filter(
        (F.col("size") >= F.col("need")) & (F.col("bpos") <= F.col("size") - F.col("need"))
        & (F.least(F.col("tsize") - F.col("tpos"), F.col("size") - F.col("bpos")) >= F.col("need")))
    met = met.join(whole, "template").withColumn("common", F.size(F.array_intersect("words", "twords"))).filter("common >= need")
    return met.groupBy("__k1", "__k2", "pos", "label").agg(F.max(F.col("common") / F.col("tsize")).alias("containment"))


def scanned(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score: the largest
    containment of a template found, or 1 where a phrase stands."""
    found = matches(docs, templates, threshold).groupBy("__k1", "__k2").agg(
        F.collect_set("label").alias("__labels"), F.max("containment").alias("__best"))  # at most all labels
    k1, k2 = row_key("doc_id", "text")
    rows = with_phrases(docs.select("doc_id", "text"), phrases).withColumns({"__k1": k1, "__k2": k2}).drop("text")
    rows = rows.join(found, ["__k1", "__k2"], "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("__base", F.coalesce("__labels", none)))
    score = F.when(F.size("__base") > 0, 1.0).otherwise(F.coalesce("__best", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"),
                       F.array_join(labels, ",").alias("labels"), score.alias("score"))


def sql() -> str:
    """The same over a table documents, template by template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    fold = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

    def starts(phrase: str) -> str:
        parts = phrase.split(" ")
        test = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        return f"list_filter(range(0, len(w) - {len(parts) - 1}), lambda i: {test})"

    values = ", ".join(f"('{label}', [{', '.join(repr(w) for w in template_words(text))}])" for label, text in TEMPLATES)
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({fold.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
p AS (SELECT *, {', '.join(f'{starts(x)} AS p{k}' for k, x in enumerate(PHRASES))} FROM d),
b AS (SELECT doc_id, len(w) AS n_words, {every} AS every,
  list_sort(list_distinct(list_filter([{base}], lambda x: x IS NOT NULL))) AS base FROM p),
t(label, tw) AS (VALUES {values}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
s AS (SELECT doc_id, list_distinct(regexp_extract_all({fold.format('line')}, '{word}')) AS lw FROM l),
f AS (SELECT doc_id, label, max(len(list_intersect(lw, tw)) / len(tw)) AS c FROM s, t
  WHERE len(list_intersect(lw, tw)) >= ceil(round({THRESHOLD} * len(tw), 9)) GROUP BY doc_id, label),
g AS (SELECT doc_id, list(label) AS found, max(c) AS best FROM f GROUP BY doc_id)
SELECT b.doc_id, n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM b LEFT JOIN g ON b.doc_id = g.doc_id"""
