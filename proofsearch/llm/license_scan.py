"""License scans: an exact set-similarity join of text blocks and notice templates, in DataFrame functions alone.

A block is BLOCK consecutive words of a text, and a new one begins every STEP words, so that a notice of up to
STEP words lies whole in a block however its lines are broken. As sets of words, a template is found in a block
that holds at least CONTAINMENT of its words. Tokens are ordered by their document frequency over the whole
table, rarest first. A block that holds o of a template's s words must hold one of the template's first
s - o + 1 (prefix filter), must have o of the templates' words itself (length filter), and from a shared word on
there must be enough left on both sides (positional filter). So blocks meet templates in an equi-join on prefix
tokens, and what passes the filters is counted in full: no block that reaches the threshold is missed. Of the
templates found in a block, one goes if another accounts for the same words and more, or for the same words more
wholly: a notice of CC BY-NC is not one of CC BY as well, nor the other way round.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import doc_columns, materialise

CONTAINMENT = 0.9
BLOCK, STEP = 64, 32
#: Texts with a notice are broadcast to the documents up to this many, and joined by a shuffle beyond.
BROADCAST_TEXTS = 200_000
#: Phrases of the base labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Notices as their licences word them, and the label of each.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: What stands between words, A-Z being in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"[0-9a-z]+", text.lower()))


def needed(size: int) -> int:
    """Words of a template of `size` that a block must hold."""
    return math.ceil(CONTAINMENT * size - 1e-9)


def word_line(text: Column) -> Column:
    """The words, lower-cased in A-Z, with one space between."""
    # the two letters (Kelvin sign, capital I with a dot) whose lower case is, or begins with, an ASCII letter
    plain = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    return F.trim(F.regexp_replace(F.lower(plain), BETWEEN, " "))


def _spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def _holds(line: Column, words: list[str]) -> Column:
    padded = F.concat(F.lit(" "), line, F.lit(" "))
    return reduce(lambda a, b: a | b, [F.contains(padded, F.lit(f" {w} ")) for w in words])


def token_order(lines: DataFrame, column: str) -> dict[str, int]:
    """Rank of each template word by the number of documents that hold it, rarest first, ties by the word."""
    vocabulary = sorted(frozenset().union(*(template_words(t) for _, t in TEMPLATES)))
    held = F.array_intersect(F.split(F.col(column), " "), F.array(*map(F.lit, vocabulary)))
    # bounded by the templates' vocabulary
    found = {r["w"]: r["n"] for r in lines.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (found.get(w, 0), w)))}


def _literal_rows(spark: SparkSession, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows)))


def found_notices(texts: DataFrame, rank: dict[str, int]) -> DataFrame:
    """labels, best (share) and n_links of each text (key, more: its digest; line: its words) that holds a notice."""
    spark = texts.sparkSession
    rows, index = [], []
    for k, (label, text) in enumerate(TEMPLATES):
        ranks = sorted(rank[w] for w in template_words(text))
        o = needed(len(ranks))
        rows.append((k, label, ranks, o))
        index += [(token, k, at) for at, token in enumerate(ranks[: len(ranks) - o + 1])]
    least = min(o for *_, o in rows)
    # both tables are bounded by the templates
    templates = F.broadcast(_literal_rows(spark, [F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.array(*map(F.lit, own)).alias("own"), F.lit(o).alias("o")) for k, label, own, o in rows]))
    prefixes = F.broadcast(_literal_rows(spark, [F.struct(F.lit(token).alias("token"), F.lit(k).alias("template"), F.lit(at).alias("t_at")) for token, k, at in index]))
    word_of = {k: w for w, k in rank.items()}
    ranks = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))])
    vocabulary = F.array(*map(F.lit, rank))

    # a lambda's variable is worked out once a text, what it stands for would be once a block
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    known = F.array(*[F.struct(F.array(*map(F.lit, sorted(template_words(text)))).alias("own"), F.lit(needed(len(template_words(text)))).alias("o")) for _, text in TEMPLATES])
    # a text that doesn't hold o words of a template has no block that does
    able = once(F.array_intersect(F.split("line", " "), vocabulary), lambda held: F.exists(known, lambda t: F.size(F.array_intersect(held, t["own"])) >= t["o"]))
    able = F.when(_holds(F.col("line"), sorted({word_of[token] for token, _, _ in index})), able).otherwise(False)
    held = lambda ws, i: F.array_sort(F.transform(F.array_intersect(F.slice(ws, i + 1, BLOCK), vocabulary), lambda w: ranks[w]))
    every = once(F.split("line", " "), lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 1, F.lit(STEP)), lambda i: held(ws, i)))
    blocks = texts.where(able).select("key", "more", F.posexplode(every).alias("block", "b")).where(F.size("b") >= least)
    probes = blocks.select("*", F.posexplode(F.slice("b", F.lit(1), F.size("b") - least + 1)).alias("b_at", "token"))
    met = probes.join(prefixes, "token").join(templates, "template")
    # shared words before this one, itself, and those after it
    most = F.least("b_at", "t_at") + 1 + F.least(F.size("own") - F.col("t_at") - 1, F.size("b") - F.col("b_at") - 1)
    met = met.where(most >= F.col("o")).withColumn("held", F.array_intersect("b", "own")).where(F.size("held") >= F.col("o"))
    # a group is bounded by the number of templates; repeated texts and tokens fall together
    match = F.struct("template", "label", "held", (F.size("held") / F.size("own").cast("double")).alias("share"))
    each = met.groupBy("key", "more", "block").agg(F.collect_set(match).alias("all"))
    better = lambda a, b: (F.size(F.array_except(a["held"], b["held"])) == 0) & ((F.size(b["held"]) > F.size(a["held"])) | (b["share"] > a["share"]))
    kept = each.select("key", "more", F.filter("all", lambda a: ~F.exists("all", lambda b: better(a, b))).alias("kept"))
    per = kept.select("key", "more", F.array_distinct(F.transform("kept", lambda m: m["label"])).alias("labels"), F.array_max(F.transform("kept", lambda m: m["share"])).alias("best"), F.size("kept").alias("n"))
    labels = per.select("key", "more", F.explode("labels").alias("label")).groupBy("key", "more").agg(F.collect_set("label").alias("found"))
    return per.groupBy("key", "more").agg(F.max("best").alias("best"), F.sum("n").alias("n_links")).join(labels, ["key", "more"])


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_links of every row.

    n_links counts the pairs of a block and a template that stay; score is the largest share of a template that
    a block holds, 1 with a base label, 0 without any label. A null or wordless text has no words, no labels and
    score 0. Each row is scanned for itself, so repeated rows agree; a null doc_id is kept. Texts of any length
    are read whole. An empty table gives no rows. Other columns are ignored.
    """
    rows = doc_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    lined = rows.select("doc_id", word_line(F.col("text")).alias("line"))
    lined = lined.select("*", F.xxhash64("line").alias("key"), F.xxhash64(F.lit(1), "line").alias("more"))
    notices = materialise(found_notices(lined, token_order(lined, "line")), "notices")

    out = lined.withColumn("n_words", F.when(F.col("line") == "", 0).otherwise(_spaces(F.col("line")) + 1))
    base = _holds(F.col("line"), list(PHRASES))
    # each word between two spaces of its own, so that phrases next to each other count apart
    out = out.withColumn("apart", F.when(base, F.concat(F.lit(" "), F.replace(F.col("line"), F.lit(" "), F.lit("  ")), F.lit(" "))).otherwise(F.lit(""))).drop("line")
    for k, phrase in enumerate(PHRASES):
        token = F.lit(f" {phrase.replace(' ', '  ')} ")
        size = len(phrase) + 2 + phrase.count(" ")
        n = ((F.octet_length("apart") - F.octet_length(F.replace(F.col("apart"), token, F.lit("")))) / size).cast("long")
        before, after = F.substring_index("apart", f" {phrase.replace(' ', '  ')} ", 1), F.substring_index("apart", f" {phrase.replace(' ', '  ')} ", -1)
        out = out.withColumn(f"n{k}", n)
        out = out.withColumn(f"first{k}", F.when(F.col(f"n{k}") > 0, (_spaces(before) / 2).cast("long")))
        out = out.withColumn(f"last{k}", F.when(F.col(f"n{k}") > 0, F.col("n_words") - (_spaces(after) / 2).cast("long") - (phrase.count(" ") + 1)))
    out = out.drop("apart").join(F.broadcast(notices) if notices.count() <= BROADCAST_TEXTS else notices, ["key", "more"], "left")
    n_base = sum((F.col(f"n{k}") for k in range(1, len(PHRASES))), F.col("n0"))
    own = F.array_compact(F.array(*[F.when(F.col(f"n{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.least(*[F.col(f"first{k}") for k in range(len(PHRASES))]).alias("first_word"),
        F.greatest(*[F.col(f"last{k}") for k in range(len(PHRASES))]).cast("long").alias("last_word"),
        listed(own).alias("base_labels"),
        listed(F.concat(own, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.round(F.when(n_base > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))), 6).alias("score"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def oracle() -> str:
    """The same by brute force: every block against every template."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"ws[i + {j}] = '{w}'" if j else f"ws[i] = '{w}'" for j, w in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: {test}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    values = ", ".join(f"({k}, '{label}', {sorted(template_words(t))!r}, {needed(len(template_words(t)))})" for k, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all({lower.format('text')}, {word}) AS ws FROM documents),
p AS (SELECT r, doc_id, len(ws) AS n_words, list_concat({places[0]}, list_concat({places[1]}, {places[2]})) AS places FROM d),
t(k, label, words, o) AS (VALUES {values}),
b AS (SELECT r, i, list_distinct(ws[i + 1 : i + {BLOCK}]) AS ws FROM (SELECT r, ws, unnest(range(0, len(ws), {STEP})) AS i FROM d)),
m AS MATERIALIZED (SELECT r, i, k, label, list_intersect(ws, words) AS held, len(list_intersect(ws, words)) / len(words)::DOUBLE AS share FROM b, t WHERE len(list_intersect(ws, words)) >= o),
kept AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.r = b.r AND a.i = b.i AND len(list_intersect(a.held, b.held)) = len(a.held) AND (len(b.held) > len(a.held) OR b.share > a.share))),
g AS (SELECT r, list_distinct(list(label)) AS labels, max(share) AS best, count(*) AS n FROM kept GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  list_min(list_transform(places, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(places, lambda x: x.at))::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda x: x.label), coalesce(g.labels, [])))), ','), '') AS labels,
  round(CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0) END, 6)::DOUBLE AS score, coalesce(n, 0)::BIGINT AS n_links
FROM p LEFT JOIN g USING (r)"""
