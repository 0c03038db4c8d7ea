"""License notices in texts: an exact set-similarity join of word blocks with templates."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, text_of

# Phrases whose places are counted, with their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# The wording of common notices, with their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's words that a block must hold.
THRESHOLD = 0.9
#: Words from the start of a block to that of the next; a block has twice as many.
STRIDE = 24
#: Most words of all templates together, which every task holds.
MAX_TOKENS = 10_000


def words_of(text: Column) -> Column:
    """The words of a text, only A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _places(words: Column, phrase: str) -> Column:
    """Starts (words from 0) of a phrase; the search runs only where a text has all its words."""
    parts = phrase.split()
    there = reduce(lambda a, b: a & b, [F.array_contains(words, p) for p in sorted(set(parts), key=len, reverse=True)])
    at = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), at)
    return F.when(there & (F.size(words) >= len(parts)), starts).otherwise(F.array().cast("array<int>"))


def _noted(docs: DataFrame, phrases: list[tuple[str, str]], tokens: list[str]) -> DataFrame:
    """One row a document: word count, places of phrases, and every STRIDE words' template words."""
    w = F.col("w")
    read = docs.select(docs["doc_id"].alias("doc_id"), F.explode(F.array(words_of(text_of(docs)))).alias("w"))
    chunk = lambda s: F.filter(F.slice(w, s, F.lit(STRIDE)), lambda x: x.isin(tokens))
    chunks = F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w), F.lit(STRIDE)), chunk))
    found = F.array(*[F.struct(F.lit(label).alias("label"), _places(w, p).alias("at")) for p, label in phrases])
    placed = read.select("doc_id", F.size("w").cast("long").alias("n_words"), chunks.alias("chunks"), F.explode(F.array(found)).alias("found"))
    every = F.flatten(F.transform("found", lambda f: f["at"]))
    rows = placed.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "chunks",
        F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda f: F.size(f["at"]) > 0), lambda f: f["label"]))).alias("base"),
    )
    return materialize(rows, "license_words")


def _ordered(noted: DataFrame, tokens: list[str]) -> list[str]:
    """Template words by rising number of occurrences in the corpus; as many rows as ``tokens`` reach the driver."""
    counts = noted.select(F.explode(F.flatten("chunks")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    seen = {r["t"]: r["n"] for r in counts.collect()}
    return sorted(tokens, key=lambda t: (seen.get(t, 0), t))


def matching_blocks(noted: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """``(row, block, template, label, containment)`` of every block and template that meet the threshold.

    Words count by their place in the global order, rarest first. A template's prefix is so long that a block
    without any of its words misses the threshold; of a block, the words that could be the first common one
    are joined with the prefixes. Length and place of that word bound the overlap; survivors are verified.
    """
    words = [sorted(set(t.split())) for _, t in templates]
    order = _ordered(noted, sorted({x for t in words for x in t}))
    rank = {t: i + 1 for i, t in enumerate(order)}
    rows = []
    for number, ((label, _), own) in enumerate(zip(templates, words, strict=True)):
        ranks, need = sorted(rank[x] for x in own), ceil(threshold * len(own) - 1e-9)
        rows += [(ranks[i], number, label, i, len(own), need, ranks) for i in range(len(own) - need + 1)]
    spark = noted.sparkSession
    prefixes = spark.createDataFrame(rows, "token long, template int, label string, i int, size int, need int, ranks array<long>")
    least = min(r[5] for r in rows)
    heads = sorted({r[0] for r in rows})

    in_order = F.array(*[F.lit(t) for t in order])
    both = lambda i: F.concat(F.get("chunks", i), F.coalesce(F.get("chunks", i + 1), F.array().cast("array<string>")))
    ranked = lambda ts: F.array_sort(F.transform(F.array_distinct(ts), lambda t: F.array_position(in_order, t)))
    held = F.transform(F.sequence(F.lit(0), F.size("chunks") - 1), lambda i: F.struct(i.alias("block"), both(i).alias("ts")))
    rare = [order[h - 1] for h in heads]
    likely = F.filter(held, lambda b: (F.size(b["ts"]) >= least) & F.exists(b["ts"], lambda t: t.isin(rare)))
    blocks = noted.where(F.size("chunks") > 0).select("row", F.explode(likely).alias("b")).select("row", "b.block", ranked(F.col("b.ts")).alias("b"))
    n = F.size("b")
    first = blocks.where(n >= least).select("row", "block", "b", F.posexplode(F.slice("b", F.lit(1), n - least + 1)).alias("j", "token"))
    able = (F.col("j") <= n - F.col("need")) & (1 + F.least(F.col("size") - 1 - F.col("i"), n - 1 - F.col("j")) >= F.col("need"))
    near = first.join(F.broadcast(prefixes), "token").where(able)
    common = F.size(F.array_intersect("b", "ranks"))
    met = near.withColumn("common", common).where(F.col("common") >= F.col("need"))
    return met.select("row", "block", "template", "label", (F.col("common") / F.col("size")).alias("containment")).distinct()


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row of ``docs``.

    ``n_base`` counts the places where a phrase's words stand consecutively, ``first_word`` and ``last_word``
    are the smallest and largest start (null without one). A block is twice STRIDE words, every STRIDE words,
    so that any run of STRIDE + 1 words lies in one; a template that is longer raises ValueError. ``labels`` adds
    those of the templates of which a block holds ``threshold`` or more of the words. The score is 1 with a phrase, else the
    greatest containment that meets the threshold, else 0.

    Null texts count as empty and have no words; rows that repeat a doc_id, or have none, are documents of their own; other columns
    are ignored; an empty table gives an empty result.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    tokens = sorted({x for _, t in templates for x in t.split()})
    if any(len(t.split()) > STRIDE + 1 for _, t in templates) or len(tokens) > MAX_TOKENS:
        raise ValueError(f"templates have at most {STRIDE + 1} words each and {MAX_TOKENS} together")
    noted = _noted(docs, phrases, tokens)
    best = matching_blocks(noted, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return noted.drop("chunks").join(best, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
