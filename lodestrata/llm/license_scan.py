"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A template's token set T meets a block B if at least THRESHOLD per cent of T are in B.
Blocks are stretches of 2 * span words that begin at every multiple of span, where span
is the power of two at or above the words of the template; so any stretch of as many words lies
whole in one block.  All tokens of templates are counted over the whole corpus and ordered
by rising count.  Then three filters leave out what can't meet:

prefix: T and B share a token among the first |T| - need + 1 and |B| - need + 1 in that order;
length: B has need tokens of templates at least;
positional: behind their first shared token both have enough left to come to need.

The pairs that are left are counted exactly, so the result is that of comparing everything.
DataFrame functions only.  Tokens outside the templates can't change a containment and are
left out early.  Texts of any length are cut into pieces between words.

Null texts count as empty; rows that repeat or have no doc_id are rows like all others;
further columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Per cent of a template's tokens that a block must hold.
THRESHOLD = 90

#: Characters of a piece of a text, about: words are never cut.
PIECE_CHARS = 1 << 20

#: Templates beyond so many tokens in all are joined by shuffle.
BROADCAST_TOKENS = 100_000

# What the contract counts as a base place, and its label.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Wording of the licenses themselves, in lower case without marks.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc", "licensed under cc by 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """The words of a text in lower case (A-Z only), joined by single spaces."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.trim(F.regexp_replace(lower, _SEPARATORS, " "))


def word_count(words: Column) -> Column:
    """Words of a text of plain_words()."""
    return F.when(words == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "))) + 1).cast("long")


def _places(words: Column, n: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often the phrase's words stand consecutively, and their first and last start.

    Words get a space on each side of their own, so places next to each other are told
    apart.  The phrase must not overlap itself.
    """
    parts = phrase.split()
    if any(parts[k:] == parts[: len(parts) - k] for k in range(1, len(parts))):
        raise ValueError(f"{phrase!r} overlaps itself")
    spaced = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    key = " " + "  ".join(parts) + " "
    some = words.contains(phrase)
    count = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" ")))) / 2
    times = F.when(some, (F.length(spaced) - F.length(F.replace(spaced, F.lit(key), F.lit("")))) / len(key)).otherwise(0).cast("long")
    first = F.when(some & (times > 0), count(F.substring_index(spaced, key, 1)).cast("long"))
    last = F.when(some & (times > 0), n - len(parts) - count(F.substring_index(spaced, key, -1)).cast("long"))
    return times, first, last


def _pieces(words: Column) -> Column:
    """Pieces of a text with the number of words before each, and whether there are others; none cuts a word."""
    cut = F.when(F.length(words) <= PIECE_CHARS, F.array(words)).otherwise(F.regexp_extract_all(words, F.lit(f"(?s).{{1,{PIECE_CHARS}}}[^ ]*"), F.lit(0)))
    trimmed = F.transform(cut, lambda p: F.trim(p))
    sizes = F.transform(trimmed, lambda p: word_count(p))
    return F.transform(trimmed, lambda p, k: F.struct(p.alias("piece"), F.aggregate(F.slice(sizes, 1, k), F.lit(0).cast("long"), lambda a, x: a + x).alias("before"), (F.size(cut) > 1).alias("more")))


def _literal_rows(df: DataFrame, rows: list[dict]) -> DataFrame:
    """A table of literals."""
    spark = df.sparkSession
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in r.items())) for r in rows))))


def template_tokens(templates: list[tuple[str, str]], percent: int) -> list[dict]:
    """Each template by its number: label, distinct tokens, span of its blocks, and tokens needed."""
    out = []
    for number, (label, text) in enumerate(templates):
        words = [w for w in re.split(_SEPARATORS, text.translate(str.maketrans(_UPPER, _LOWER))) if w]
        if not words:
            raise ValueError(f"template {number} has no words")
        tokens = sorted(set(words))
        out.append({"template": number, "label": label, "tokens": tokens, "span": 1 << (len(words) - 1).bit_length(), "need": -(-len(tokens) * percent // 100)})
    return out


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = THRESHOLD) -> DataFrame:
    """Every block that meets a template: key, template, label, first_word, n_words, overlap, containment.

    docs: key, words (of plain_words()); equal keys stand for equal words.
    """
    known = template_tokens(templates, percent)
    tokens = sorted({t for x in known for t in x["tokens"]})
    hint = F.broadcast if sum(len(x["tokens"]) for x in known) <= BROADCAST_TOKENS else (lambda df: df)

    # Counts over the whole corpus decide the order; there is one for each template token, however large the corpus.
    split = lambda df: df.select("key", F.inline(_pieces(F.col("words"))))
    counted = split(docs).select(F.explode(F.split("piece", " ")).alias("token")).join(hint(_literal_rows(docs, [{"token": t} for t in tokens])), "token")
    count = {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = {t: k for k, t in enumerate(sorted(tokens, key=lambda t: (count.get(t, 0), t)))}
    for x in known:
        x["tokens"] = sorted(x["tokens"], key=order.get)
        x["prefix"] = len(x["tokens"]) - x["need"] + 1
    heads = [{"span": x["span"], "rank": order[t], "template": x["template"], "at": k} for x in known for k, t in enumerate(x["tokens"][: x["prefix"]])]
    least = {s: min(x["need"] for x in known if x["span"] == s) for s in {x["span"] for x in known}}
    rare = F.array(*(F.lit(t) for t in sorted({t for x in known for t in x["tokens"][: x["prefix"]]})))

    # Blocks of the texts that hold a prefix token; of a text in several pieces any may.
    postings = _literal_rows(docs, [{"token": t, "rank": order[t], "span": s, "least": least[s]} for s in least for t in sorted({t for x in known if x["span"] == s for t in x["tokens"]})])
    near = split(docs).where(F.col("more") | F.arrays_overlap(F.split("piece", " "), rare))
    placed = near.select("key", "before", F.posexplode(F.split("piece", " ")).alias("at", "token")).join(hint(postings), "token")
    place = F.col("before") + F.col("at")
    spread = placed.withColumn("block", F.explode(F.array(F.floor(place / F.col("span")), F.floor(place / F.col("span")) - 1))).where("block >= 0")
    blocks = spread.groupBy("key", "span", "least", "block").agg(F.sort_array(F.collect_set("rank")).alias("ranks")).where(F.size("ranks") >= F.col("least"))  # length filter

    # Prefix filter on both sides; the first shared token decides by its two positions.
    prefix = blocks.select("key", "span", "block", "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - F.col("least") + 1)).alias("b_at", "rank"))
    sides = _literal_rows(docs, [{"template": x["template"], "label": x["label"], "need": x["need"], "size": len(x["tokens"])} for x in known])
    sets = F.array(*(F.array(*(F.lit(order[t]) for t in x["tokens"])) for x in known))
    met = prefix.join(hint(_literal_rows(docs, heads)), ["span", "rank"])
    first = met.groupBy("key", "span", "block", "template").agg(F.min("at").alias("at"), F.min("b_at").alias("b_at"), F.first("ranks").alias("ranks"))
    near_enough = F.least(F.col("size") - F.col("at"), F.size("ranks") - F.col("b_at")) >= F.col("need")  # positional filter
    left = first.join(hint(sides), "template").where(near_enough)
    overlap = F.size(F.array_intersect("ranks", F.element_at(sets, F.col("template") + 1)))
    return (
        left.withColumn("overlap", overlap)
        .where(F.col("overlap") >= F.col("need"))
        .select("key", "template", "label", (F.col("block") * F.col("span")).cast("long").alias("first_word"), (2 * F.col("span")).cast("long").alias("n_words"), "overlap", (F.col("overlap") / F.col("size")).alias("containment"))
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = THRESHOLD, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    n_base counts the places of all phrases, first_word and last_word are their smallest
    and largest start (null: none).  labels adds those of templates that a block meets;
    blocks lists these (label, template, first_word, n_words, containment), and score is the largest containment,
    1 where a phrase stands, 0 where nothing is found.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.sha2(text, 256).alias("digest")).alias("key"), plain_words(text).alias("words"))
    n = F.col("n_words")
    based = own.withColumn("n_words", word_count(F.col("words")))
    spots = [_places(F.col("words"), n, phrase) for phrase, _ in phrases]
    lowest = lambda f, x: f(*x) if len(x) > 1 else x[0]
    named = F.filter(F.array(*(F.when(t > 0, F.lit(label)) for (t, _, _), (_, label) in zip(spots, phrases, strict=True))), lambda x: x.isNotNull())
    base = based.select(
        "doc_id", "key", "n_words", sum((t for t, _, _ in spots), F.lit(0).cast("long")).alias("n_base"), lowest(F.least, [a for _, a, _ in spots]).alias("first_word"),
        lowest(F.greatest, [b for _, _, b in spots]).alias("last_word"), F.array_sort(F.array_distinct(named)).alias("base"),
    )
    found = matches(own.select("key", "words"), templates, percent)
    each = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("label", "template", "first_word", "n_words", "containment"))).alias("blocks"))
    merged = base.join(materialise(each, "license-blocks"), "key", "left")
    blocks = F.coalesce(F.col("blocks"), F.array().cast("array<struct<label:string,template:int,first_word:bigint,n_words:bigint,containment:double>>"))
    labels = F.array_sort(F.array_union("base", F.transform(blocks, lambda b: b["label"])))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(blocks, lambda b: b["containment"])), F.lit(0.0)))
    return merged.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), blocks.alias("blocks"))
