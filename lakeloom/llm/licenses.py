"""License scans: an exact containment join of text blocks with license templates, with DataFrame functions only.

A template's tokens, and a text's, are its pairs of neighbouring words, so order counts and line breaks don't. A block is a window of a
text, as long as the template and so much longer that the template would still be THRESHOLD of it. It matches when it holds at least
THRESHOLD of the template's tokens, and as much of those that no template of another label has: "released under the apache license" holds
most of what is said of another license, but not what names it.

The join: a text's tokens are exploded and meet the templates' tokens in a hash join, so a token costs the same however many templates
there are; what meets none goes at once. Tokens are ordered by how often the corpus has them, rarest first, over all documents. By that
order a match must hold one of the template's first few tokens (prefix filter); the text must have enough tokens at all (length filter);
and from the first prefix token that it holds, enough of the template's must remain (positional filter). Pairs of a document and a
template that pass are counted exactly, window by window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.shared import saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as their licences' texts have them, and the label of each.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
_FRAME = 1 << 24  # windows of different lengths share one frame: places are scaled by it over the length


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(text.split()))


def template_tokens(text: str) -> list[str]:
    """The distinct pairs of neighbouring words, in the text's order."""
    found = text.split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(found[:-1], found[1:], strict=True)))


def needed(count: int) -> int:
    """The fewest of so many tokens that meet the threshold."""
    return math.ceil(THRESHOLD * count - 1e-9)


def window(text: str) -> int:
    """Words of a template's window: as many as the template has, and so many more that they'd be the threshold of it."""
    return math.ceil(len(text.split()) / THRESHOLD - 1e-9)


def lowered(text: Column) -> Column:
    """A-Z lower-cased; other letters stay. Where all characters are ASCII the faster function does the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _token_rows(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, pos, token): each row's first place, with or without a known token, and every other place that has one."""
    found = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0)).alias("ws"))
    pairs = F.zip_with(F.col("ws"), F.slice("ws", 2, F.greatest(F.size("ws"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))  # the last has no neighbour and is null
    placed = found.select("row", "doc_id", F.size("ws").cast("long").alias("n_words"), F.posexplode_outer(pairs).alias("pos", "pair"))
    return placed.join(F.broadcast(vocabulary), "pair", "left").filter("token is not null or pos = 0 or pos is null").select("row", "doc_id", "n_words", "pos", "token")


def _base(hits: DataFrame, number: dict[str, int]) -> DataFrame:
    """(row, n_base, first_word, last_word, base_labels): the places where all pairs of a phrase stand one after another."""
    steps = [(n, label, number[pair], k, len(phrase.split()) - 1) for n, (phrase, label) in enumerate(PHRASES.items()) for k, pair in enumerate(template_tokens(phrase))]
    table = hits.sparkSession.createDataFrame(steps, "phrase int, label string, token int, step int, steps int")
    places = hits.join(F.broadcast(table), "token").groupBy("row", "phrase", "label", "steps", (F.col("pos") - F.col("step")).alias("at")).count().filter("count = steps")
    return places.groupBy("row").agg(F.count("*").alias("n_base"), F.min("at").cast("long").alias("first_word"), F.max("at").cast("long").alias("last_word"), F.collect_set("label").alias("base"))


def _matches(hits: DataFrame, templates: list[tuple[str, str]], number: dict[str, int], counts: dict[int, int]) -> DataFrame:
    """(row, template, label, word, share) of each window that meets its template, by the place of its first token."""
    spark, entries, prefixes = hits.sparkSession, [], []
    owners: dict[str, set[str]] = {}
    for label, text in templates:
        for token in template_tokens(text):
            owners.setdefault(token, set()).add(label)
    for n, (label, text) in enumerate(templates):
        tokens = sorted(template_tokens(text), key=lambda t: (counts.get(number[t], 0), t))  # the global order
        own = [t for t in tokens if owners[t] == {label}]
        span = window(text) - 1
        scale = _FRAME // (span - 1) if span > 1 else _FRAME + 1
        need = needed(len(tokens))
        entries += [(number[t], n, label, t in own, len(tokens), need, needed(len(own)), scale) for t in tokens]
        prefixes += [(number[t], n, place, len(tokens), need) for place, t in enumerate(tokens[: len(tokens) - need + 1])]
    prefix = spark.createDataFrame(prefixes, "token int, template int, place int, tokens int, need int")
    first = hits.join(F.broadcast(prefix), "token").groupBy("row", "template", "tokens", "need").agg(F.min("place").alias("place"), F.max("n_words").alias("n_words"))
    may = first.filter("n_words - 1 >= need and tokens - place >= need").select("row", "template")
    every = spark.createDataFrame(entries, "token int, template int, label string, own boolean, tokens int, need int, need_own int, scale int")
    held = hits.join(F.broadcast(every), "token").join(may, ["row", "template"], "left_semi")
    block = Window.partitionBy("row", "template").orderBy(F.col("pos").cast("long") * F.col("scale")).rangeBetween(0, _FRAME)
    held = held.withColumn("held", F.size(F.collect_set("token").over(block))).withColumn("held_own", F.size(F.collect_set(F.when(F.col("own"), F.col("token"))).over(block)))
    return held.filter("held >= need and held_own >= need_own").select("row", "template", "label", F.col("pos").alias("word"), (F.col("held") / F.col("tokens")).alias("share"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """The license phrases and template blocks of each row's whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels (of the phrases, and of every template that a block meets),
    score (the highest containment of a template in a block; 1 where a base phrase stands) and blocks (label, share, and the place of the
    first word, of each window that meets a template). A null text counts as empty: no words, no labels, score 0. Repeated rows and null
    identifiers stay as they are. Other columns are dropped, so their names can't clash. Templates have two words or more.
    """
    templates = TEMPLATES if templates is None else templates
    known = sorted({t for text in [*(t for _, t in templates), *PHRASES] for t in template_tokens(text)})
    number = {pair: n for n, pair in enumerate(known)}
    vocabulary = docs.sparkSession.createDataFrame(list(number.items()), "pair string, token int")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    placed = saved(_token_rows(rows, vocabulary), "license-tokens")  # the rows are numbered once
    texts = placed.filter("pos = 0 or pos is null").select("row", "doc_id", "n_words")
    hits = placed.filter("token is not null").select("row", "n_words", "pos", "token")
    counts = dict(hits.groupBy("token").count().collect())  # as many as the templates have tokens

    matches = _matches(hits, templates, number, counts).groupBy("row").agg(F.collect_set("label").alias("met"), F.max("share").alias("share"), F.sort_array(F.collect_list(F.struct("word", "label", "share"))).alias("blocks"))
    found = texts.join(_base(hits, number), "row", "left").join(matches, "row", "left")
    none = F.array().cast("array<string>")
    base, met = F.coalesce("base", none), F.coalesce("met", none)
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, met)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        "blocks",
    )
