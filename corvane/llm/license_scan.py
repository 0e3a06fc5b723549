"""License scan: an exact set-similarity join of license templates with blocks of documents, in DataFrame functions alone.

A document's words are read in blocks of WINDOW words, each STRIDE after the one before, and templates in sections of at
most STRIDE words, so what a section says in one run stands whole in some block. A block meets a section if it holds enough
of the section's distinct words: containment, |block and section| / |section|.

All sets stand in one order, from the globally rarest word to the commonest, by the documents that hold it. Of a section of n
words of which it takes m, any block that meets it holds one of its first n - m + 1 words (the prefix), and that word is also
among the first |block| - m + 1 of the block. So prefixes are joined by equality; a pair goes on if the block is large enough
(length) and if what follows the shared word in both orders can still make m (position). What is left is counted in full.
Words that no section has can't count, so blocks hold the others alone; the sections' words, tables of fixed size, are
literals of the plan and their index is broadcast.

Beside that, fixed phrases are found wherever their words stand consecutively.

Texts are read once: what is written of a document are its number of words, what its phrases are, and where the words of
sections stand. Frequencies, blocks and the join are made from that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A word, before A-Z are lower-cased: anything but ASCII that is neither a letter nor a digit. Character by character, as the
#: engine looks single ones up in one table but tries ranges one after the other, which takes several times as long.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that are found word by word, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Wordings of public licenses, with the label of their family.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gnu", "This work is licensed under the GNU General Public License, version 3"),
    ("gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gnu", "You should have received a copy of the GNU General Public License along with this program"),
    ("mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("creative-commons", "Licensed under CC BY-NC 4.0"),
    ("creative-commons", "Licensed under CC BY 4.0"),
    ("creative-commons", "Licensed under CC BY-SA 4.0"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("proprietary", "No part of this publication may be reproduced or transmitted in any form or by any means without the prior written permission of the publisher"),
)

WINDOW, STRIDE = 32, 16
#: Percent of a section's words that a block must hold.
PERCENT = 90
#: Words of all templates together: they are literals of the plan and broadcast as an index.
MOST_WORDS = 20_000


def words_of(text: str) -> list[str]:
    """The words of a template: plain Python for the driver, as documents' words are read by ``WORD``."""
    folded = text.translate(str.maketrans(UPPER, LOWER))
    return "".join(c if c > "\x7f" or c.isdigit() or "a" <= c <= "z" else " " for c in folded).split(" ")


def sections(templates: Sequence[tuple[str, str]], stride: int = STRIDE) -> list[tuple[str, list[str]]]:
    """(label, distinct words) of each section: a template's words in pieces of nearly equal length, none over stride."""
    found = []
    for label, text in templates:
        words = [w for w in words_of(text) if w]
        parts = -(-len(words) // stride)
        for k in range(parts):
            piece = words[len(words) * k // parts : len(words) * (k + 1) // parts]
            found.append((label, list(dict.fromkeys(piece))))
    return found


def lowered(text: Column) -> Column:
    """A-Z alone in lower case; the engine's own folding does that, faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _list(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def words_in(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """rows: doc_id, text -> doc_id, n_words, at: the wanted words in order, each with its number among all words, from 0."""
    told = rows.select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    at = F.transform("words", lambda w, i: F.when(lowered(w).isin(list(wanted)), F.struct(i.alias("i"), lowered(w).alias("word"))))
    return told.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(at, lambda x: x.isNotNull()).alias("at"))


def _places(phrase: str) -> Column:
    """The numbers of the words where a phrase begins: its words are all in at, so where they're consecutive, they are so there."""
    first, *more = phrase.split()
    after = lambda j, k: F.get("at", j + k)
    here = lambda x, j: reduce(lambda c, kw: c & (after(j, kw[0])["word"] == kw[1]) & (after(j, kw[0])["i"] == x["i"] + kw[0]), enumerate(more, 1), x["word"] == first)
    return F.filter("at", here)["i"]


def phrases_in(told: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """told: doc_id, n_words, at -> these, n_base, first_word, last_word, base (labels)."""
    told = told.select("*", F.array(*[_places(p) for p, _ in phrases]).alias("places"))
    label = F.array_compact(F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.lit(x)) for k, (_, x) in enumerate(phrases)]))
    every = F.flatten("places")
    return told.select("doc_id", "n_words", "at", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), label.alias("base"))


def needed(words: Sequence[str], percent: int) -> int:
    """How many of a section's distinct words a block must hold."""
    return -(-percent * len(words) // 100)


def met_blocks(told: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """told: key, n_words, at (null: no block can meet) -> (key, label, containment) for every block and section that meet; a pair may come more than once."""
    spark, parts = told.sparkSession, sections(templates)
    vocabulary = sorted({w for _, ws in parts for w in ws})
    if not vocabulary:
        return told.select("key", F.lit("").alias("label"), F.lit(0.0).alias("containment")).where("false")
    told = told.where(F.col("at").isNotNull())
    held = told.select(F.explode(F.array_distinct(F.col("at")["word"])).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = {r["word"]: r["n"] for r in held.collect()}  # a number for each word of the templates
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index, prefix = [], set()
    for label, ws in parts:
        own = sorted(ws, key=rank.__getitem__)
        need = needed(own, percent)
        for place, word in enumerate(own[: len(own) - need + 1]):
            prefix.add(word)
            index.append((word, label, place, len(own), need, own))
    least = min(x[4] for x in index)
    entry = lambda x: F.struct(F.lit(x[0]).alias("word"), F.lit(x[1]).alias("label"), F.lit(x[2]).alias("place"), F.lit(x[3]).alias("n"), F.lit(x[4]).alias("need"), _list(x[5]).alias("section"))
    table = spark.range(1).select(F.inline(F.array(*map(entry, index))))
    # Only blocks with a word of a prefix are looked at, each from the first such word in it; j is that word's place in at.
    start = F.transform("at", lambda x, j: F.when(x["word"].isin(sorted(prefix)), F.struct(j.alias("j"), x["i"].alias("i"))))
    told = told.select("key", "at", F.filter(start, lambda x: x.isNotNull()).alias("starts"), F.greatest(F.ceil((F.col("n_words") - WINDOW) / F.lit(STRIDE)), F.lit(0)).cast("int").alias("last"))
    told = told.where(F.size("starts") > 0).withColumn("known", F.array_intersect(_list(order), F.col("at")["word"]))
    down = lambda i: F.floor(i / F.lit(STRIDE)).cast("int")

    def blocks_of(s: Column, t: Column) -> Column:
        low = F.greatest(down(s["i"] - WINDOW) + 1, down(F.coalesce(F.get("starts", t - 1)["i"], F.lit(-1))) + 1, F.lit(0))
        high = F.least(down(s["i"]), F.col("last"))
        near = F.slice("at", F.greatest(s["j"] - WINDOW + 1, F.lit(0)) + 1, 2 * WINDOW - 1)
        block = lambda k: F.array_intersect("known", F.filter(near, lambda x: (x["i"] >= k * STRIDE) & (x["i"] < k * STRIDE + WINDOW))["word"])
        return F.when(low <= high, F.transform(F.sequence(low, high), block)).otherwise(F.array().cast("array<array<string>>"))

    blocks = told.select("key", F.explode(F.flatten(F.transform("starts", blocks_of))).alias("block")).where(F.size("block") >= least)
    tried = blocks.select("key", "block", F.posexplode(F.slice("block", 1, F.size("block") - least + 1)).alias("at", "word"))
    size = F.size("block")
    possible = (size >= F.col("need")) & (F.least(F.col("n") - F.col("place"), size - F.col("at")) >= F.col("need"))
    pairs = tried.join(F.broadcast(table), "word").where(possible)
    shared = F.size(F.array_intersect("section", "block"))
    return pairs.select("key", "label", shared.alias("shared"), "n").where(F.col("shared") * 100 >= F.col("n") * percent).select("key", "label", (F.col("shared") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, for each row of docs.

    score is 1 where a phrase stands, else the largest containment of a section that a block meets, else 0. A null text is an
    empty one, without words, labels or places; very long texts are read whole, as one array of words in a task; repeated rows
    each give a row, also with null ids; labels don't repeat; an empty table gives an empty one; other columns are
    dropped, whatever their names.
    """
    parts = sections(templates)
    vocabulary = {w for _, ws in parts for w in ws}
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} distinct words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    told = phrases_in(words_in(rows, sorted(vocabulary.union(*(p.split() for p, _ in phrases)))), phrases)
    least = min((needed(ws, percent) for _, ws in parts), default=0)
    some = F.when(F.size(F.array_distinct(F.col("at")["word"])) >= least, F.col("at"))
    told = materialize(told.withColumn("at", some).withColumn("key", F.monotonically_increasing_id()), "licenses")
    found = met_blocks(told, templates, percent).groupBy("key").agg(F.collect_set("label").alias("met"), F.max("containment").alias("most"))
    both = told.drop("at").join(found, "key", "left")
    every = F.array_union("base", F.coalesce("met", F.array().cast("array<string>")))
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.array_distinct("base")).alias("base_labels"), listed(every).alias("labels"), score.alias("score"))
