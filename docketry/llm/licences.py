"""Licence scan by an exact set-similarity join with notice templates, in DataFrame functions only.

A text block is a stretch of ``BLOCK_WORDS`` words; blocks overlap by half, so a notice of up to half that length lies
whole in one. A template matches a block that holds at least ``CONTAINED`` of its different words. Template words are
ordered by how often they occur in all documents, rarest first. A block can only match if

* prefix: it has one of the template's ``size - needed + 1`` rarest words;
* length: it has at least ``needed`` different words;
* position: after the first common word in that order, template and block still have enough words to reach ``needed``.

The template table is a fixed list, so it travels inside the expression: a document is read where it lies, the words'
frequencies are the only shuffle (one row per template word and task), and no filter loses a match.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import plain

CONTAINED = 0.8
BLOCK_WORDS = 64

#: Phrases that name a licence by themselves, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording of common public licence notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def folded(text: Column) -> Column:
    """The text's words in lower case between single spaces, with a space at either end (two spaces if it has none).

    ``lower`` differs from lower-casing A-Z only in letters outside ASCII, of which the Kelvin sign alone would give an
    ASCII letter; it is made another letter first.
    """
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of a fixed short list occurs in all documents."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    words = docs.select(F.explode(F.split(folded(F.col("text")), " ")).alias("word"))
    met = words.join(F.broadcast(wanted), "word").groupBy("word").count().collect()  # at most one row per listed word
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in met}


def _ordered_templates(docs: DataFrame, contained: float) -> list[tuple[str, list[str], int]]:
    """Label, words rarest first, words needed."""
    sets = [(label, set(text.split())) for label, text in TEMPLATES]
    counts = word_counts(docs, sorted(set().union(*(words for _, words in sets))))
    return [(label, sorted(words, key=lambda w: (counts[w], w)), ceil(contained * len(words))) for label, words in sets]


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _share(block: Column, words: list[str], needed: int) -> Column:
    """Part of a template's words that a block (its different words) holds; 0 below the threshold."""
    prefix = words[: len(words) - needed + 1]
    common = F.array_intersect(_strings(words), block)  # in the template's order
    # what stands at or after the first common word must suffice on the template's side; the block's side is its size
    reach = F.lit(len(words) + 1) - F.array_position(_strings(words), F.element_at(common, 1))
    filtered = (F.size(block) >= needed) & F.arrays_overlap(block, _strings(prefix)) & (reach >= needed)
    return F.when(filtered & (F.size(common) >= needed), F.size(common) / F.lit(float(len(words)))).otherwise(0.0)


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), matches, score.

    ``matches`` lists (label, first word of the block, share of the template). Base phrases count wherever their words
    stand consecutively. ``score`` is the largest share, 1 with a base phrase, 0 with neither. NULL and empty texts have
    no words and no labels; every row is answered, whatever its id; an empty table gives an empty result.
    """
    docs = plain(docs, id_col, text_col)
    templates = _ordered_templates(docs, contained)
    rare = sorted({w for _, words, needed in templates for w in words[: len(words) - needed + 1]})
    any_phrase = "(?:" + "|".join(f" {p}" for p in PHRASES) + ")(?= )"
    read = docs.select("doc_id", folded(F.col("text")).alias("f"))
    base = read.select(
        "doc_id", "f",
        F.when(F.col("f") == "  ", F.lit(0)).otherwise(_spaces(F.col("f")) - 1).cast("long").alias("n_words"),
        *[F.regexp_count("f", F.lit(f" {p}(?= )")).cast("long").alias(f"n_{i}") for i, p in enumerate(PHRASES)])
    counts = [F.col(f"n_{i}") for i in range(len(PHRASES))]
    base = base.withColumn("n_base", sum(counts[1:], counts[0]))
    met = F.col("n_base") > 0
    words = F.split(F.trim("f"), " ")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(block_words // 2))
    blocks = F.transform(starts, lambda i: F.struct(
        i.alias("word"), F.array_distinct(F.slice(F.col("words"), (i + 1).cast("int"), block_words)).alias("words")))
    fitting = F.filter(blocks, lambda b: F.arrays_overlap(b["words"], _strings(rare)))
    shares = F.flatten(F.transform(fitting, lambda b: F.array(*[
        F.struct(F.lit(label).alias("label"), b["word"].alias("word"), _share(b["words"], tokens, needed).alias("share"))
        for label, tokens, needed in templates])))
    none = F.array().cast("array<struct<label: string, word: bigint, share: double>>")
    found = base.withColumn("words", words).withColumn("matches", F.when(
        F.arrays_overlap(F.col("words"), _strings(rare)),
        F.filter(shares, lambda m: m["share"] > 0)).otherwise(none))
    base_labels = F.array_sort(F.array_compact(F.array(*[
        F.when(n > 0, F.lit(label)) for n, label in zip(counts, PHRASES.values(), strict=True)])))
    last = F.regexp_extract("f", f"(?s)^(.*){any_phrase}", 1)
    return found.select(
        "doc_id", "n_words", "n_base",
        F.when(met, _spaces(F.expr("substring(f, 1, {})".format("regexp_instr(f, '" + any_phrase + "') - 1")))).cast("long").alias("first_word"),
        F.when(met, _spaces(last)).cast("long").alias("last_word"),
        base_labels.alias("base_labels"),
        F.array_sort(F.array_union(base_labels, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        "matches",
        F.when(met, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))).alias("score"))
