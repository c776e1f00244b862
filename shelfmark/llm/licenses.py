"""License notices in texts, found through a positional index of their rarest words.

Each notice is indexed under its highest-IDF words only, with their positions in it; the IDF counts
all documents. A file's words are looked up in that index. A hit at word i of a word at position p of
a notice says that the notice would start at i - p; there, the notice and the text are compared
position by position. Equal words weigh their IDF, which stays above 0. A notice is found where the key phrase that it
cannot do without is complete and at least `MIN_SCORE` of its weight agrees; the base phrases must
agree in full. Places are told apart by notice and start.

Everything is built-in functions: one pass counts documents per notice word (the only shuffle, a
few hundred words), one pass scans, without a shuffle and without any text leaving its row. The
index is a constant of the notices, whatever the corpus.

Defined results: a null or empty text has no words and no place; labels without any place are an
empty string; rows are independent, so repeated rows agree; extra columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notice, label and the key phrase that must be complete.
NOTICES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction",
        "mit",
        "hereby granted free of charge",
    ),
    ("released under the terms of the mit license", "mit", "mit license"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except"
        " in compliance with the license",
        "apache-2",
        "apache license version 2 0",
    ),
    (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international"
        " license",
        "cc-by-nc",
        "attribution noncommercial",
    ),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    (
        "this work is licensed under a creative commons attribution 4 0 international license",
        "cc-by",
        "attribution 4 0 international",
    ),
    ("licensed under the gnu general public license version 3", "gpl-3", "gnu general public license version 3"),
    ("licensed under the gnu general public license version 2", "gpl-2", "gnu general public license version 2"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of"
        " the gnu general public license as published by the free software foundation",
        "gpl",
        "gnu general public license",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
        "bsd",
        "source and binary forms",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or"
        " without fee is hereby granted",
        "isc",
        "with or without fee",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mpl-2",
        "mozilla public license v 2 0",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered software"),
    (
        "to the extent possible under law the author has waived all copyright and related or"
        " neighboring rights to this work",
        "cc0",
        "waived all copyright",
    ),
]

MIN_SCORE = 0.7
RARE_WORDS = 3  # a notice is indexed under so many of its words

# What stands between words once A-Z are lower case; digits, a-z and all beyond ASCII are words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Notice:
    words: list[str]
    label: str
    key: tuple[int, int]  # first word and number of words of the key phrase
    base: bool


def notices() -> list[Notice]:
    found = [Notice(p.split(), label, (0, len(p.split())), True) for p, label in BASE_PHRASES.items()]
    for text, label, key in NOTICES:
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        found.append(Notice(words, label, (at, len(phrase)), False))
    return found


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null.

    `lower` also changes letters beyond ASCII, which neither splits nor joins words.
    """
    parts = F.array_remove(F.split(F.lower(text), _BETWEEN), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def idf(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """1 + ln((documents + 1) / (documents with the word + 1)) over all documents.

    At least 1: words that every document holds still count where a notice is compared.
    """
    known = F.array(*(F.lit(w) for w in vocabulary))
    # Every document adds one to the empty word: their number comes with the counts.
    held = F.concat(F.array(F.lit("")), F.array_intersect(known, words_of(F.col("text"))))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    count = dict(counts.collect())
    total = count.pop("", 0)
    return {w: 1 + math.log((total + 1) / (count.get(w, 0) + 1)) for w in vocabulary}


def _index(found: list[Notice], weight: dict[str, float]) -> list[tuple[str, int, int]]:
    """(word, notice, position): every notice under the positions of its rarest words."""
    index = []
    for number, notice in enumerate(found):
        first = {w: notice.words.index(w) for w in reversed(notice.words)}
        rare = sorted(first, key=lambda w: (-weight[w], first[w]))[: 1 if notice.base else RARE_WORDS]
        index += [(w, number, p) for w in rare for p, x in enumerate(notice.words) if x == w]
    # A base phrase needs one posting per place, whatever repeats in it.
    seen, once = set(), []
    for word, number, position in index:
        if not found[number].base or number not in seen:
            once.append((word, number, position))
        seen.add(number)
    return once


def _agreement(notice: Notice, weight: dict[str, float], start: Column, words: Column) -> Column:
    """The weight that agrees at `start`, 0 to 1; null where the notice is not found."""
    total = sum(weight[w] for w in notice.words)
    same = [F.get(words, start + i).eqNullSafe(F.lit(w)) for i, w in enumerate(notice.words)]
    first, size = notice.key
    key = same[first]
    for condition in same[first + 1 : first + size]:
        key = key & condition
    if notice.base:
        return F.when(key, F.lit(1.0))
    share = F.lit(0.0)
    for condition, word in zip(same, notice.words, strict=True):
        share = share + F.when(condition, F.lit(weight[word] / total)).otherwise(0.0)
    return F.when(key, F.when(share >= MIN_SCORE, F.least(share, F.lit(1.0))))


def scan(docs: DataFrame) -> DataFrame:
    """`doc_id`, `n_words` and `places`: one (notice, start, score) per place, for every document."""
    found = notices()
    vocabulary = sorted({w for n in found for w in n.words})
    weight = idf(docs, vocabulary)
    index = _index(found, weight)
    rare = sorted({w for w, _, _ in index})

    def at(i: Column, words: Column) -> Column:
        """All notices that the word at `i` points to, checked at their start."""
        word, checked = F.get(words, i), []
        for w, number, position in index:
            score = _agreement(found[number], weight, i - position, words)
            place = F.struct(
                F.lit(number).alias("notice"),
                (i - position).cast("long").alias("start"),
                score.alias("score"),
            )
            checked.append(F.when((word == w) & (i >= position) & score.isNotNull(), place))
        return F.array_compact(F.array(*checked))

    split = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    hits = split.withColumn(
        "hits",
        F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(rare), i))),
    )
    return hits.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.flatten(F.transform("hits", lambda i: at(i, F.col("words")))).alias("places"),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its base places, the labels found, and the best score."""
    found = notices()
    base = [i for i, n in enumerate(found) if n.base]

    def labels(numbers: Column) -> Column:
        label = F.array(*(F.lit(n.label) for n in found))
        return F.array_join(F.array_sort(F.array_distinct(F.transform(numbers, lambda n: F.get(label, n)))), ",")

    places = F.col("places")
    numbers = F.array_distinct(F.transform(places, lambda p: p["notice"]))
    of_base = F.filter(places, lambda p: p["notice"].isin(base))
    starts = F.transform(of_base, lambda p: p["start"])
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(of_base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.filter(numbers, lambda n: n.isin(base))).alias("base_labels"),
        labels(numbers).alias("labels"),
        F.coalesce(F.array_max(F.transform(places, lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
