"""License scans by a positional index of rare words.

Every template is a short notice. Its rarest words, by their document frequency over the whole
corpus, are posted with their positions. Every word of a file is looked up among the postings,
however many notices the file holds; a posting at position q met at word p speaks for the notice
standing at p - q.
Where enough postings agree on a place, the template's mandatory key phrase is checked word by
word at that place, and the template's label is given with the share of its postings that agree.
Three base phrases are counted besides, wherever their words stand one after the other. All of it
is SQL functions; only the words' document frequencies (one row per licence word) reach the driver.

Words are stretches of letters, digits and characters beyond ASCII, with A-Z in lower case.
Results: NULL and empty texts have no words, no labels and score 0. Repeated notices give their
label once; ties between places need not be broken, as every place with enough votes is
checked. Other columns are left out, so clashing names do no harm; repeated rows repeat results.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm.arrays import let

# Phrases and labels of the base scan.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl",
                "all rights reserved": "reserved"}

# Label, notice, mandatory key phrase. The notices are the licences' own words.
TEMPLATES = (
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
            " software and associated documentation files", "permission is hereby granted"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are"
            " permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
     "gnu general public license version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2",
     "gnu general public license version 2"),
    ("lgpl", "licensed under the GNU Lesser General Public License",
     "lesser general public license"),
    ("agpl", "licensed under the GNU Affero General Public License",
     "affero general public license"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v."
                " 2.0", "mozilla public license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with"
            " or without fee is hereby granted", "permission to use copy modify"),
    ("cc-by-4.0", "This work is licensed under CC BY 4.0", "cc by 4 0"),
    ("cc-by-sa", "This work is licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0 Universal",
     "cc0 1 0 universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
)
RARE_OF_TEMPLATE = 5  # words of a template that are posted
MIN_SHARE = 0.5  # of a template's postings must agree on a place

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words in lower case
_LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # of a word in either case
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """The words of a notice."""
    return [w for w in re.split(_BREAK, text.translate(str.maketrans(_CAPITALS, _SMALL))) if w]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _CAPITALS, _SMALL), _BREAK, -1), lambda w: w != "")


def _count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_LETTER + "+"))


@dataclass(frozen=True)
class Posted:
    label: str
    postings: tuple[tuple[str, int], ...]  # rare words and their positions
    key: tuple[str, ...]
    key_at: int


def licence_words() -> list[str]:
    return sorted({w for _, notice, _ in TEMPLATES for w in words_of(notice)})


def document_frequencies(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """The inverse document frequency of every licence word over all documents.

    Letters beyond A-Z are lowered too here; it decides only which words count as rare.
    """
    known = F.array(*[F.lit(w) for w in licence_words()])
    found = docs.select(F.array_intersect(
        F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _BREAK, -1), known).alias("words"))
    counts = found.select(F.explode("words").alias("word")).groupBy("word").count().collect()
    total = docs.count()
    seen = {row["word"]: row["count"] for row in counts}
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in licence_words()}


def index(frequencies: dict[str, float]) -> list[Posted]:
    """The templates with their rarest words posted."""
    out = []
    for label, notice, phrase in TEMPLATES:
        words, key = words_of(notice), words_of(phrase)
        places = range(len(words) - len(key) + 1)
        key_at = next(i for i in places if words[i:i + len(key)] == key)
        rare = sorted(set(words), key=lambda w: (-frequencies[w], w))[:RARE_OF_TEMPLATE]
        out.append(Posted(label, tuple((w, i) for i, w in enumerate(words) if w in rare),
                          tuple(key), key_at))
    return out


def _template_score(posted: Posted, words: Column) -> Column:
    """Share of the template's postings that agree on a place with the key phrase, or 0."""
    total = len(posted.postings)
    need = max(2, math.ceil(MIN_SHARE * total)) if total > 1 else 1
    key = F.array(*[F.lit(w) for w in posted.key])
    posts = {}
    for word, place in posted.postings:
        posts.setdefault(word, []).append(place)
    met = F.transform(words, lambda w, i: F.when(w.isin(*posts), F.struct(
        w.alias("w"), i.alias("i"))))
    offsets = F.array_sort(F.flatten(F.transform(F.filter(met, lambda m: m.isNotNull()), lambda m:
        F.coalesce(*[F.when(m["w"] == word, F.array(*[m["i"] - q for q in places]))
                     for word, places in posts.items()], F.array().cast("array<int>")))))

    def standing(place: Column) -> Column:
        start = place + posted.key_at
        return (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, len(posted.key))
                               == key)

    # Places are sorted, so one that k postings agree on is found k - 1 steps ahead again.
    def agreed(places: Column, k: int) -> Column:
        return F.exists(F.filter(places, lambda p, j: F.get(places, j + (k - 1)) == p), standing)

    return let(offsets, lambda places: F.coalesce(
        *[F.when(agreed(places, k), F.lit(k / total)) for k in range(total, need - 1, -1)],
        F.lit(0.0)))


def _base_places(label: str, length: int):
    """From the pieces of a text split at a phrase: how often it stands, and where."""
    def places(pieces: Column) -> Column:
        return F.when(F.size(pieces) > 1, F.struct(
            F.lit(label).alias("label"),
            (F.size(pieces) - 1).cast("long").alias("n"),
            _count_words(F.element_at(pieces, 1)).cast("long").alias("first"),
            (F.col("n_words") - _count_words(F.element_at(pieces, -1)) - length).cast(
                "long").alias("last")))

    return places


def scan(docs: DataFrame, frequencies: dict[str, float], doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), where labels
    are sorted arrays and places count words from 0."""
    frame = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    frame = frame.withColumn("_low", F.lower("_text")).withColumn(
        "n_words", _count_words(F.col("_text")).cast("long"))

    # Base phrases: the text is split where one stands.
    places = []
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split(" ")
        pattern = rf"(?i){parts[0]}(?<!{_LETTER}{parts[0]}){_GAP}{_GAP.join(parts[1:])}(?!{_LETTER})"
        possible = None
        for part in parts:
            here = F.contains("_low", F.lit(part))
            possible = here if possible is None else possible & here
        places.append(F.when(possible, let(
            F.split("_text", pattern, -1), _base_places(label, len(parts)))))
    frame = frame.withColumn("_base", F.filter(F.array(*places), lambda x: x.isNotNull()))

    # Templates: only texts that hold all words of a key phrase can hold the phrase.
    posted = index(frequencies)
    possible = []
    for template in posted:
        tests = None
        for word in dict.fromkeys(template.key):
            here = F.contains("_low", F.lit(word))
            tests = here if tests is None else tests & here
        possible.append(tests)
    frame = frame.withColumn("_possible", F.array(*possible))
    frame = frame.withColumn("_words", F.when(
        F.array_contains("_possible", True), _words(F.col("_text"))))
    found = [F.when(F.get("_possible", F.lit(i)), F.struct(
        F.lit(t.label).alias("label"),
        _template_score(t, F.col("_words")).alias("score")))
        for i, t in enumerate(posted)]
    frame = frame.withColumn("_found", F.filter(
        F.array(*found), lambda x: x.isNotNull() & (x["score"] > 0)))

    base = F.array_sort(F.transform("_base", lambda x: x["label"]))
    return frame.select(
        doc_id, "n_words",
        F.aggregate("_base", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["last"])).alias("last_word"),
        base.alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, F.transform(
            "_found", lambda x: x["label"])))).alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(
            F.transform("_found", lambda x: x["score"])), F.lit(0.0))).alias("score"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The scan with its labels comma-joined."""
    found = scan(docs, document_frequencies(docs, text), doc_id, text)
    return found.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn(
        "labels", F.array_join("labels", ","))
