"""License scans with a positional index of rare words.

Templates are notices with a mandatory key phrase.  The document frequency of
every licence word is counted over all documents.  The index holds, for each
template, the ``RARE`` highest-IDF words of its key phrase with their positions.
A file's words are looked up there: each posting says where the template would
have to begin.  The postings of a template's words are intersected by that
relative position, and where all of them agree the key phrase is verified word by
word.  A key phrase holds all its words, so no place is missed.  The score is the
share, by IDF, of the best template's words that stand at their positions around
a verified key phrase.

Only DataFrame functions are used.  The index has a few rows for each template, so
it is part of the query's expressions; one number for each licence word reaches the
driver.

Defined cases: a null or empty text has no words, no labels and score 0; of words
with equal IDF the earlier in the phrase goes into the index; a very long text is
one array of its words, about three times its bytes, in the task that reads it; null
and repeated ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statsift.llm import _common as c

#: Everything between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice's words, of which ``key`` must stand in the text."""

    label: str
    notice: str
    key: str

    @property
    def key_at(self) -> int:
        words, key = self.notice.split(), self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


#: The phrases that count as base places.
BASE = (
    Template("mit", "under the mit license", "under the mit license"),
    Template("apache-2", "apache license version 2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
)
#: The method's own templates; the notices are those that the licences ask to be put in files.
OWN = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "the apache license version 2"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "provided as is without any express or implied warranty"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    Template("bsl", "distributed under the boost software license version 1 0", "boost software license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc0", "dedicated to the public domain", "dedicated to the public domain"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
#: Words of a key phrase that go into the index.
RARE = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased."""
    spaced = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def word_idf(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """log((documents + 1) / (documents with the word + 1)) of each licence word, over all rows."""
    found = words.select(F.explode(F.concat(F.array_intersect("words", _strings(vocabulary)), F.array(F.lit("")))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def scan(docs: DataFrame, own: tuple[Template, ...] = OWN, base: tuple[Template, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    The licence words are counted when this is called."""
    rows = c.pick(docs, doc_id=id_col, text=text_col).select("doc_id", words_of(F.col("text")).alias("words"))
    templates = (*base, *own)
    idf = word_idf(rows, sorted({w for t in templates for w in t.notice.split()}))

    index = {t: sorted(enumerate(t.key.split()), key=lambda x: (-idf[x[1]], x[0]))[:RARE] for t in templates}
    entries = sorted({word for postings in index.values() for _, word in postings})
    postings = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda p: p["word"].isin(entries))
    none = F.array().cast("array<struct<word:string,at:int>>")
    looked_up = rows.withColumn("postings", F.when(F.arrays_overlap("words", _strings(entries)), postings).otherwise(none))

    def starts(place: int, word: str) -> Column:
        """Where a key phrase would begin, by the postings of one of its words."""
        return F.transform(F.filter("postings", lambda p: p["word"] == word), lambda p: p["at"] - place)

    def begins(t: Template) -> Column:
        """Where the key phrase begins: the places on which all its postings agree and which the whole phrase confirms."""
        key = t.key.split()
        agreed = reduce(F.array_intersect, (starts(place, word) for place, word in index[t]))
        return F.filter(agreed, lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, len(key)) == _strings(key)))

    def likeness(t: Template, places: str) -> Column:
        """The largest share of the notice's IDF that stands where it should."""
        notice = t.notice.split()
        weights = [max(idf[w], 0.01) for w in notice]
        terms = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(x / sum(weights)).alias("x")) for i, (w, x) in enumerate(zip(notice, weights))))

        def share(s: Column) -> Column:
            there = lambda n: F.try_element_at("words", F.when(s - t.key_at + n["i"] >= 0, s - t.key_at + n["i"] + 1).otherwise(F.lit(None)))
            return F.aggregate(terms, F.lit(0.0), lambda total, n: total + F.when(there(n) == n["w"], n["x"]).otherwise(0.0))

        return F.coalesce(F.array_max(F.transform(places, share)), F.lit(0.0))

    names = [f"places_{k}" for k in range(len(templates))]
    matched = looked_up.select("doc_id", "words", *(begins(t).alias(n) for t, n in zip(templates, names)))
    first = names[: len(base)]

    def labels(of: list[tuple[Template, str]]) -> Column:
        got = F.array(*(F.when(F.size(n) > 0, F.lit(t.label)) for t, n in of))
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(got))), ",")

    pairs = list(zip(templates, names))
    at = F.concat(*first)
    return matched.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        labels(pairs[: len(base)]).alias("base_labels"),
        labels(pairs).alias("labels"),
        F.round(F.least(F.lit(1.0), F.greatest(*(likeness(t, n) for t, n in pairs))), 6).alias("score"),
    )
