"""Licence scans by a positional index of rare licence words, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaplane.llm._shared import ascii_lower, materialise

#: Phrases that stand for a licence by themselves.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label -> (public notice text, phrase of it that must stand in the document).
NOTICES = {
    "mit-notice": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    "mit-line": ("released under the mit license", "released under the mit license"),
    "apache-notice": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "licensed under the apache license version"),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    "gpl-line": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license"),
    "bsd-notice": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "isc-notice": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    "mpl-notice": ("this source code form is subject to the terms of the mozilla public license v 2 0", "terms of the mozilla public license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "licensed under cc by nc"),
    "cc-notice": ("this work is licensed under a creative commons attribution 4 0 international license", "licensed under a creative commons"),
    "public-domain": ("this is free and unencumbered software released into the public domain", "released into the public domain"),
}

SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_array(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; empty for null."""
    bare = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "^" + SPLIT + "|" + SPLIT + "$", "")
    return F.when(F.length(bare) > 0, F.split(bare, SPLIT)).otherwise(F.array().cast("array<string>"))


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _places(words: str, phrase: list[str]) -> Column:
    """Starts of the phrase in the array column, from 0."""
    rare = phrase[-1]
    ends = F.filter(F.transform(words, lambda w, i: F.when(w == rare, i)), lambda i: i.isNotNull())
    return F.transform(F.filter(ends, lambda i: _all(F.coalesce(F.get(F.col(words), i - back) == w, F.lit(False)) for back, w in enumerate(reversed(phrase)))), lambda i: i - (len(phrase) - 1))


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def index_words(notices: dict[str, tuple[str, str]]) -> list[str]:
    """The words that may be index tokens: those of the notices with three letters or more."""
    return sorted({w for text, _ in notices.values() for w in text.split() if len(w) >= 3})


def measured(docs: DataFrame, notices: dict[str, tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, base (array of start and label), hits and key places. Reads texts once."""
    vocabulary = index_words(notices)
    a = docs.select("doc_id", word_array(F.col("text")).alias("words"))
    found = F.array_intersect("words", _strings(vocabulary))
    # A document with a single index word can hold no notice; a phrase needs its last word.
    b = a.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), found.alias("found"), F.arrays_overlap("words", _strings(sorted({p.split()[-1] for p in phrases}))).alias("maybe_base"))

    def labelled(column: Column, label: str, name: str, shift: int = 0) -> Column:
        return F.transform(column, lambda i: F.struct((i - shift).cast("long").alias(name), F.lit(label).alias("label")))

    base = F.concat(*[labelled(_places("words", p.split()), label, "at") for p, label in phrases.items()])
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("p"))), lambda x: x["w"].isin(vocabulary))
    keys = F.concat(*[labelled(_places("words", key.split()), label, "offset", _start(text, key)) for label, (text, key) in notices.items()])
    several = F.size("found") >= 2
    return b.select(
        "doc_id", "n_words", "found",
        F.when(F.col("maybe_base"), base).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")).alias("base"),
        F.when(several, hits).otherwise(F.array().cast("array<struct<w:string,p:bigint>>")).alias("hits"),
        F.when(several, keys).otherwise(F.array().cast("array<struct<offset:bigint,label:string>>")).alias("keys"),
    )


def _start(text: str, key: str) -> int:
    """Where the key phrase starts in the notice, in words."""
    words, k = text.split(), key.split()
    return next(i for i in range(len(words)) if words[i : i + len(k)] == k)


def _votes(i: int, label: str, notice: str, by_rarity: list[str], rarest: int) -> dict[str, Column]:
    """__own_i: how many of the notice's own rarest words the document has; __starts_i: the places they vote for, sorted, if its mandatory phrase stands anywhere."""
    vocabulary = set(by_rarity)
    at: dict[str, list[int]] = {}
    for place, w in enumerate(notice.split()):
        if w in vocabulary:
            at.setdefault(w, []).append(place)
    postings = F.create_map(*[x for w, p in at.items() for x in (F.lit(w), F.array(*[F.lit(k).cast("long") for k in p]))])
    own = F.slice(F.array_intersect(_strings([w for w in by_rarity if w in at]), F.col("found")), 1, rarest)
    rare = F.filter("hits", lambda x: x["w"].isin(list(at)) & F.array_contains(own, x["w"]))
    starts = F.sort_array(F.flatten(F.transform(rare, lambda x: F.transform(postings[x["w"]], lambda p: x["p"] - p))))
    return {f"__own_{i}": F.size(own), f"__starts_{i}": F.when(F.exists("keys", lambda k: k["label"] == label), starts).otherwise(F.array().cast("array<bigint>"))}


def _verified(i: int, label: str, notice: str, slack: int, least_share: float, vocabulary: set[str]) -> tuple[Column, Column]:
    """The places in one line, and label and score of notice i; the score is null where it isn't there.

    Places voted for and places of the key phrase are sorted together, so that each looks at its neighbours only: so
    many votes and keys at most as can lie within the slack.
    """
    s, own = F.col(f"__starts_{i}"), F.col(f"__own_{i}")
    need = F.greatest(F.lit(2), F.ceil(own * F.lit(least_share)).cast("int"))
    most = (slack + 1) * sum(w in vocabulary for w in notice.split()) + 2 * slack + 1
    keys = F.array_distinct(F.transform(F.filter("keys", lambda k: k["label"] == label), lambda k: k["offset"]))
    line = F.col(f"__line_{i}")  # twice the place, one more for a vote
    vote = lambda m: F.pmod(m, F.lit(2)) == 1
    behind = lambda m, j: F.slice(line, j + 1, F.lit(most))
    near = lambda m, j: F.exists(F.slice(line, F.greatest(F.lit(1), j + 1 - most), F.lit(2 * most)), lambda x: ~vote(x) & (F.abs(x - m + 1) <= 2 * slack))
    votes = lambda m, j: F.size(F.filter(behind(m, j), lambda x: vote(x) & (x <= m + 2 * slack)))
    good = F.filter(F.transform(line, lambda m, j: F.when(vote(m), F.when(near(m, j), votes(m, j)))), lambda v: v >= need)
    lined = F.array_sort(F.concat(F.transform(s, lambda x: 2 * x + 1), F.transform(keys, lambda x: 2 * x)))
    return lined, F.struct(F.lit(label).alias("label"), F.when(F.size(good) > 0, F.least(F.lit(1.0), F.array_max(good) / F.greatest(own, F.lit(1)))).alias("score"))


def licence_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rarest: int = 8, slack: int = 2, least_share: float = 0.6, notices: dict[str, tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Document frequencies of the index words are counted over all documents (as many counts as the notices have words
    reach the driver). Of each notice's index words that a document has, the `rarest` of highest IDF are looked up in its
    postings; each meeting votes for the place where the notice would begin, and a notice is a candidate where places within `slack`
    words have votes of `least_share` of the words that could vote, two at least. It counts if its mandatory phrase
    stands at that place. score: the largest share of votes of a notice that counts, at least 0.5 with a base phrase,
    else 0. Null texts have no words; repeated rows are each returned; an empty table gives an empty result; other
    columns are ignored, whatever their names. Of votes that tie nothing depends. The work on a document grows with its
    words, however often a notice repeats in it.
    """
    seen = materialise(measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), notices, phrases), "licences")
    vocabulary = index_words(notices)
    counts = {r["w"]: r["n"] for r in seen.select(F.explode("found").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = {w: -math.log1p(counts.get(w, 0)) for w in vocabulary}  # the number of documents is the same for all words
    by_rarity = sorted(vocabulary, key=lambda w: (-idf[w], w))
    a, found = seen, []
    for i, (label, (notice, _)) in enumerate(notices.items()):
        a = a.withColumns(_votes(i, label, notice, by_rarity, rarest))
        line, score = _verified(i, label, notice, slack, least_share, set(vocabulary))
        a = a.withColumn(f"__line_{i}", line)
        found.append(score)
    b = a.select("doc_id", "n_words", "base", F.filter(F.array(*found), lambda x: x["score"].isNotNull()).alias("found"))
    labels = lambda c: F.array_sort(F.array_distinct(c))
    base_labels = F.transform("base", lambda x: x["label"])
    return b.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["at"])).alias("last_word"),
        F.array_join(labels(base_labels), ",").alias("base_labels"),
        F.array_join(labels(F.concat(base_labels, F.transform("found", lambda x: x["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def words_of(text: str | None) -> list[str]:
    """The word rule in Python, for tests."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
