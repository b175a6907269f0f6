"""License scans: an exact set-similarity join of text blocks with license templates, and phrase places.

A template's blocks are all windows of consecutive words, over line ends too, that are as long as its notice and a quarter
more; so hard-wrapped notices match, and words scattered over a long line don't. A block meets a template when it holds at
least `threshold` of the template's distinct tokens. Tokens are ordered by document frequency over the whole corpus, rarest
first. Of a template with n tokens, a block must hold k = ceil(n * threshold); so it must hold one of the n - k + 1 rarest
(prefix filter), the text must have k tokens at least (length filter), and when the first token shared near a rare one is
the i-th, at most n - i tokens can be shared (positional filter). What passes is counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, utf8

#: Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices that licenses ask to be put on works, in their common wordings; label, notice.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
SCAN = "n_words long, places array<struct<label:string,word:long>>, matches array<struct<label:string,template:int,word:long,containment:double>>"
#: A block has this share of its notice's words more than the notice, for comment marks and words put in; SPARE at least.
SLACK, SPARE = 0.25, 2


def tokens_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM).split()


class Index:
    """Templates' tokens in corpus order, and the inverted index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.templates = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for label, notice in templates:
            tokens = sorted(set(tokens_of(notice)), key=lambda t: (frequency.get(t, 0), t))
            need = max(1, math.ceil(len(tokens) * threshold - 1e-9))
            for i, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix.setdefault(token, []).append((len(self.templates), i))
            words = len(tokens_of(notice))
            self.templates.append((label, tokens, need, words + max(SPARE, math.ceil(words * SLACK))))

    def matches(self, words: list[bytes], held: set[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word, containment) of the runs of overlapping blocks that meet a template, by their best block."""
        rare: dict[int, list[bytes]] = {}
        for token in self.prefix.keys() & held:
            for k, _ in self.prefix[token]:
                rare.setdefault(k, []).append(token)
        out = []
        for k, prefix in sorted(rare.items()):
            _, tokens, need, width = self.templates[k]
            if len(held) < need or sum(t in held for t in tokens) < need:
                continue
            order = {t: i for i, t in enumerate(tokens)}
            places = [(at, order[w]) for at, w in enumerate(words) if w in order]
            least = {order[t] for t in prefix}
            start = 0
            while start < len(places):
                # A region: places that follow each other within a block's width.
                end = start + 1
                while end < len(places) and places[end][0] - places[end - 1][0] < width:
                    end += 1
                region = places[start:end]
                first = min(i for _, i in region)
                if first in least and len(tokens) - first >= need and len({i for _, i in region}) >= need:
                    out += [(k, at, shared / len(tokens)) for at, shared in best_blocks(region, width, need)]
                start = end
        return out


def best_blocks(places: list[tuple[int, int]], width: int, need: int) -> list[tuple[int, int]]:
    """(first word, distinct tokens) of the best block of each run of overlapping ones with `need` tokens; places ascend."""
    out: list[tuple[int, int]] = []
    count: dict[int, int] = {}
    end, last = 0, None
    for start, (at, token) in enumerate(places):
        while end < len(places) and places[end][0] < at + width:
            count[places[end][1]] = count.get(places[end][1], 0) + 1
            end += 1
        if len(count) >= need:
            if last is None or at >= last + width:
                out.append((at, len(count)))
            elif len(count) > out[-1][1]:
                out[-1] = (at, len(count))
            last = at
        count[token] -= 1
        if not count[token]:
            del count[token]
    return out


def token_frequency(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> dict[bytes, int]:
    """How many documents hold each template token, over all documents; as many rows as the templates have tokens."""
    wanted = sorted({t for _, notice in templates for t in tokens_of(notice)})

    @F.pandas_udf("array<binary>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = set(wanted)
        for texts in batches:
            yield pd.Series([list(known.intersection(tokens_of(t))) for t in texts])

    # Outer, as of a plain explode Spark would infer a filter and so evaluate the function twice.
    rows = docs.select(F.explode_outer(held(F.col(text))).alias("token")).where("token is not null").groupBy("token").count().collect()
    return {bytes(r[0]): r[1] for r in rows}


def scan_text(text: str | None, index: Index, phrases: dict[str, str]) -> tuple[int, list, list]:
    """(words, phrase places, template matches by their first word) of one text."""
    words = tokens_of(text)
    places = []
    held = set(words)
    for phrase, label in phrases.items():
        parts = [p.encode() for p in phrase.split(" ")]
        if held.issuperset(parts):
            at = -1
            while True:
                try:
                    at = words.index(parts[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(parts)] == parts:
                    places.append((label, at))
    found = []
    if not held.isdisjoint(index.prefix):
        found = [(index.templates[t][0], t, at, c) for t, at, c in index.matches(words, held)]
    return len(words), sorted(places, key=lambda p: (p[1], p[0])), found


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.9, into: str = "licenses") -> DataFrame:
    """docs with a struct column `into`: n_words, places (label, word) of phrases, matches (label, template, word, containment).

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; a match is the best of
    overlapping blocks and `word` the number of its first shared word. Null and empty texts have no words and match
    nothing; a template without tokens matches nothing; repeated rows are scanned alike; other columns pass through (one
    named `into` is replaced).
    """
    templates = [t for t in (TEMPLATES if templates is None else templates) if tokens_of(t[1])]
    phrases = PHRASES if phrases is None else phrases
    frequency = token_frequency(docs, templates, text) if templates else {}

    @F.pandas_udf(SCAN)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(templates, frequency, threshold)
        for texts in batches:
            rows = [scan_text(t, index, phrases) for t in texts]
            yield pd.DataFrame(
                {
                    "n_words": [r[0] for r in rows],
                    "places": [[{"label": a, "word": b} for a, b in r[1]] for r in rows],
                    "matches": [[{"label": a, "template": b, "word": c, "containment": d} for a, b, c, d in r[2]] for r in rows],
                }
            )

    return docs.withColumn(into, scanned(F.col(text)))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands, else the largest containment of a template met, else 0.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    x = F.col("licenses")
    base = x["places"]["label"]
    labels = F.array_union(base, x["matches"]["label"])
    word = x["places"]["word"]
    return scan(slim, "text", **options).select(
        "doc_id",
        x["n_words"].alias("n_words"),
        F.size(x["places"]).cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(labels))).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(x["matches"]["containment"]), F.lit(0.0))).alias("score"),
    )
