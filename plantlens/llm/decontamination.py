"""Benchmark decontamination with one Aho-Corasick automaton over normalised item passages.

A window is ten consecutive words of an item. Each window holds one of the item's aligned blocks of five words, so the
automaton needs the blocks only, about a node a word of the benchmark instead of ten. A text is scanned once; where a block
occurs, the windows around it are looked up among the items' windows, by hash and then word by word. Hits are ranges of
words and of characters of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, fresh

#: Words of a benchmark at most; a worker holds about 150 bytes for each. More is an error, not a cut.
MOST_WORDS = 20_000_000
HIT = "n_words long, n_hit long, hits array<struct<start:int,end:int,from:int,to:int>>, items array<string>"
WORD = re.compile("[0-9A-Za-z\u0080-\ud7ff\ue000-\U0010ffff]+")


class Windows:
    """The automaton over blocks and short items as sequences of word numbers (0: a word of no item), and all windows."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.size, self.block = size, (size + 1) // 2
        self.ids = sorted({i for i, _ in items})
        self.numbers: dict[bytes, int] = {}
        number = {i: k for k, i in enumerate(self.ids)}
        patterns: dict[tuple[int, ...], set[int]] = defaultdict(set)  # short items by their words; blocks have none
        places, owners, parts, at = [], [], [], 0
        for item_id, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(text)]
            if 0 < len(words) < size:
                patterns[tuple(words)].add(number[item_id])
            elif words:
                for k in range(0, len(words) - self.block + 1, self.block):
                    patterns[tuple(words[k : k + self.block])].update(())
                parts.append(np.array(words, np.uint32))
                n = len(words) - size + 1
                places.append(np.arange(at, at + n))
                owners.append(np.full(n, number[item_id], np.int32))
                at += len(words)
        #: The items' words one after the other, and the place of each distinct window's first owner there.
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        self.factors = np.random.default_rng(11).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        place, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, owners))
        hashes = self.hashed(self.words, place)
        order = np.lexsort((owner, hashes))
        place, owner, hashes = place[order], owner[order], hashes[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, np.int64)
        self.hashes, self.first, self.owner = hashes[first], place[first], owner
        self.ends = np.r_[first[1:], len(hashes)].astype(np.int64)
        self.starts = first
        for k, (a, b) in enumerate(zip(first.tolist(), self.ends.tolist(), strict=True)):
            if b - a > 1 and not self.same(self.words, place[a:b], np.full(b - a, self.first[k])).all():
                raise ValueError("two windows of one hash; choose other factors")
        self.short = [tuple(sorted(s)) for s in patterns.values()]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.lengths = [len(p) for p in patterns]
        for k, pattern in enumerate(patterns):
            self.machine.add_word(pattern, k)
        if patterns:
            self.machine.make_automaton()

    def hashed(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k, factor in enumerate(self.factors):
            out += words[at + k].astype(np.uint64) * factor
        return out

    def same(self, words: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether the windows of `words` at these places equal the items' windows at `first`, word by word."""
        out = np.ones(len(at), bool)
        for k in range(self.size):
            out &= words[at + k] == self.words[first + k]
        return out

    def found(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges of all window occurrences, and the items they belong to."""
        number = self.numbers.get
        sequence = tuple([number(w, 0) for w in words])
        ranges, items, near = [], set(), set()
        for end, k in self.machine.iter(sequence):
            start = end + 1 - self.lengths[k]
            if self.short[k]:
                ranges.append((start, end + 1))
                items.update(self.short[k])
            if self.lengths[k] == self.block:
                near.add(start)
        if near and len(words) >= self.size and len(self.hashes):
            starts = np.unique((np.fromiter(near, np.int64)[:, None] - np.arange(self.size - self.block + 1)).ravel())
            starts = starts[(starts >= 0) & (starts <= len(words) - self.size)]
            own = np.array(sequence, np.uint32)
            hashes = self.hashed(own, starts)
            k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = (self.hashes[k] == hashes) & self.same(own, starts, self.first[k])
            ranges += [(s, s + self.size) for s in starts[hit].tolist()]
            for w in set(k[hit].tolist()):
                items.update(self.owner[self.starts[w] : self.ends[w]].tolist())
        return ranges, items

    def scan(self, text: str | None) -> tuple[int, int, list[tuple[int, int, int, int]], list[str]]:
        """(words, words hit, hit ranges of words and characters, items) of one text, which is read once."""
        words = alnum_words(text)
        if not words or not self.numbers:
            return len(words), 0, [], []
        found, items = self.found(words)
        ranges: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if ranges and a <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            else:
                ranges.append((a, b))
        spans = [m.span() for m in WORD.finditer(text)] if ranges else []
        return len(words), sum(b - a for a, b in ranges), [(a, b, spans[a][0], spans[b - 1][1]) for a, b in ranges], sorted(self.ids[k] for k in items)


#: The automaton that this Python worker built last, by the name of its broadcast.
_built: dict[str, Windows] = {}


def built(name: str, items: list[tuple[str, str | None]], size: int) -> Windows:
    if name not in _built:
        _built.clear()
        _built[name] = Windows(items, size)
    return _built[name]


def benchmark_items(benchmark: DataFrame, item_id: str, text: str) -> list[tuple[str, str | None]]:
    """(id, text) of all items with an id, on the driver; their words are counted first, and over MOST_WORDS is an error."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null")
    words = rows.agg(F.sum(F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    if words > MOST_WORDS:
        raise ValueError(f"a benchmark of {words} words is more than {MOST_WORDS}; mark its parts one after the other")
    return [(r.i, r.t) for r in rows.toLocalIterator()]


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, into: str = "contamination") -> DataFrame:
    """docs with a struct column `into`: n_words, n_hit, hits (word ranges start, end; code points from, to; ends exclusive), items (sorted ids).

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window is `size`
    consecutive words of an item; an item of fewer is one window; a word within any occurrence of a window is hit. Null or
    empty texts have no words, items with a null id or without words have no window, repeated rows are marked alike, very
    long texts are scanned whole, other columns pass through (one named `into` is replaced). An empty benchmark hits
    nothing, an empty table stays empty.
    """
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(benchmark_items(benchmark, item_id, item_text))

    @F.pandas_udf(HIT)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = built(name, shared.value, size)
        for texts in batches:
            rows = [windows.scan(t) for t in texts]
            yield pd.DataFrame(
                {
                    "n_words": [r[0] for r in rows],
                    "n_hit": [r[1] for r in rows],
                    "hits": [[dict(zip(("start", "end", "from", "to"), h, strict=True)) for h in r[2]] for r in rows],
                    "items": [r[3] for r in rows],
                }
            )

    return docs.withColumn(into, hits(F.col(text)))


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    text = options.get("text", "text")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(text))
    c = F.col("contamination")
    return mark(slim, benchmark, **options).select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark window.

    Null and empty texts stay, repeated rows stay or go alike, very long texts are scanned whole, an empty table stays
    empty, and other columns stay as they are, whatever their names.
    """
    into = fresh(docs, "contamination")
    return mark(docs, benchmark, into=into, **options).where(F.col(f"{into}.n_hit") == 0).drop(into)
