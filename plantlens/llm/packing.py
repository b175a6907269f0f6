"""Best-fit decreasing packing of token counts into sequences, for any number of documents.

A piece's length is at most the capacity, so the lengths of all pieces are a histogram of at most `capacity` numbers, and
open bins differ only in what remains in them. Best-fit decreasing goes through the histogram from the longest length
down: a segment tree over remaining capacities finds the tightest that fits, and a run of equal pieces fills a run of
equal bins at a time, which gives the same packing as piece by piece. The result is a table of runs (length, rank of a
piece among its length -> bin, offset), bounded by the capacity and not by the documents; Spark ranks the pieces of each
length and looks their runs up.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import utf8

CAPACITY = 4096
#: Words whose ids a Python worker remembers; beyond it, the half learned last is forgotten.
MEMO_WORDS = 1_000_000
#: Groups that the pieces of one length are ranked in.
RANK_BUCKETS = 512
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


class Tightest:
    """A segment tree over remaining capacities 0..size: how many open bins have each; the smallest one at or over a need."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, remaining: int, bins: int) -> None:
        node = self.base + remaining
        while node:
            self.count[node] += bins
            node >>= 1

    def find(self, need: int) -> int | None:
        """Climb until a right sibling holds bins, then go down to its leftmost leaf."""
        node = self.base + need
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.base:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.base


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, offset): pieces of these ranks go to consecutive bins at the offset.

    The tightest bin that fits a piece stays the tightest for the next of its length until it is too full, so the bins
    of a class are filled one after the other, each as far as it goes; where no bin fits, new ones are filled alike.
    """
    tree = Tightest(capacity)
    open_bins: dict[int, deque] = defaultdict(deque)  # remaining -> runs of bins [first, end)

    def keep(remaining: int, first: int, end: int) -> None:
        if remaining and end > first:
            open_bins[remaining].append((first, end))
            tree.add(remaining, end - first)

    runs, bins = [], 0
    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            remaining = tree.find(length)
            if remaining is None:
                remaining, first = capacity, bins
                end = bins = bins + -(-todo // (capacity // length))
            else:
                first, end = open_bins[remaining].popleft()
                tree.add(remaining, first - end)
            each = remaining // length
            full, rest = divmod(min(todo, (end - first) * each), each)
            for k in range(each):
                n = full + (k < rest)
                if n:
                    runs.append((length, rank, rank + n, first, capacity - remaining + k * length))
                rank, todo = rank + n, todo - n
            part = first + full
            keep(remaining - each * length, first, part)
            keep(remaining - rest * length, part, part + (rest > 0))
            keep(remaining, part + (rest > 0), end)
    return runs


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes, word by word.

    The tokenizer lower-cases, drops white space and never joins what white space or the step from a letter to a mark
    parts (but for apostrophes). So texts are lower-cased in ASCII, marks are set off from the letters before them, and
    the ids of a text are those of its words in a row. New words are encoded together, a separator of one known id
    between them; words that hold the separator, also after the tokenizer's normalisation (NFC), are encoded alone, and so
    are texts that may hold a special token.
    """

    SEPARATOR, SPECIAL = "\u00b7", b"<|"
    LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    MARK_AFTER_LETTER = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)")

    def __init__(self, vocabulary: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.memo: dict[bytes, bytes] = {}
        self.memo_words = memo_words
        one = self.encoded(self.SEPARATOR)
        self.separator = one[0] if len(one) == 1 else None

    def encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def packed(self, text: str) -> bytes:
        return np.array(self.encoded(text), "<u4").tobytes()

    def alone(self, word: bytes) -> bool:
        return self.separator is None or not word.isascii() and self.SEPARATOR in unicodedata.normalize("NFC", word.decode("utf-8", "replace"))

    def learn(self, words: set[bytes]) -> None:
        joint = []
        for w in words:
            if self.alone(w):
                self.memo[w] = self.packed(w.decode("utf-8", "replace"))
            else:
                joint.append(w)
        between = f" {self.SEPARATOR} ".encode()
        for start in range(0, len(joint), 5000):
            part = joint[start : start + 5000]
            ids = np.array(self.encoded(between.join(part).decode("utf-8", "replace")), "<u4")
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) != len(part) - 1:  # a word that yields the separator after all
                self.memo.update((w, self.packed(w.decode("utf-8", "replace"))) for w in part)
                continue
            raw, at = ids.tobytes(), 0
            for w, cut in zip(part, [*cuts.tolist(), len(ids)], strict=True):
                self.memo[w] = raw[4 * at : 4 * cut]
                at = cut + 1

    def of(self, texts: list[str | None]) -> list[bytes]:
        raws = [utf8(t) for t in texts]
        split = [[] if self.SPECIAL in r else self.MARK_AFTER_LETTER.sub(rb" \g<0>", r.translate(self.LOWER)).split() for r in raws]
        if len(self.memo) > self.memo_words:  # the words learned first are mostly the frequent ones
            self.memo = dict(islice(self.memo.items(), self.memo_words // 2))
        self.learn(set().union(*split).difference(self.memo))
        get = self.memo.__getitem__
        return [self.packed(r.decode("utf-8", "replace")) if self.SPECIAL in r else b"".join(map(get, words)) for r, words in zip(raws, split, strict=True)]


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    """One for each Python worker, kept between its tasks."""
    return WordIds(vocabulary)


def pieces_of(ids: bytes, capacity: int) -> list[dict[str, int]]:
    """The pieces of one document's ids, an id 1 put after them; only what is longer than the capacity is cut."""
    ids += struct.pack("<I", 1)
    out = []
    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[start : start + 4 * capacity]
        out.append({"piece": k, "start": start // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)})
    return out


def tokenized(docs: DataFrame, path: str, text: str = "text", into: str = "pieces", capacity: int = CAPACITY) -> DataFrame:
    """docs with an array column `into` of pieces (piece, start, length, ids_crc32); null text is empty.

    The tokenizer file, a few MB, is read by the driver and sent to the executors.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @F.pandas_udf(PIECES)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = word_ids(vocabulary.value)
        for texts in batches:
            yield pd.Series([pieces_of(i, capacity) for i in ids.of(texts.tolist())])

    return docs.withColumn(into, cut(F.col(text)))


def place(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; `pieces` is read twice, so it should be a written table.

    Pieces of one length are interchangeable. They are ranked in RANK_BUCKETS groups by a hash of `order`, so that a
    length which many pieces share is ranked by many tasks; group offsets come from the counts.
    """
    spark = pieces.sparkSession
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)).cast("int"))
    counts = keyed.groupBy(F.col(length).alias("_length"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    runs = sorted((-length_ << 40 | first, first, bin_, at) for length_, first, _, bin_, at in best_fit_decreasing(histogram, capacity))
    shared = spark.sparkContext.broadcast([list(c) for c in zip(*runs, strict=True)] if runs else None)

    @F.pandas_udf("sequence_id long, offset long")
    def find(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        keys, firsts, bins, offsets = (np.array(c, dtype=np.int64) for c in shared.value)
        rank = ranks.to_numpy(dtype=np.int64)
        run = np.searchsorted(keys, (-lengths.to_numpy(dtype=np.int64) << 40) | rank, side="right") - 1
        return pd.DataFrame({"sequence_id": bins[run] + rank - firsts[run], "offset": offsets[run]})

    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_length", F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(length, "_bucket").orderBy(*order)
    ranked = keyed.withColumn("_inside", F.row_number().over(inside))
    joined = ranked.join(offsets, (F.col(length) == F.col("_length")) & (F.col("_bucket") == F.col("_b")), "left")
    out = joined.withColumn("_at", find(F.col(length), F.col("_inside") - 1 + F.col("_before")))
    return out.withColumns({"sequence_id": F.col("_at.sequence_id"), "offset": F.col("_at.offset")}).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of the tokenizer file at `path`, then id 1; a null or empty text is the id 1 alone. Repeated
    rows are packed each by itself, equal lengths in any order; an empty table gives no rows; a very long text is tokenized
    whole and cut into pieces; other columns are not kept.
    """
    from .common import written

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Every document has a piece; of a plain explode Spark would infer a filter, and so evaluate the tokenizer twice.
    pieces = tokenized(slim, path, capacity=capacity).select("doc_id", F.explode_outer("pieces").alias("p")).select("doc_id", "p.*")
    return place(written(pieces, "pieces"), capacity=capacity)
