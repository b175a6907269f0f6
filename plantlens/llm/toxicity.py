"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

The labelled examples are a bounded sample and so is the index; every document is a query. All terms of the sample are in
the index, by their document frequency over all documents; those that don't tell the labels apart in the sample weigh
less. A query's rare terms are scored over their postings first. The largest weights of its common terms in each block of
examples bound what these can add; only examples that this bound lets reach the k-th best cosine so far are scored in
full. The k nearest are exact.

The votes are calibrated: each example is scored by the others, and a logistic curve from these scores to the labels turns
votes into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, fold, held_out

#: Examples of each label at most.
TOXIC_EXAMPLES, CLEAN_EXAMPLES = 1500, 3000
#: A term tells the labels apart when it is this many times as frequent with one as with the other, and so many standard
#: errors from as frequent; other terms weigh the share REST of their TF-IDF, words that no example holds too, as if one
#: document held them. REST was chosen on folds of learnable rows (README).
LEAST_RATIO, SURE, REST = 4.0, 3.0, 0.2
NEAREST, BLOCK = 15, 64
#: Terms that over this share of the examples hold are common.
COMMON = 1 / 8
#: Similarity that the share of toxic labels counts for in each vote; the cut of predicted.
PRIOR_WEIGHT, CUT = 2.0, 0.3


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, toxic_examples: int, clean_examples: int) -> tuple[DataFrame, float]:
    """(example, y, text) of the sampled learnable rows, and the share of toxic labels among all learnable rows.

    Of each label the ids with the smallest hashes are taken. An id or a text with both labels counts as toxic, and exact
    copies count once, by the smallest id.
    """
    learn = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != 2)).groupBy(F.col(doc_id).alias("example")).agg(F.max(F.when(F.col(toxic) > 0, 1).otherwise(0)).alias("y"))
    row = learn.agg(F.avg("y")).first()
    share = 0.0 if row[0] is None else float(row[0])
    pick = lambda y, n: learn.where(F.col("y") == y).orderBy(F.xxhash64("example"), "example").limit(n)
    ids = pick(1, toxic_examples).unionByName(pick(0, clean_examples))
    texts = docs.select(F.col(doc_id).alias("example"), F.col(text).alias("text"))
    found = texts.join(F.broadcast(ids), "example").where("text is not null")  # at most toxic_examples + clean_examples ids
    return found.groupBy("text").agg(F.min("example").alias("example"), F.max("y").alias("y")), share


def document_frequency(docs: DataFrame, text: str, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """(documents with a text, how many of them hold each term), over all documents; a task returns a row a term at most."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {w: k for k, w in enumerate(shared.value)}
        n, counts = 0, np.zeros(len(known), np.int64)
        for df in batches:
            for t in df["text"]:
                n += 1
                counts[[known[w] for w in set(alnum_words(t)) if w in known]] += 1
        held = np.flatnonzero(counts)
        yield pd.DataFrame({"term": np.append(held, -1), "n": np.append(counts[held], n)})

    out = np.zeros(len(terms) + 1, np.int64)
    texts = docs.select(F.col(text).alias("text")).where("text is not null")
    for term, n in texts.mapInPandas(counted, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    shared.destroy()
    return int(out[-1]), out[:-1]


class Lists:
    """Lists of (number, weight) one after the other."""

    def __init__(self, key: np.ndarray, number: np.ndarray, weight: np.ndarray, keys: int):
        order = np.lexsort((number, key))
        self.number, self.weight = number[order].astype(np.int32), weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=keys))]).astype(np.int64)
        self.size = np.diff(self.start)
        self.opened = 0  # entries read so far

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys' entries, how many each key has)."""
        size = self.size[keys]
        ends = np.cumsum(size)
        self.opened += int(size.sum())
        return np.repeat(self.start[keys] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0), size

    def sums(self, keys: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """For each number the sum of x times weight over the keys' lists."""
        at, size = self.places(keys)
        return np.bincount(self.number[at], self.weight[at] * np.repeat(x, size), n).astype(np.float64)


class Index:
    """Postings by term: example numbers ascending and weights, and each block's largest weight; terms by example."""

    #: What is sent to workers, a few bytes a posting; they build the rest from it.
    SENT = ("terms", "idf", "unknown", "prior", "curve", "ids", "y", "votes", "row", "term", "count")

    def __init__(self, terms: dict[bytes, float], examples: list[tuple[int, int, dict[bytes, int]]], class_weight: dict[int, float], prior: float, unknown: float = 0.0):
        self.unknown = unknown  # the weight of a word that isn't in the index
        self.terms, self.idf = list(terms), np.array(list(terms.values()), np.float64)
        self.prior, self.curve = prior, (1.0, 0.0)
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.y = np.array([e[1] for e in examples], np.float64)
        self.votes = np.array([class_weight[e[1]] for e in examples], np.float64)
        number = {w: k for k, w in enumerate(self.terms)}
        self.row = np.repeat(np.arange(len(examples), dtype=np.int32), [len(e[2]) for e in examples])
        self.term = np.fromiter((number[w] for e in examples for w in e[2]), np.int32)
        self.count = np.fromiter((n for e in examples for n in e[2].values()), np.int32)
        self.build()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in self.SENT}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.build()

    def build(self) -> None:
        n, row, term = len(self.ids), self.row, self.term
        self.number = {w: k for k, w in enumerate(self.terms)}
        self.blocks = -(-n // BLOCK)
        weight = (1 + np.log(self.count)) * self.idf[term] if len(term) else np.zeros(0)
        weight = weight / np.sqrt(np.bincount(row, weight * weight, n))[row] if len(term) else weight
        self.postings = Lists(term, row, weight, len(self.terms))
        self.texts = Lists(row, term, weight, n)
        met, of = np.unique(term.astype(np.int64) * max(1, self.blocks) + row // BLOCK, return_inverse=True)
        most = np.zeros(len(met))
        np.maximum.at(most, of, weight)
        self.most = Lists(met // max(1, self.blocks), met % max(1, self.blocks), most, len(self.terms))

    def query(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """(terms of the index, their weights over the norm of all words of the text); None without any."""
        counts = Counter(words)
        found = np.fromiter(map(self.number.get, counts, repeat(-1)), np.int64, len(counts))
        weight = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        at = np.flatnonzero(found >= 0)
        if not len(at):
            return None
        at = at[np.argsort(found[at])]
        terms, q = found[at], weight[at] * self.idf[found[at]]
        others = (weight * weight).sum() - (weight[at] * weight[at]).sum()
        return terms, q / np.sqrt((q * q).sum() + max(0.0, others) * self.unknown**2)

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine over 0 (ties: the smaller number) and the cosines."""
        n = len(self.ids)
        common = self.postings.size[terms] > max(k, COMMON * n)
        cosine = self.postings.sums(terms[~common], q[~common], n)
        if common.any():
            least = np.partition(cosine, -k)[-k] - 1e-12 if n > k else 0.0
            bound = self.most.sums(terms[common], q[common], self.blocks)
            open_ = cosine + np.repeat(bound, BLOCK)[:n] >= max(least, 1e-12)
            rows = np.flatnonzero(open_)
            # Whichever reads fewer entries: the common terms' postings, or the open examples' texts.
            if self.postings.size[terms[common]].sum() < self.texts.size[rows].sum():
                cosine += self.postings.sums(terms[common], q[common], n)
            else:
                asked = np.zeros(len(self.idf))
                asked[terms] = q
                at, size = self.texts.places(rows)
                cosine = np.zeros(n)
                cosine[rows] = np.bincount(np.repeat(np.arange(len(rows)), size), asked[self.texts.number[at]] * self.texts.weight[at], len(rows))
        best = np.flatnonzero(cosine >= 1e-12)
        if len(best) > k:
            best = best[cosine[best] >= np.partition(cosine[best], -k)[-k]]
        best = best[np.lexsort((best, -cosine[best]))][:k]
        return best, cosine[best]

    def vote(self, rows: np.ndarray, cosine: np.ndarray) -> float:
        """The distance-weighted share of toxic labels among these examples, drawn to the share among all labels."""
        vote = cosine * self.votes[rows]
        return (PRIOR_WEIGHT * self.prior + float((vote * self.y[rows]).sum())) / (PRIOR_WEIGHT + float(vote.sum()))

    def left_out(self, row: int) -> float:
        """The vote on an example by the others."""
        at, _ = self.texts.places(np.array([row]))
        terms, q = self.texts.number[at].astype(np.int64), self.texts.weight[at]
        rows, cosine = self.nearest(terms, q / np.sqrt((q * q).sum()), NEAREST + 1)
        others = rows != row
        return self.vote(rows[others][:NEAREST], cosine[others][:NEAREST])

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """(score, evidence: ids of the nearest examples, their cosines)."""
        asked = self.query(alnum_words(text)) if len(self.ids) else None
        if asked is None:
            return self.prior, [], []
        rows, cosine = self.nearest(*asked)
        slope, shift = self.curve
        return logistic(slope * logit(self.vote(rows, cosine)) + shift), self.ids[rows].tolist(), cosine.tolist()


def logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-min(500.0, max(-500.0, x))))


def fitted_curve(votes: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve from logits of votes to labels, by Newton steps on the weighted likelihood.

    A Gaussian prior (variance 10) around slope 1 and shift 0 keeps it finite where the votes tell the labels apart. An
    error if it hasn't settled after `rounds` steps.
    """
    x = np.stack([[logit(v) for v in votes], np.ones(len(votes))], axis=1)
    start = np.array([1.0, 0.0])
    at = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        gradient = x.T @ (weight * (y - p)) - (at - start) / 10
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) / 10, gradient)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            return float(at[0]), float(at[1])
    raise RuntimeError(f"the calibration has not settled after {rounds} steps")


def calibrated(spark: SparkSession, index: Index) -> Index:
    """index with its curve, from the votes on each example by the others; tasks score shares of the bounded sample."""
    shared = spark.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"id": df["id"], "vote": [shared.value.left_out(r) for r in df["id"].tolist()]})

    rows = spark.range(len(index.ids)).repartition(max(1, min(32, len(index.ids) // 100))).mapInPandas(left_out, "id long, vote double").collect()
    votes = np.zeros(len(index.ids))
    for i, vote in rows:
        votes[i] = vote
    shared.destroy()
    index.curve = fitted_curve(votes, index.y, index.votes)
    return index


def term_counts(sample: DataFrame) -> DataFrame:
    """(example, y, words, counts) of the examples' texts; words in order, joined by spaces."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [sorted(Counter(alnum_words(t)).items()) for t in df["text"]]
            yield pd.DataFrame({"example": df["example"], "y": df["y"], "words": [b" ".join(w for w, _ in f) for f in found], "counts": [[n for _, n in f] for f in found]})

    kind = sample.schema["example"].dataType.simpleString()
    return sample.select("example", "y", "text").mapInPandas(counted, f"example {kind}, y int, words binary, counts array<int>")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", toxic_examples: int = TOXIC_EXAMPLES, clean_examples: int = CLEAN_EXAMPLES, rest: float = REST) -> Index:
    """The index over the sampled examples. What is brought to the driver, a count a term of each, the sample bounds."""
    sample, share = labelled(docs, labels, doc_id, text, toxic, toxic_examples, clean_examples)
    one: dict[bytes, bytes] = {}  # an object a term, however many examples hold it
    examples = sorted(((r["example"], r["y"], {one.setdefault(w, w): n for w, n in zip(bytes(r["words"]).split(), r["counts"], strict=True)}) for r in term_counts(sample).toLocalIterator()), key=lambda e: (e[0], e[1], sorted(e[2].items())))
    del one
    n1 = sum(y for _, y, _ in examples)
    n0 = len(examples) - n1
    if not n1 or not n0:
        return Index({}, [], {0: 1.0, 1: 1.0}, share)
    held = (Counter(), Counter())
    for _, y, counts in examples:
        held[y].update(counts.keys())
    terms = sorted(held[0].keys() | held[1].keys())
    total, frequency = document_frequency(docs, text, terms)
    d0, d1 = (np.array([h[w] for w in terms], np.float64) for h in held)
    ratio = np.abs(np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1)))
    sure = (ratio >= SURE * np.sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5))) & (ratio >= math.log(LEAST_RATIO))
    weights = np.log(1 + total / np.maximum(frequency, 1)) * np.where(sure, 1.0, rest)
    examples = [e for e in examples if e[2]]
    # Labels are sampled at their own rates; a vote counts as if they weren't.
    weight = {1: share / (n1 / (n1 + n0)), 0: (1 - share) / (n0 / (n1 + n0))}
    index = Index(dict(zip(terms, weights.tolist(), strict=True)), examples, weight, share, rest * math.log(1 + total))
    del examples, held, terms
    return calibrated(docs.sparkSession, index) if len(index.ids) > 1 else index


def scored(docs: DataFrame, index: Index, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a struct column `into`: score, nearest (example ids), cosines.

    The score is the calibrated distance-weighted share of toxic labels among the nearest examples, drawn to the share
    among all labels. A text without any term of the index (null and empty ones too), or an index without examples, has
    that share as its score and no evidence. Ties go to the examples of the smaller ids; repeated rows score alike; very
    long texts are scored whole; an empty table stays empty; other columns pass through (one named `into` is replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, nearest array<long>, cosines array<double>")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.score(t) for t in texts], columns=["score", "nearest", "cosines"])

    return docs.withColumn(into, rate(F.col(text)))


def report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, nearest."""
    index = fit(docs, labels, doc_id, text, **options)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    x = F.col("toxicity")
    return scored(slim, index).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), x["score"].alias("score"), F.when(x["score"] >= CUT, 1).otherwise(0).alias("predicted"), x["nearest"].alias("nearest"))
