"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document; abstaining says nothing. How often each rule votes bad on
bad and on good documents, and the share of bad documents, are estimated together by expectation-maximisation from how the
votes of all documents fall together. Beliefs enter with the weight of a fixed number of documents only, so on a corpus
the votes decide: a rule that fires alone, without the others, is taken for noise and not obeyed. A document is kept when
its posterior probability of being good reaches a threshold.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

WINDOW = 5
KEEP = 0.5
#: Beliefs before any data, each with the weight of BELIEF_WEIGHT documents: the share of bad votes among a rule's votes on
#: bad and on good documents, and the share of bad documents.
BELIEF_BAD, BELIEF_GOOD, BELIEF_SHARE, BELIEF_WEIGHT = 0.3, 0.02, 0.1, 20.0
#: The first guess before any estimate: documents that this many rules call bad are bad.
AGREEING = 2
#: Rounds after which rates that still move by SETTLED are reported as unsettled.
ROUNDS, SETTLED = 5000, 1e-8
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
REST = f"{WORD}*+"


def let(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(windows: Column) -> Column:
    """Words in windows (their hashes, by first word) that occur twice or more: 0 at once if all differ, else by sorting."""

    def covered(s: Column) -> Column:
        twice = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when((F.get(s, k - 1)["h"] == F.get(s, k)["h"]) | (F.get(s, k + 1)["h"] == F.get(s, k)["h"]), F.get(s, k)["i"]))
        starts = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n")))["n"]

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(placed, covered)).cast("long")


def measured(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """docs with a struct column `into` of the measures; null text has no words."""
    t, words, windows = (fresh(docs, f"{into}_{c}") for c in ("text", "words", "windows"))
    x = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    x = x.withColumn(words, F.array_remove(F.split(F.col(t), f"{SPACE}+"), ""))
    w = F.col(words)
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    x = x.withColumn(windows, F.when(F.size(w) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(F.col(t), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(F.col(t), F.lit(pattern)).cast("long")
    measures = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda a: F.struct((F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"), F.size(a).cast("long").alias("all"))).alias("lines"),
        repeated_words(F.col(windows)).alias("n_repeat_words"),
        count(r"[A-Z]").alias("n_upper"),
        count(r"!").alias("n_shouts"),
        count(r"[.!?]").alias("n_stops"),
        # Each match takes the rest of its word, so these count words, in time linear in the text.
        count(rf"[#*$%&|<>]{REST}").alias("n_marked_words"),
        count(rf"\p{{L}}{REST}").alias("n_letter_words"),
        count(rf"(?<!{WORD})(?=[^a-zA-Z\x20\x09-\x0D]*+[A-Z][^a-zA-Z\x20\x09-\x0D]*+[A-Z])[^a-z\x20\x09-\x0D]*+(?!{WORD})").alias("n_capital_words"),
    )
    return x.withColumn(into, measures).drop(t, words, windows)


def votes(m: Column) -> dict[str, Column]:
    """Each rule's vote from the measures: -1, 0 or 1. Without words all but `length` abstain."""
    n, chars = m["n_words"], m["word_chars"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(n == 0, F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    return {
        "length": F.when(n < 10, F.lit(-1)).when(n >= 40, F.lit(1)).otherwise(F.lit(0)),
        "word_length": vote((chars < 2 * n) | (chars > 14 * n), (chars >= 3 * n) & (chars <= 9 * n)),
        "symbols": vote(10 * m["n_symbols"] > n, 100 * m["n_symbols"] <= n),
        "marked_words": vote(5 * m["n_marked_words"] > n, 50 * m["n_marked_words"] <= n),
        "letter_words": vote(10 * m["n_letter_words"] < 6 * n, 10 * m["n_letter_words"] >= 8 * n),
        "repeats": vote(100 * m["n_repeat_words"] > 20 * n, 100 * m["n_repeat_words"] <= 5 * n),
        "distinct": vote(10 * m["n_distinct"] < n, 10 * m["n_distinct"] >= 3 * n),
        "lines": vote(100 * m["lines"]["dup"] > 60 * m["lines"]["all"], 10 * m["lines"]["dup"] <= m["lines"]["all"]),
        "capitals": vote(100 * m["n_upper"] > 30 * chars, 100 * m["n_upper"] <= 10 * chars),
        "capital_words": vote(10 * m["n_capital_words"] > 3 * n, 20 * m["n_capital_words"] <= n),
        "shouts": vote(20 * m["n_shouts"] > n, m["n_shouts"] == 0),
        "stops": vote(200 * m["n_stops"] < n, (60 * m["n_stops"] >= n) & (2 * m["n_stops"] <= n)),
    }


def fit(docs: DataFrame, votes_of: dict[str, Column]) -> tuple[float, dict[str, tuple[float, float]], bool]:
    """(share of bad documents, rule -> share of bad votes on bad and on good documents, whether they settled), from all documents.

    Documents are counted by their votes first, at most 3 ** rules rows, so that rounds cost nothing more. An empty table
    gives the beliefs.
    """
    names = list(votes_of)
    rows = docs.groupBy(*[v.alias(f"v_{k}") for k, v in votes_of.items()]).agg(F.count(F.lit(1)).alias("n")).collect()
    return estimated(names, {tuple(r[f"v_{k}"] for k in names): r["n"] for r in rows})


def estimated(names: list[str], patterns: dict[tuple[int, ...], int]) -> tuple[float, dict[str, tuple[float, float]], bool]:
    """Expectation-maximisation from the first guess of AGREEING bad votes, until no rate moves by SETTLED.

    A round is a few products of the table of patterns (at most 3 ** rules rows). The last value is false if rates still
    moved after ROUNDS of them, as they can where the votes hold next to nothing about the rules.
    """
    votes_cast = np.array(sorted(patterns), dtype=np.int8).reshape(len(patterns), len(names))
    n = np.array([patterns[p] for p in sorted(patterns)], dtype=np.float64)
    cast, against = (votes_cast != 0).astype(np.float64), (votes_cast < 0).astype(np.float64)
    bad = (against.sum(axis=1) >= AGREEING).astype(np.float64)
    beliefs = np.array([[BELIEF_BAD], [BELIEF_GOOD]])
    share, rates, settled = BELIEF_SHARE, np.repeat(beliefs, len(names), axis=1), True
    for _ in range(ROUNDS if len(n) else 0):
        weights = np.stack([n * bad, n * (1 - bad)])
        before, rates = rates, (weights @ against + beliefs * BELIEF_WEIGHT) / (weights @ cast + BELIEF_WEIGHT)
        share = (weights[0].sum() + BELIEF_SHARE * BELIEF_WEIGHT) / (n.sum() + BELIEF_WEIGHT)
        by_vote = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        odds = math.log((1 - share) / share) + against @ by_vote[0] + (cast - against) @ by_vote[1]
        bad = 1 / (1 + np.exp(np.clip(odds, -500, 500)))
        settled = bool(np.abs(rates - before).max() < SETTLED)
        if settled:
            break
    return float(share), {k: (float(rates[0][i]), float(rates[1][i])) for i, k in enumerate(names)}, settled


def judged(docs: DataFrame, text: str = "text", into: str = "quality", keep: float = KEEP, keep_text: bool = True) -> DataFrame:
    """docs with a struct column `into`: the measures, base_failed, p_good (posterior), settled (false if the
    rules' rates still moved when the fit ended) and kept.

    The measures are written once, with the columns of docs (without the text if not keep_text), and read by both the fit
    and the verdict, so that no text is measured twice or shuffled.

    base_failed is n_words < 10 or more than a fifth of the words in repeated windows; such documents are not kept.
    Null and empty texts have no words and fail; repeated rows are judged alike; an empty table stays empty; very long
    texts are measured whole, in time linear in their length but for a sort of repeated windows; other columns pass
    through (one named `into` is replaced).
    """
    x = measured(docs, text, into)
    x = written(x if keep_text else x.drop(text), "quality")
    m = F.col(into)
    by_rule = votes(m)
    share, rates, settled = fit(x, by_rule)
    evidence = [F.when(v == -1, F.lit(math.log(rates[k][1] / rates[k][0]))).when(v == 1, F.lit(math.log((1 - rates[k][1]) / (1 - rates[k][0])))).otherwise(F.lit(0.0)) for k, v in by_rule.items()]
    odds = reduce(lambda a, b: a + b, evidence, F.lit(math.log((1 - share) / share)))
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    p_good = 1 / (1 + F.exp(-odds))
    x = x.withColumn(into, m.withField("base_failed", failed).withField("p_good", p_good).withField("settled", F.lit(settled)))
    return x.withColumn(into, m.withField("kept", ~m["base_failed"] & (m["p_good"] >= keep)))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good, settled."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    m = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "base_failed", "kept", "p_good", "settled")
    return judged(slim, keep_text=False).select("doc_id", *[m[c].alias(c) for c in names], m["lines"]["dup"].alias("n_dup_lines"))


def filtered(docs: DataFrame, text: str = "text", keep: float = KEEP) -> DataFrame:
    """docs without those that the rules reject.

    Null and empty texts go (they fail the base rule), repeated rows stay or go alike, an empty table stays empty, very long
    texts are judged whole, and other columns stay as they are, whatever their names.
    """
    into = fresh(docs, "quality")
    return judged(docs, text, into, keep).where(F.col(f"{into}.kept")).drop(into)
