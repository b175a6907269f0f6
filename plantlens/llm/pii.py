"""Personal data: patterns, and a skip-chain conditional random field that carries their labels to other mentions.

The field's tokens are the candidates of a document: what the patterns find (their labels are held fixed) and further
runs that look like numbers or addresses. A candidate's features are its shape and the words beside it; neighbours in the
text share chain potentials, distant repeated or similar candidates share skip potentials, so that one clear mention
labels the unclear ones. Loopy message passing gives each candidate's label distribution.

All potentials are trained by pseudo-likelihood over the candidates of all documents: given the labels beside it, a
candidate's label is a multinomial logistic regression, whose gradients Spark sums over partitions. Labels are distant: what
the patterns find has its kind; other candidates are none of them, but those that share a key with a found one, whose
labels are unknown and left out. Shapes alone nearly tell the patterns' verdicts, which would starve the other potentials,
so each candidate is also seen without its shape, and by its neighbours' labels alone (feature bagging against weight
undertraining).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: 0 is none of the kinds.
LABELS = 1 + len(KINDS)
#: Rounds after which messages that haven't settled are reported as such, damping, characters between chain neighbours,
#: least posterior of an added span.
ROUNDS, DAMPING, REACH, SURE = 200, 0.5, 80, 0.9
#: Variance of the Gaussian prior on weights; steps after which training that hasn't settled is an error.
VARIANCE, STEPS = 10.0, 500
#: Hash buckets of shapes and of each place of a context word; where each feature group starts.
SHAPES, WORDS, PLACES = 512, 512, 3
CONTEXT = SHAPES
PREVIOUS, NEXT, SKIP = (SHAPES + PLACES * WORDS + k * LABELS for k in range(3))
FEATURES = SKIP + LABELS
NODES = "array<struct<label:int,start:int,end:int,known:boolean,features:array<int>>>"
#: Of a document: its candidates, its edges (node, node, 0 for a chain or 1 for a skip edge).
READ = f"nodes {NODES}, edges array<struct<a:int,b:int,kind:int>>"

LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The patterns can only start where a digit run starts, so looking behind changes no match and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
# Runs inside longer words, such as the digits of a hexadecimal secret, are no numbers.
NUMBER = re.compile(r"(?<![\w+])\+?\(?[0-9](?:[ ().-]{0,2}[0-9])++(?!\w)")
GROUP = re.compile(r"[0-9](?:[().-]{0,2}[0-9])*+")
ADDRESS = re.compile(r"(?<!\S)[^\s@]++@\S++")
WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the patterns' matches, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                    out.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Number- and address-like runs. Numbers side by side, of seven digits each, are runs of their own."""
    if "@" in text:
        yield from (m.span() for m in ADDRESS.finditer(text))
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            run = m[0]
            if len(run) >= 7 and sum(map(str.isdigit, run)) >= 7:
                groups = [g.span() for g in GROUP.finditer(run)] if " " in run else []
                if len(groups) > 1 and all(sum(map(str.isdigit, run[a:b])) >= 7 for a, b in groups):
                    yield from ((m.start() + a, m.start() + b) for a, b in groups)
                else:
                    yield m.span()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(label, start, end) by start: the base spans, and further runs that overlap none (label 0)."""
    spans = sorted((a, b, k + 1) for k, a, b in base)
    out, k, ends = [], 0, 0
    for a, b in sorted(runs(text)):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if a >= ends and not (k < len(spans) and spans[k][0] < b):
            out.append((0, a, b))
            ends = b
    return sorted([*out, *((label, a, b) for a, b, label in spans)], key=lambda s: (s[1], s[2]))


def bucket(feature: str, buckets: int) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "replace")) % buckets


def shape(run: str) -> list[int]:
    """Features of a candidate's own characters, coarse and fine."""
    digits = [c for c in run if c.isdigit()]
    if "@" in run:
        names = ("@", f"@{int('.' in run.split('@', 1)[1])}{min(run.count('@'), 2)}")
    else:
        n, marks = min(len(digits), 20), "".join(sorted(set(run) & set(" ().-+")))
        names = ("#", f"n{n}", f"n{n}{marks}", f"n{n}l{int(luhn(''.join(digits)))}", f"d{min(run.count('.'), 4)}")
    return [bucket(x, SHAPES) for x in names]


def context(text: str, a: int, b: int) -> list[int]:
    """Features of the two words before and the word after a candidate; digits are alike. Few characters are looked at."""
    before = WORD.findall(text[max(0, a - 60) : a])[-2:]
    after = WORD.findall(text[b : b + 60])[:1]
    words = [*[""] * (2 - len(before)), *before, *(after or [""])]
    return [CONTEXT + k * WORDS + bucket(DIGIT.sub("0", w.lower()), WORDS) for k, w in enumerate(words)]


def keys(run: str) -> tuple[str, str]:
    """What repeated (first) and similar (second) mentions share."""
    if "@" in run:
        low = run.lower().strip(".,;:!?()[]<>\"'")
        return low, low.split("@", 1)[0]
    digits = "".join(c for c in run if c.isdigit())
    return digits, digits[-7:]


def edges(text: str, nodes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(node, node, 0 for a chain or 1 for a skip edge). A key's mentions are linked one to the next, so edges stay linear."""
    out = [(i, i + 1, 0) for i in range(len(nodes) - 1) if nodes[i + 1][1] - nodes[i][2] <= REACH]
    last: dict[tuple[int, str], int] = {}
    for i, (_, a, b) in enumerate(nodes):
        linked = set()
        for kind, key in enumerate(keys(text[a:b])):
            before = last.get((kind, key))
            if before is not None and before not in linked:
                out.append((before, i, 1))
                linked.add(before)
            last[kind, key] = i
    return out


def read(text: str | None) -> tuple[list[tuple[int, int, int, bool, list[int]]], list[tuple[int, int, int]]]:
    """(nodes with features, edges) of a text, which is read once."""
    if not text:
        return [], []
    nodes = candidates(text, base_spans(text))
    links = edges(text, nodes)
    found = {key for label, a, b in nodes if label for key in enumerate(keys(text[a:b]))}
    known = [bool(label) or found.isdisjoint(enumerate(keys(text[a:b]))) for label, a, b in nodes]
    return [(label, a, b, k, shape(text[a:b]) + context(text, a, b)) for (label, a, b), k in zip(nodes, known, strict=True)], links


def examples(nodes: list, links: list) -> Iterator[tuple[int, list[int]]]:
    """(label, features) of the known candidates, with the labels of known ones beside them; each with, without its shape, and by its neighbours alone."""
    beside: list[list[int]] = [[] for _ in nodes]
    for a, b, kind in links:
        if nodes[b]["known"]:
            beside[a].append((NEXT, SKIP)[kind] + nodes[b]["label"])
        if nodes[a]["known"]:
            beside[b].append((PREVIOUS, SKIP)[kind] + nodes[a]["label"])
    for node, near in zip(nodes, beside, strict=True):
        if node["known"]:
            own = list(node["features"])
            yield node["label"], own + near
            yield node["label"], [f for f in own if f >= CONTEXT] + near
            if near:
                yield node["label"], near


class Field:
    """The potentials: weights (labels x features) and intercepts. Each pair potential is the mean of what its two ends say."""

    def __init__(self, weights: np.ndarray | None = None, intercept: np.ndarray | None = None):
        self.weights = np.zeros((LABELS, FEATURES)) if weights is None else weights
        self.intercept = np.zeros(LABELS) if intercept is None else intercept
        # [left label, right label]
        self.chain = (self.weights[:, PREVIOUS : PREVIOUS + LABELS].T + self.weights[:, NEXT : NEXT + LABELS]) / 2
        skip = self.weights[:, SKIP : SKIP + LABELS]
        self.skip = (skip + skip.T) / 2

    def unary(self, features: list[int]) -> np.ndarray:
        return self.intercept + self.weights[:, list(features)].sum(axis=1)

    def posterior(self, nodes: list, links: list) -> tuple[np.ndarray, bool]:
        """(label distributions of the nodes, whether the messages settled), by damped sum-product along all edges at once; found ones stay fixed."""
        done = True
        own = np.array([np.where(np.arange(LABELS) == n["label"], 0.0, -200.0) if n["label"] else self.unary(n["features"]) for n in nodes])
        if links:
            u, v, kind = (np.array(c) for c in zip(*links, strict=True))
            source, target = np.concatenate([u, v]), np.concatenate([v, u])
            pair = np.where(kind[:, None, None] == 1, self.skip, self.chain)
            potentials = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(u)) + len(u), np.arange(len(u))])
            message = np.zeros((len(source), LABELS))
            for _ in range(ROUNDS):
                belief = own.copy()
                np.add.at(belief, target, message)
                inner = (belief[source] - message[back])[:, :, None] + potentials
                top = inner.max(axis=1, keepdims=True)
                new = (top + np.log(np.exp(inner - top).sum(axis=1, keepdims=True)))[:, 0, :]
                new -= new.max(axis=1, keepdims=True)
                step = DAMPING * message + (1 - DAMPING) * new
                done = np.abs(step - message).max() < 1e-4
                message = step
                if done:
                    break
            np.add.at(own, target, message)
        p = np.exp(own - own.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), bool(done)


def spans_of(nodes: list, links: list, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """(base spans, all spans, both by kind, then start; whether the field settled)."""
    base = sorted((n["label"] - 1, n["start"], n["end"]) for n in nodes if n["label"])
    free = [i for i, n in enumerate(nodes) if not n["label"]]
    added, settled = [], True
    if free:
        p, settled = field.posterior(nodes, links)
        for i in free:
            label = int(p[i].argmax())
            if label and p[i][label] >= SURE:
                added.append((label - 1, nodes[i]["start"], nodes[i]["end"]))
    return base, sorted([*base, *added]), settled


def candidates_of(text: Column) -> Column:
    """A struct of nodes and edges (READ) of each text; the only pass over the texts."""

    @F.pandas_udf(READ)
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [read(t) for t in texts]
        names, ends = ("label", "start", "end", "known", "features"), ("a", "b", "kind")
        return pd.DataFrame({"nodes": [[dict(zip(names, n, strict=True)) for n in f[0]] for f in found], "edges": [[dict(zip(ends, e, strict=True)) for e in f[1]] for f in found]})

    return of(text)


def fit(marked: DataFrame, nodes: str = "nodes", links: str = "edges") -> Field:
    """The field trained on the candidates of all rows; without two labels to tell apart it says nothing.

    The prior has the weight of a fixed number of candidates, so training behaves alike at every size.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    @F.pandas_udf("array<struct<label:int,features:array<string>>>")
    def seen(all_nodes: pd.Series, all_links: pd.Series) -> pd.Series:
        def of(ns, es):
            return [{"label": y, "features": list(map(str, f))} for y, f in examples(list(ns), [(e["a"], e["b"], e["kind"]) for e in es])]

        return pd.Series([of(ns, es) for ns, es in zip(all_nodes, all_links, strict=True)])

    # Outer, as of a plain explode Spark would infer a filter and so evaluate the function twice.
    rows = marked.where(F.size(nodes) > 0).select(F.explode_outer(seen(F.col(nodes), F.col(links))).alias("e")).where("e is not null").select("e.*")
    rows = written(rows, "pii_examples")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return Field()
    # The features are their own numbers, so the vectors have fixed places.
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in range(FEATURES)], inputCol="features", outputCol="vector").setMinTF(1.0)
    model = LogisticRegression(featuresCol="vector", family="multinomial", maxIter=STEPS, regParam=1 / (VARIANCE * sum(n.values())), standardization=False, tol=1e-6).fit(vectors.transform(rows))
    if model.summary.totalIterations >= STEPS:
        raise RuntimeError(f"the potentials have not settled after {STEPS} steps")
    weights, intercept = np.zeros((LABELS, FEATURES)), np.full(LABELS, -50.0)
    learned = model.coefficientMatrix.toArray()
    weights[: len(learned)], intercept[: len(learned)] = learned, model.interceptVector.toArray()
    intercept[[k for k in range(LABELS) if not n.get(k)]] = -50.0  # a kind that no document holds
    return Field(weights, intercept)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted_text(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its (first) kind in angle brackets."""
    if not spans:
        return text
    out, at = [], 0
    ordered = sorted((a, b, k) for k, a, b in spans)
    i = 0
    while i < len(ordered):
        a, b, k = ordered[i]
        while i + 1 < len(ordered) and ordered[i + 1][0] < b:
            i += 1
            b = max(b, ordered[i][1])
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def marked(docs: DataFrame, text: str = "text", into: str = "pii", redact: bool = False) -> DataFrame:
    """docs with a struct column `into`: counts (base, by kind), base_sha256, spans, redacted text if asked for, and settled.

    settled is false where messages of a document still changed after ROUNDS; its spans are those of the last round.

    The candidates are written once, beside the columns of docs (without the text if not redact); both the training and the
    verdicts read them there. Spans are code point offsets, end exclusive. Null and empty texts hold nothing; repeated rows
    are marked alike; very long texts are read whole, in linear time; on an empty table nothing is learned or found; other
    columns pass through (one named `into` is replaced).
    """
    held = fresh(docs, f"{into}_candidates")
    read_ = docs.withColumn(held, candidates_of(F.col(text)))
    read_ = written(read_ if redact else read_.drop(text), "pii")
    nodes, links = F.col(f"{held}.nodes"), F.col(f"{held}.edges")
    field = docs.sparkSession.sparkContext.broadcast(fit(read_.select(nodes.alias("nodes"), links.alias("edges"))))

    @F.pandas_udf("counts array<long>, base_sha256 string, spans string, redacted string, settled boolean")
    def mark(all_nodes: pd.Series, all_links: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for ns, es, t in zip(all_nodes, all_links, texts, strict=True):
            base, spans, settled = spans_of(list(ns), [(e["a"], e["b"], e["kind"]) for e in es], field.value)
            counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
            rows.append((counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redacted_text(t, spans) if redact else None, settled))
        return pd.DataFrame(rows, columns=["counts", "base_sha256", "spans", "redacted", "settled"])

    return read_.withColumn(into, mark(nodes, links, F.col(text) if redact else F.lit(None).cast("string"))).drop(held)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans of the field alone), settled."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    x = F.col("pii")
    n = F.when(x["spans"] == "", 0).otherwise(F.regexp_count(x["spans"], F.lit(",")) + 1) - F.aggregate(x["counts"], F.lit(0).cast("long"), lambda a, c: a + c)
    return marked(slim).select("doc_id", *[x["counts"][k].alias(f"n_{kind}") for k, kind in enumerate(KINDS)], x["base_sha256"].alias("base_sha256"), x["spans"].alias("spans"), n.cast("long").alias("n_added"), x["settled"].alias("settled"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans in their texts replaced by kinds in angle brackets.

    Null texts stay null and empty ones empty, repeated rows are changed alike, very long texts are changed whole, an empty
    table stays empty, and other columns stay as they are, whatever their names.
    """
    into = fresh(docs, "pii")
    out = marked(docs, text, into, redact=True)
    return out.withColumn(text, F.col(f"{into}.redacted")).select(*docs.columns)
