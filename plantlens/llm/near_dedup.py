"""Near-duplicate documents: MinHash bands, sequential Bayesian verification of signatures, exact check on full sets.

1. Each text becomes its set of word shingles, a hash of the whole set (equal sets are one class from here on) and a
   MinHash signature.
2. Classes that agree in a band meet in its bucket. There, signatures are compared in batches of hashes: after each batch
   a pair is pruned when, from a uniform prior, the posterior probability that its similarity reaches the threshold is
   under the miss probability. Of the pairs left only a spanning forest of each bucket is returned, so a bucket of n
   members returns at most n - 1 pairs.
3. The forests' connected components are candidate clusters; any two classes that banding and posterior would link are in
   one cluster. Texts of clustered classes (nothing else) are shuffled once, and inside a cluster every pair that is not
   yet connected and survives the posterior is checked exactly on full sets.
4. The components of the confirmed links are the groups.

Buckets and clusters over a block's size are dealt to blocks by hash, and their member of the least id, the hub, goes to
every block. Members that are linked with the hub in their block are connected with all others that are; only the rest go
on to the other blocks. So n near copies of one page take n comparisons, and only what differs from the hub takes more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, spaced_words, written
from .graph import components

#: Words of a shingle; hashes of a signature, of a band, of a batch of the sequential verification.
SHINGLE, HASHES, ROWS, BATCH = 3, 125, 5, 25
#: A link needs 100 * intersection >= 85 * union.
THRESHOLD = 85
#: A pair is pruned when, after any batch, its posterior chance to reach the threshold is under this.
MISS = 1e-6
#: Members of a bucket or cluster, and shingles of a cluster's members, that one block holds.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1500, 2_000_000
SIGNED = "n_shingles long, set_key binary, signature binary"


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than `size`: the whole sequence as one."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    digest, join = xxhash.xxh3_64_intdigest, b" ".join
    columns = [words[k : len(words) - size + 1 + k] for k in range(size)]
    return np.unique(np.array([digest(join(s)) for s in zip(*columns, strict=True)], np.uint64))


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each multiply-shift hash over the set, upper 32 bits; in parts, so that memory is bounded."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 512):
        x = hashes[start : start + 512]
        np.minimum(out, (x[None, :] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """For each batch end n the fewest matches m with P(similarity >= threshold | m of n match) >= miss.

    From a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        p, tail = (1 - threshold) ** (n + 1), 0.0
        for m in range(n + 1):
            tail += p
            if tail >= miss:
                break
            p *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
        out.append(m)
    return out


def miss_rate(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> float:
    """The chance that the batches prune a pair whose similarity is the threshold: matches are binomial, batch by batch."""
    alive, n = np.ones(1), 0
    step = np.array([math.comb(batch, k) * threshold**k * (1 - threshold) ** (batch - k) for k in range(batch + 1)])
    for least in least_matches(threshold, miss, hashes, batch):
        alive, n = np.convolve(alive, step), n + batch
        alive[:least] = 0.0
    return float(1 - alive.sum())


def survivors(row: np.ndarray, others: np.ndarray, least: list[int], batch: int = BATCH) -> np.ndarray:
    """Numbers of the signatures among `others` that no batch's posterior prunes against `row`."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int32)
    for k, m in enumerate(least):
        cut = slice(k * batch, (k + 1) * batch)
        matches = matches + (others[alive, cut] == row[cut]).sum(axis=1, dtype=np.int32)
        keep = matches >= m
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def signed(docs: DataFrame, text: str = "text", into: str = "signed", shingle: int = SHINGLE) -> DataFrame:
    @F.pandas_udf(SIGNED)
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a, b = hash_family(HASHES)
        for texts in batches:
            rows = []
            for t in texts:
                s = shingles(t, shingle)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s, a, b).tobytes()) if len(s) else (0, None, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "signature"])

    return docs.withColumn(into, sign(F.col(text)))


def groups_in(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of a sorted partition, over batch bounds."""
    held: list[pd.DataFrame] = []
    last = None
    for df in batches:
        if not len(df):
            continue
        values = df[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), len(df)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            now = tuple(values[start])
            if held and now != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(df.iloc[start:end])
            last = now
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def forest(reps: np.ndarray, sig: np.ndarray, least: list[int], linked: Callable[[int, int], bool], label: np.ndarray, foreign: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that connect what `linked` confirms among all pairs, or those of a foreign and another member.

    `label` tells who is connected already; those aren't compared, and it is brought up to date. Of the others, those that
    the posterior leaves are tried from the most matches down. All arrays are as long as a block, or two.
    """
    out = []
    for i in range(len(reps)) if foreign is None else np.flatnonzero(foreign).tolist():
        open_ = label != label[i]
        if foreign is None:
            open_[: i + 1] = False
        else:
            open_ &= ~foreign
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        alive = others[survivors(sig[i], sig[others], least)]
        for j in alive[np.argsort(-(sig[alive] == sig[i]).sum(axis=1), kind="stable")].tolist():
            if label[i] != label[j] and linked(i, j):
                label[label == label[j]] = label[i]
                out.append((reps[i], reps[j]))
    return out


def tester(df: pd.DataFrame, threshold: int, shingle: int) -> Callable[[int, int], bool]:
    """Whether two members link: on full sets where the members have texts; else the posterior has the last word."""
    if "text" not in df:
        return lambda i, j: True
    sets = [shingles(t, shingle) for t in df["text"]]
    return lambda i, j: linked_sets(sets[i], sets[j], threshold)


def stacked(df: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(df["signature"]), np.uint32).reshape(len(df), HASHES)


def inside(batches: Iterator[pd.DataFrame], least: list[int], threshold: int, shingle: int) -> Iterator[pd.DataFrame]:
    """Links of each block, and as (rep, rep, small) the members that aren't connected with the hub, if there are more blocks."""
    for df in groups_in(batches, ["key", "block"]):
        df = df.iloc[np.argsort((df["rep"] != df["hub"]).to_numpy(), kind="stable")]
        reps, label = df["rep"].to_numpy(), np.arange(len(df))
        links = forest(reps, stacked(df), least, tester(df, threshold, shingle), label)
        left = reps[label != label[0]].tolist() if df["blocks"].iat[0] > 1 else []
        if links or left:
            yield pd.DataFrame([(df["key"].iat[0], a, b, False) for a, b in links] + [(df["key"].iat[0], a, a, True) for a in left], columns=["key", "a", "b", "small"])


def across(batches: Iterator[pd.DataFrame], least: list[int], threshold: int, shingle: int) -> Iterator[pd.DataFrame]:
    """Links of small members of other blocks with the members of a block; those connected with the hub share a label."""
    for df in groups_in(batches, ["key", "block", "chunk"]):
        foreign, small = df["foreign"].to_numpy(), df["small"].to_numpy()
        if foreign.any() and not foreign.all():
            label = np.where(small, np.arange(len(df)) + 1, 0)
            links = forest(df["rep"].to_numpy(), stacked(df), least, tester(df, threshold, shingle), label, foreign)
            if links:
                yield pd.DataFrame([(df["key"].iat[0], a, b, False) for a, b in links], columns=["key", "a", "b", "small"])


def links_among(members: DataFrame, with_payload: Callable[[DataFrame], DataFrame], least: list[int], threshold: int, shingle: int) -> DataFrame:
    """(a, b) that connect the members of each key; members: key, rep, hub (the least rep of the key), blocks.

    with_payload adds the signature, and the text where links are confirmed on full sets.
    """
    schema = "key long, a long, b long, small boolean"
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))
    dealt = with_payload(members.withColumn("block", F.explode(F.when(F.col("rep") == F.col("hub"), every).otherwise(F.array(own)))))
    parts = dealt.repartition("key", "block").sortWithinPartitions("key", "block")
    found = written(parts.mapInPandas(lambda batches: inside(batches, least, threshold, shingle), schema), "links")
    links, small = found.where("not small").select("a", "b"), found.where("small").select("key", F.col("a").alias("rep"), "small")
    if small.isEmpty():
        return links
    chunks = small.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).alias("chunks"))
    tagged = members.join(chunks, "key").join(small.distinct(), ["key", "rep"], "left").withColumn("small", F.coalesce("small", F.lit(False))).withColumn("block", own)
    here = tagged.withColumns({"foreign": F.lit(False), "chunk": F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))})
    guests = tagged.where("small").withColumns({"foreign": F.lit(True), "chunk": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int"), "block": F.explode(F.array_remove(every, own))})
    parts = with_payload(here.unionByName(guests)).repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk")
    return links.union(parts.mapInPandas(lambda batches: across(batches, least, threshold, shingle), schema).select("a", "b"))


def linked_sets(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    if min(len(x), len(y)) * 100 < threshold * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    Words are what ASCII white space separates, A-Z lower-cased; a document's set is its distinct shingles, with fewer
    words the whole sequence as one, without words empty. Documents link when 100 * intersection >= threshold * union;
    component_id is the smallest doc_id reachable over links, itself included; null, empty and wordless texts link with
    nothing. Copies and repeated rows share one class; rows of one id with different texts are one document that links
    through each of them; a null doc_id links with nothing; very long texts are compared whole; an empty table gives no
    rows; other columns are not kept.

    A link at the threshold is missed when no band of `rows` hashes agrees (4e-7 at 0.85 and 5 rows, 8e-8 at 0.80 and 4),
    or when the posterior prunes it (`miss_rate`: 7e-6 at 0.85).
    """
    least = least_matches(threshold / 100, miss)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_key"))
    sets = written(signed(slim, shingle=shingle).select("doc_id", "text_key", "signed.*"), "signed")
    has = sets.where("set_key is not null and doc_id is not null")
    reps = has.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    reps = written(reps.select("set_key", F.col("least.doc_id").alias("rep"), F.col("least.text_key").alias("text_key"), "signature", "n"), "classes")

    # Bands: only keys that several classes have go on.
    width = 4 * rows
    bands = reps.select("rep", "text_key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // rows - 1)), lambda k: F.xxhash64(k, F.substring(F.col("signature"), k * width + 1, F.lit(width))))).alias("key"))
    full = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("hub")).where("members > 1")
    met = bands.join(full, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK_MEMBERS)).drop("members")
    signatures = reps.select("rep", "text_key", "signature")
    clusters = components(links_among(met, lambda df: df.join(signatures, ["rep", "text_key"]), least, threshold, shingle))

    # Texts of clustered classes, once; blocks by how many shingles a cluster has.
    members = clusters.select(F.col("node").alias("rep"), F.col("component").alias("key")).join(reps.select("rep", "text_key", "n"), "rep")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("n") / BLOCK_MEMBERS))
    members = written(members.join(members.groupBy("key").agg(blocks.alias("blocks")), "key").select("key", "rep", "text_key", F.col("key").alias("hub"), "blocks"), "members")
    texts = slim.join(members.select(F.col("rep").alias("doc_id"), "text_key"), ["doc_id", "text_key"], "left_semi").withColumnRenamed("doc_id", "rep")
    with_texts = lambda df: df.join(signatures, ["rep", "text_key"]).join(texts.dropDuplicates(["rep", "text_key"]), ["rep", "text_key"])
    found = components(links_among(members, with_texts, least, threshold, shingle)).select(F.col("node").alias("rep"), "component")

    by_set = reps.select("set_key", "rep").join(found, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sets.select("doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each group, that of the smallest id.

    Null, empty and wordless texts are groups of their own and stay; of repeated rows of an id one stays, rows with a null
    id all stay; very long texts are compared whole; an empty table stays empty; other columns stay as they are, whatever
    their names.
    """
    gone = classes(docs, doc_id, text, **options).where("not kept").select(F.col("doc_id").alias(doc_id)).distinct()
    left = docs.join(gone, doc_id, "left_anti").select(*docs.columns)
    lone = fresh(docs, "lone")
    return left.withColumn(lone, F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id())).dropDuplicates([doc_id, lone]).drop(lone)
