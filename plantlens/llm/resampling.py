"""Importance resampling towards a target: hashed n-grams of words, log ratios of their frequencies, a weighted draw.

A document is brought to words with one space between, and scanned once for the CRC32 of every prefix that ends at a word's
start or end. CRC32 is linear over GF(2): crc(AB) = crc(A) shifted by len(B) bytes, xor crc(B). So the CRC of the words
i..j is that of the prefix up to j's end, xor that of the prefix up to i's start shifted by the bytes between; no n-gram is
ever built. Shifts are products with powers of one bit matrix, applied to whole batches by table lookups.

Buckets of features are written once; their counts over all documents, and then the weights, are read from there. The draw
adds Gumbel noise by hash of the id to the weight and takes the highest scores, so it is a sample without replacement in
proportion to the importance; ranks come from a range partitioned order and offsets of its partitions, in no single task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, written

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SALT = 2, 10_000, 20, 25, "7:"
#: CRC32 of zlib, bits reversed.
POLYNOMIAL = 0xEDB88320


def product(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The bit matrix given as 4 x 256 lookups, times each x."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


@cache
def shifts(bits: int) -> tuple[np.ndarray, ...]:
    """Matrices that shift a CRC by 1, 2, 4, ... 2 ** (bits - 1) zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    tables = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    for _ in range(8):
        tables = np.where(tables & 1, (tables >> 1) ^ np.uint32(POLYNOMIAL), tables >> 1)
    out = [tables]
    for _ in range(bits - 1):
        out.append(product(out[-1], out[-1]))
    return tuple(out)


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC shifted by its number of zero bytes."""
    crc = crc.copy()
    for k, tables in enumerate(shifts(max(1, int(n_bytes.max(initial=0)).bit_length()))):
        at = np.flatnonzero((n_bytes >> k) & 1)
        crc[at] = product(tables, crc[at])
    return crc


def running(words: list[bytes]) -> tuple[list[int], list[int]]:
    """CRCs of the prefixes before each word's start and up to its end, words one space apart."""
    starts, ends, crc = [], [], 0
    for word in words:
        starts.append(crc)
        crc = crc32(word, crc)
        ends.append(crc)
        crc = crc32(b" ", crc)
    return starts, ends


def hashed(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, features of each, buckets of all features, text by text) for runs of 1 to `longest` words."""
    n_words, starts, ends, lengths = [], [], [], []
    for text in texts:
        words = alnum_words(text)
        before, upto = running(words)
        n_words.append(len(words))
        starts += before
        ends += upto
        lengths += map(len, words)
    n = np.array(n_words, dtype=np.int64)
    start_crc, end_crc = np.array(starts, dtype=np.uint32), np.array(ends, dtype=np.uint32)
    end = np.cumsum(np.array(lengths, dtype=np.int64) + 1) - 1
    start = end - np.array(lengths, dtype=np.int64)
    text_of = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    n_features = sum(np.maximum(n - m + 1, 0) for m in range(1, longest + 1))
    out, base = np.empty(int(n_features.sum()), dtype=np.int32), np.cumsum(n_features) - n_features
    for m in range(1, longest + 1):
        i = np.arange(max(len(end) - m + 1, 0))
        i = i[text_of[i] == text_of[i + m - 1]]
        crc = end_crc[i + m - 1] ^ shifted(start_crc[i], end[i + m - 1] - start[i])
        out[base[text_of[i]] + i - first[text_of[i]]] = crc % np.uint32(buckets)
        base = base + np.maximum(n - m + 1, 0)
    return n, n_features, out


def features(docs: DataFrame, keep: list[str], text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The columns `keep` of docs with n_words and buckets (of every n-gram, repeats and all). Null texts have no words."""
    names = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names, strict=True)], F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n_features, found = hashed(batch.column("text").to_pylist(), longest, buckets)
            ends = np.concatenate([[0], np.cumsum(n_features)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], names=[*names, "n_words", "buckets"])

    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))])
    return slim.mapInArrow(run, schema).toDF(*keep, "n_words", "buckets")


def bucket_counts(hashed_docs: DataFrame) -> dict[int, int]:
    """bucket -> features in it: at most as many rows as buckets reach the driver."""
    rows = hashed_docs.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return {r["bucket"]: r["n"] for r in rows.collect()}


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """A thousandth-step log ratio of smoothed target and raw frequencies per bucket, floored."""
    s_all, t_all = sum(raw.values()), sum(target.values())
    ratio = lambda b: float((target.get(b, 0) + 1) * (s_all + buckets)) / float((raw.get(b, 0) + 1) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def mean_gains(hashed_docs: DataFrame, keep: list[str], gain: np.ndarray) -> DataFrame:
    """`keep`, n_words, n_features and weight: the floored mean gain of a document's features, 0 without any."""
    names = [f"k{i}" for i in range(len(keep))]
    slim = hashed_docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names, strict=True)], "n_words", "buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("buckets")
            n = found.value_lengths().to_numpy().astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[found.flatten().to_numpy()])])
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*names, "n_words"]], pa.array(n), pa.array((sums[ends] - sums[ends - n]) // np.maximum(n, 1))], names=[*names, "n_words", "n_features", "weight"])

    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    return slim.mapInArrow(run, schema).toDF(*keep, "n_words", "n_features", "weight")


def weighted(docs: DataFrame, target: DataFrame, keep: list[str], text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The columns `keep` of every row of docs with n_words, n_features and weight.

    Frequencies come from all rows of docs and of target. Null and empty texts have no features and weight 0; very long
    ones are hashed whole; repeated rows count each; an empty table of docs gives no rows, an empty target has no features.
    `keep` must not name n_words, n_features, weight or buckets.
    """
    x = written(features(docs, keep, text, longest, buckets), "features")
    gain = gains(bucket_counts(x), bucket_counts(features(target, [], text, longest, buckets)), buckets)
    return mean_gains(x, keep, gain)


def noise(doc_id: str, salt: str = SALT):
    """A Gumbel draw in thousandths, floored, fixed by the id; a null id counts as an empty text."""
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(named, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(weights: DataFrame, doc_id: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, salt: str = SALT) -> DataFrame:
    """weights with score and rank; rank is null but for the highest scores, `percent` of the rows with least_words words.

    Of equal scores the smaller id is drawn, a null id first; of repeated ids the one with the fewer features, then the
    smaller weight. The order is over ranges of (able, score, id), so equal scores or a common weight fill no single task.
    """
    able = F.col("n_words") >= least_words
    x = weights.withColumn("score", F.col("weight") + noise(doc_id, salt)).withColumn("_out", ~able)
    order = [F.col("_out").asc(), F.col("score").desc(), F.col(doc_id).asc(), F.col("n_features").asc(), F.col("weight").asc()]
    x = written(x.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_at", 33).cast("long")
    sizes = x.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("_out"), 1).otherwise(0)).alias("able")).orderBy("p").collect()  # a row a partition
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["p"], before))
        before += r["n"]
    take = sum(r["able"] for r in sizes) * percent // 100
    starts = x.sparkSession.createDataFrame(offsets, "_p long, _before long")
    place = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_p"), 33) + 1
    x = x.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn("rank", F.when(~F.col("_out") & (place <= take), place))
    return x.drop("_p", "_before", "_at", "_out")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of docs, all columns; rows that share a drawn id go together."""
    ids = drawn(weighted(docs, target, [doc_id], **options), doc_id).where("rank is not null")
    return docs.join(ids.select(doc_id).distinct(), doc_id, "left_semi").select(*docs.columns)


def report(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return drawn(weighted(slim, target.select(F.col(text).alias("text")), ["doc_id"])).select("doc_id", "n_features", "weight", "score", "rank")
