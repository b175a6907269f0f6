"""Language identification by compression: the language whose zstandard dictionary makes a text smallest.

A language's raw-content dictionary is its words, the most frequent last (nearest to the text); matches of four bytes and
more are allowed, so that short words count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, utf8, written

#: Documents that a language's dictionary is made from at most (those of the smallest hashes), and its size in bytes.
SAMPLE_DOCS, DICTIONARY_BYTES = 1000, 112_640
LEVEL, LEAST_MATCH = 5, 4
#: Blanks after each text: a block that doesn't shrink is stored as it is, alike for all languages; with them even the
#: shortest text's block shrinks, and what of it the dictionary holds counts.
PAD = b" " * 64
#: A verdict is narrow, to be rejected, when the second best language takes less than this share more.
MARGIN = 0.01


def fit_dictionaries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from learnable rows: text and lang not null, id fold not 2.

    Of each language sample_docs ids at most are taken; what comes to the driver is bounded by that, the dictionary size
    and the number of languages. Exact copies count once.
    """
    learn = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != 2))
    langs = sorted(r[0] for r in learn.select(lang).distinct().collect())
    if not langs:
        return {}
    pick = lambda one: learn.where(F.col(lang) == one).select(F.col(lang).alias("_lang"), F.col(doc_id).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    ids = reduce(DataFrame.unionByName, [pick(one) for one in langs])
    texts = learn.join(F.broadcast(ids), (F.col(doc_id) == F.col("_id")) & (F.col(lang) == F.col("_lang"))).select("_lang", F.lower(text).alias("t")).distinct()
    words = texts.select("_lang", F.explode(F.array_distinct(F.split("t", r"[\x20\x09-\x0D]+"))).alias("w")).where("w <> ''").groupBy("_lang", "w").agg(F.count(F.lit(1)).alias("n"))
    words = written(words, "words")
    out = {}
    for one in langs:
        body: list[bytes] = []
        used = 0
        # A word takes two bytes at least, which bounds how many can be used.
        for r in words.where(F.col("_lang") == one).orderBy(F.desc("n"), "w").limit(size // 2).toLocalIterator():
            word = r.w.encode() + b" "
            if used + len(word) > size:
                break
            body.append(word)
            used += len(word)
        out[one] = b"".join(reversed(body))
    return {k: v for k, v in out.items() if v}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", into: str = "language", margin: float = MARGIN) -> DataFrame:
    """docs with a struct column `into`: lang, score, narrow, sizes.

    The whole text, lower-cased, is compressed once with each dictionary; the smallest wins, ties go to the
    first language by name. score grows with 1 - best / second best, from 0.5 to 1; narrow marks a verdict to reject. Null
    texts, texts without a letter and any text when nothing was learned are `und` with score 0. Other columns pass
    through (one named `into` is replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("lang string, score double, narrow boolean, sizes array<int>")
    def choose(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard as zstd

        coders = []
        for lang, body in shared.value.items():
            d = zstd.ZstdCompressionDict(body, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            how = zstd.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(body), min_match=LEAST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            coders.append((lang, zstd.ZstdCompressor(compression_params=how, dict_data=d)))
        for texts in batches:
            rows = []
            for t in texts:
                if not coders or not t or not any(map(str.isalpha, t)):
                    rows.append(("und", 0.0, True, []))
                    continue
                raw = utf8(t.lower()) + PAD
                sizes = [len(c.compress(raw)) for _, c in coders]
                order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
                gap = 1.0 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0
                rows.append((coders[order[0]][0], min(1.0, 0.5 + 5 * gap), gap < margin, sizes))
            yield pd.DataFrame(rows, columns=["lang", "score", "narrow", "sizes"])

    return docs.withColumn(into, choose(F.col(text)))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, narrow."""
    dictionaries = fit_dictionaries(docs, doc_id, text, lang)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    x = F.col("language")
    return predict(slim, dictionaries).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), x["lang"].alias("lang_pred"), x["score"].alias("score"), x["narrow"].alias("narrow"))
