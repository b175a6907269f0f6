"""Each text operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from plantlens.llm import decontamination, language, licenses, near_dedup, packing, pii, quality, token_counts, toxicity, urls
from plantlens.llm.queries import vocabulary_path

LONG = "word another third " * 60_000
#: Columns that clash with names the operators use inside or return.
EXTRA = ("signed", "kept", "component", "quality", "pieces", "tokens", "language", "_pii", "pii", "lone", "contamination", "quality_text", "hits", "cluster", "rep", "n", "w", "t", "lang", "source", "score")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "One two three four five six seven eight nine ten eleven."), (5, "One two three four five six seven eight nine ten eleven."), (6, "one two three four five six seven eight nine ten eleven."), (None, "lone row without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "four FIVE six seven eight nine ten eleven one two"), (2, None), (3, "..."), (None, "one"), (4, "nine ten")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (5, 1, 0), (5, 1, 1), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def pieces():
    return token_counts.read_pieces(vocabulary_path())


def cases(docs, benchmark, labels):
    return {
        "op1": lambda d: pii.report(d),
        "op2": lambda d: near_dedup.classes(d),
        "op3": lambda d: decontamination.report(d, benchmark),
        "op4": lambda d: toxicity.report(d, labels),
        "op6": lambda d: licenses.report(d),
        "op7": lambda d: packing.pack(d, vocabulary_path()),
        "op8": lambda d: language.report(d),
        "op9": lambda d: token_counts.report(d, pieces()),
        "op10": lambda d: quality.report(d),
    }


@pytest.mark.parametrize("op", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10"])
def test_rows_are_whole(docs, benchmark, labels, op):
    got = cases(docs, benchmark, labels)[op](docs).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got if op != "op7" or r["piece"] == 0)
    assert ids == sorted((i is None, i or 0) for i in (1, 2, 3, 4, 5, 5, 6, None))


@pytest.mark.parametrize("op", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10"])
def test_empty_table(docs, benchmark, labels, op):
    assert cases(docs, benchmark, labels)[op](docs.limit(0)).count() == 0


def test_defined_results(docs, benchmark, labels):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    x = by(near_dedup.classes(docs))
    assert [x[k]["n_shingles"] for k in (1, 2, 3, 5)] == [0, 0, 0, 9]
    assert [x[k]["component_id"] for k in (1, 2, 3, 6)] == [1, 2, 3, 5] and not x[6]["kept"] and x[None]["component_id"] is None
    x = by(decontamination.report(docs, benchmark))
    assert (x[1]["n_words"], x[1]["contaminated"]) == (0, False)
    assert (x[5]["n_hit"], x[5]["n_items"]) == (2, 1)  # "nine ten" is one window; the ten-word item doesn't occur
    x = by(quality.report(docs))
    assert x[1]["base_failed"] and x[4]["base_failed"] and x[4]["n_repeat_words"] == x[4]["n_words"] == 180_000
    x = by(language.report(docs))
    assert [x[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3
    x = by(licenses.report(docs))
    assert x[1]["first_word"] is None and x[1]["labels"] == "" and x[1]["score"] == 0.0
    x = by(toxicity.report(docs, labels))
    assert all(0 <= r["score"] <= 1 for r in x.values())


def test_other_columns_pass_through(docs, benchmark):
    assert set(quality.filtered(docs).columns) == set(docs.columns)
    assert set(near_dedup.deduplicated(docs).columns) == set(docs.columns)
    assert set(decontamination.decontaminate(docs, benchmark).columns) == set(docs.columns)
    assert set(pii.redacted(docs).columns) == set(docs.columns)


def test_dedup_keeps_one_of_repeated_rows_and_all_null_ids(docs):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near_dedup.deduplicated(docs).select("doc_id").collect())
    assert got == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]


def test_urls(spark):
    rows = [(1, None, None), (2, "no scheme", "<a href=x>"), (3, "http://A.Example.COM/en/71?x", ""), (4, "https://b.com/en", None), (5, "x://org/es/1#a", "<a href='//b.com/q'>"), (5, "x://org/es/1#a", None), (6, "http://b.com?en/", None), (7, "http://ncom/en/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "kind": F.lit(2), "trust": F.lit(3)})
    got = {r["page_id"]: r for r in urls.report(pages).collect()}
    assert urls.report(pages).count() == 8 and urls.report(pages.limit(0)).count() == 0
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("", "", None, "allow")
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[4]["rule"] is None and got[6]["path"] == "" and got[7]["rule"] is None
    assert got[5]["verdict"] == "block"


def test_equal_rules_and_embedded_addresses(spark):
    rules = [("block", "a.com", "/x"), ("allow", "com", "/xxx")]
    assert len("a.com/x") == len("com/xxx") == 7
    pages = spark.createDataFrame([(1, "http://a.com/xxx", '<a href="/go?u=http://other.org/"><a href=//b.org><a href="HTTPS://c.org/">')], "page_id long, url string, html string")
    r = urls.report(pages, rules=rules).first()
    assert (r["rule"], r["verdict"]) == ("a.com/x", "block")
    edges = urls.host_edges(pages.withColumn("host", urls.host_of(F.col("url"))), "host", "html")
    assert sorted(e["dst"] for e in edges.collect()) == ["b.org", "c.org"]


@pytest.mark.parametrize("stage", ["quality_rules", "near_dedup", "decontamination", "pii"])
def test_stages_on_odd_rows_and_empty_tables(spark, docs, sf_dir, stage):
    """Each stage keeps the columns, and no stage fails on nulls, long texts, repeated rows or an empty table."""
    import corpus_pipeline

    run = dict(corpus_pipeline.STAGES)[stage]
    rows = docs.withColumn("n_chars", F.lit(1).cast("long"))
    assert run(spark, rows.limit(0), sf_dir).count() == 0
    got = run(spark, rows, sf_dir)
    assert set(got.columns) == set(rows.columns)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.select("doc_id").collect())
    every = [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 5), (False, 6), (True, 0)]
    assert ids == {"quality_rules": [(False, 5), (False, 5), (False, 6)], "near_dedup": [*every[:5], (True, 0)], "decontamination": every, "pii": every}[stage]


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software")""",
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:""",
    "gpl": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by""",
    "mpl": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. */""",
    "cc-by": """This work is licensed under a Creative
Commons Attribution 4.0 International License.""",
}


def test_wrapped_notices(spark):
    rows = [(label, "some words before\n" + text + "\nand after") for label, text in WRAPPED.items()]
    got = {r["doc_id"]: r for r in licenses.report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: r["labels"] for k, r in got.items()} == {k: k for k in WRAPPED}
    assert all(r["score"] >= 0.9 for r in got.values())


def test_scattered_words_of_a_long_line_are_no_notice(spark):
    filler = " filler" * 500
    rows = [(1, filler.join(["released", "under", "the", "mit", "license"])), (2, filler + " released under the mit" + " license" + filler), (3, filler + " released\nunder the x mit license" + filler)]
    got = {r["doc_id"]: r for r in licenses.report(spark.createDataFrame(rows, "doc_id int, text string"), phrases={}).collect()}
    assert [(got[k]["labels"], got[k]["score"]) for k in (1, 2, 3)] == [("", 0.0), ("mit", 1.0), ("mit", 1.0)]


def test_best_blocks_equal_all_windows():
    import random

    rng = random.Random(7)
    for _ in range(300):
        words = [rng.randrange(6) for _ in range(rng.randrange(1, 60))]
        places = [(at, w) for at, w in enumerate(words) if w < 4]
        windows = [len({w for w in words[at : at + 5] if w < 4}) for at in range(len(words))]
        got = licenses.best_blocks(places, 5, 3)
        assert max((n for _, n in got), default=0) == (max(windows) if max(windows) >= 3 else 0)
        assert all(windows[at] == n for at, n in got)


def test_rare_offensive_words_count(spark):
    import random

    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    neutral = lambda: [rng.choice(words) for _ in range(12)]
    # A hundred offensive words, each in three toxic examples of 300 (1 %).
    rows = [(i, " ".join(neutral() + [f"slur{i % 100}"]), 1) for i in range(300)] + [(1000 + i, " ".join(neutral()), 0) for i in range(900)]
    asked = [(5000 + i, f"slur{i} slur{i + 50} unheard", None) for i in range(20)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, toxic int")
    labels = docs.where("toxic is not null").select("doc_id", "toxic")
    got = toxicity.report(docs.drop("toxic"), labels).where("doc_id >= 5000").collect()
    assert len(got) == 20 and all(r["predicted"] == 1 for r in got)


def test_document_frequency_is_over_all_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "A a c"), (3, None), (4, "d"), (5, "")], "doc_id long, text string")
    total, counts = toxicity.document_frequency(docs.repartition(3), "text", [b"a", b"c", b"x"])
    assert (total, counts.tolist()) == (4, [2, 1, 0])


def test_propagation_settles_with_production_values(spark):
    # A ring of 30 hosts: without ends, so that the scores settle slowly; the far ones are over 20 links from the seed.
    n = 30
    edges = spark.createDataFrame([("block", f"h{i}", f"h{(i + 1) % n}", 1) for i in range(n)], "kind string, src string, dst string, n int")
    seeds = spark.createDataFrame([("block", "h0", 1.0)], "kind string, host string, weight double")
    got = {r["host"]: r["score"] for r in urls.propagated(edges, seeds).collect()}
    want = {f"h{i}": 0.15 * 0.85**i / (1 - 0.85**n) for i in range(n)}
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-5 for h in want)
    with pytest.raises(RuntimeError):
        urls.propagated(edges, seeds, rounds=3)


def test_pipeline_on_odd_tables(spark, docs, benchmark, tmp_path):
    """run() and its packing stage on nulls, empty and very long texts, repeated rows, clashing columns, and an empty table."""
    import corpus_pipeline

    good = [(k, f"Line {k} holds its own quite plain words, number {k * 7919}, of which there are enough to pass. " * 1 + " ".join(f"word{k}x{j}" for j in range(60)) + ".") for k in range(20, 26)]
    own = spark.createDataFrame([*good, good[0], (30, None), (31, "")], "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("kept", "pii", "pieces", "sequence_id", "lang", "source")], F.lit(1).cast("long").alias("n_chars"))
    own.write.parquet(str(tmp_path / "t/documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "t/benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "t")).collect()
    ids = [r["doc_id"] for r in got if r["piece"] == 0]
    assert set(ids) <= {k for k, _ in good} and len(ids) == len(set(ids)) >= 5
    own.limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "e/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0
    packed = corpus_pipeline.best_fit_packing(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in packed if r["piece"] == 0) == sorted((i is None, i or 0) for i in (1, 2, 3, 4, 5, 5, 6, None))
