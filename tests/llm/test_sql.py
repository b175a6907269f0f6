"""Queries of the text operators against their SQL, and the pipeline against its parts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantlens.llm import common, queries

from ..compare import assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    assert_same(queries.queries()[name](spark, sf_dir), duck.sql(queries.oracle_sql()[name]))


def test_pipeline(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    own = queries.queries()
    kept = docs.join(own["op10_quality"](spark, sf_dir).where("kept").select("doc_id"), "doc_id", "left_semi")
    kept = common.written(kept.select(*docs.columns), "kept")
    from plantlens.llm import decontamination, near_dedup, pii

    groups = near_dedup.classes(kept, threshold=80, shingle=5, rows=4).where("kept").select("doc_id")
    clean = decontamination.report(kept, common.table(spark, sf_dir, "benchmark")).where("not contaminated").select("doc_id")
    left = common.written(kept.join(groups, "doc_id", "left_semi").join(clean, "doc_id", "left_semi").select(*docs.columns), "left")
    left = pii.redacted(left)
    got = corpus_pipeline.run(spark, sf_dir)
    assert {r[0] for r in got.select("doc_id").distinct().collect()} == {r[0] for r in left.select("doc_id").collect()}
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_keep_the_columns(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, docs, sf_dir).columns) == set(docs.columns)


def test_urls_sql_with_links(spark):
    import random

    import duckdb

    from plantlens.llm import urls

    rng = random.Random(11)
    hosts = [f"{a}.example.{b}" for a in "pqrst" for b in ("com", "net", "org")]
    rows = []
    for i in range(150):
        links = "".join(f'<a href="{rng.choice(["http://", "//"])}{rng.choice(hosts)}/x">' for _ in range(rng.randrange(3)))
        rows.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['en/7', 'en/1', 'de/1', 'de/8', 'es/', 'fr/'])}", links))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert_same(urls.report(pages), con.sql(queries.oracle_sql()["op5_url_filter"]))


def test_licenses_sql_with_wrapped_notices(spark):
    import duckdb

    from plantlens.llm import licenses

    from .test_edge_cases import WRAPPED

    filler = " filler" * 60
    texts = [*WRAPPED.values(), None, "", *(n for _, n in licenses.TEMPLATES), filler.join("released under the mit license".split()), filler + " released\nunder x the mit license twice released under the mit license" + filler]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert_same(licenses.report(docs), con.sql(queries.oracle_sql()["op6_licenses"]))
