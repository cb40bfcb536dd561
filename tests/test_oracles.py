"""Every query with DuckDB SQL gives the same rows on the small tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _value(x):
    if x is None or pd.isna(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def _rows(df, columns):
    return sorted(repr([_value(x) for x in r]) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tables, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = tables.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _rows(got, columns) == _rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Pages whose title and first heading end inside a reference, as texts of a fixed length do."""
    folder = str(tmp_path_factory.mktemp("cut_pages"))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.withColumn("html", F.regexp_replace("html", "</(title|h1)>", "&amp;&amp</$1>")).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["page_content_aggressive", "page_content_all_text", "page_content_manual", "page_headings", "page_title_lang", "resource_all_pages", "ingest_source_stats"])
def test_cut_reference(spark, cut_pages, name):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{cut_pages}/pages.parquet/*.parquet'")
    got, want = QUERIES[name](spark, cut_pages).toPandas(), c.sql(ORACLES[name]).df()
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))


@pytest.fixture(scope="module")
def shared_urls(spark, tmp_path_factory):
    """Pages of which several have one URL: two that failed and come back, two that stay away, one of each, and failed ones beside one that never failed."""
    folder = str(tmp_path_factory.mktemp("shared_urls"))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in pages.where("page_id < 40").select("page_id", "url").collect()}
    given = {10: 4, 13: 7, 19: 16, 24: 25, 27: 31, 33: 28}
    pages.withColumn("url", F.coalesce(*[F.when(F.col("page_id") == k, urls[v]) for k, v in given.items()], "url")).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["retry_counts", "retry_left"])
def test_shared_urls(spark, shared_urls, name):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{shared_urls}/pages.parquet/*.parquet'")
    got, want = QUERIES[name](spark, shared_urls).toPandas(), c.sql(ORACLES[name]).df()
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))


@pytest.fixture(scope="module")
def textless(spark, tmp_path_factory):
    """Documents some of which have no text: null, empty, blank, of the indexed source and of others, blanked by the query and not."""
    folder = str(tmp_path_factory.mktemp("textless"))
    none = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.lit(" \n"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.withColumn("text", F.when(F.col("doc_id") % 4 == 1, none).otherwise(F.col("text"))).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["index_page_stats", "index_replaced"])
def test_textless(spark, textless, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{textless}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, textless).toPandas(), c.sql(ORACLES[name]).df()
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))


@pytest.fixture(scope="module")
def cut_numbers(spark, tmp_path_factory):
    """Pages whose title and first heading end inside a numeric reference."""
    folder = str(tmp_path_factory.mktemp("cut_numbers"))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    cuts = F.element_at(F.array(*map(F.lit, ("&#x27", "&#x2", "&#39", "&#x27;&#x", "&#3"))), (F.col("page_id") % 5 + 1).cast("int"))
    pages.withColumn("html", F.regexp_replace("html", F.lit("</(title|h1)>"), F.concat(cuts, F.lit("</$1>")))).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["page_content_all_text", "page_title_lang", "page_headings", "page_content_manual", "resource_all_pages", "ingest_source_stats"])
def test_cut_number(spark, cut_numbers, name):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{cut_numbers}/pages.parquet/*.parquet'")
    got, want = QUERIES[name](spark, cut_numbers).toPandas(), c.sql(ORACLES[name]).df()
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    """Pages without html (null or empty), title, first heading or language."""
    folder = str(tmp_path_factory.mktemp("odd_pages"))
    odd = ["regexp_replace(html, '<title>[^<]*<', '<title><')", "regexp_replace(html, '<title>[^<]*<', '<title>  <')", "regexp_replace(html, '<h1>[^<]*<', '<h1><')", "regexp_replace(html, '<html lang=\"..\">', '<html>')", "NULL", "''"]
    cases = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(odd))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    shared = pages.where("page_id = 4").first()["url"]  # the first page of this URL has null html
    pages.withColumn("url", F.when(F.col("page_id") == 13, shared).otherwise(F.col("url"))).withColumn("html", F.expr(f"CASE page_id % 7 {cases} ELSE html END")).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["retry_counts", "retry_left", "page_title_lang", "page_headings", "page_content_all_text", "resource_all_pages"])
def test_odd_pages(spark, odd_pages, name):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{odd_pages}/pages.parquet/*.parquet'")
    got, want = QUERIES[name](spark, odd_pages).toPandas(), c.sql(ORACLES[name]).df()
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))


@pytest.fixture(scope="module")
def odd_articles(spark, tmp_path_factory):
    """Pages without an article, with one that does not end, one that a stray end tag breaks or several, cut inside theirs, or null."""
    folder = str(tmp_path_factory.mktemp("odd_articles"))
    teaser = "<article><p>A teaser.</p></article><p>Between them.</p><article>"
    odd = ["replace(html, 'article>', 'div>')", "replace(html, '</article>', '')", "left(html, length(html) DIV 2)", f"replace(html, '<article>', '{teaser}')", "replace(html, '</h1>', '</h1></body>')", "NULL"]
    cases = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(odd))
    spark.read.parquet(f"{SF}/pages.parquet").withColumn("html", F.expr(f"CASE page_id % 7 {cases} ELSE html END")).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["page_content_manual"])
def test_odd_articles(spark, odd_articles, name):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{odd_articles}/pages.parquet/*.parquet'")
    got, want = QUERIES[name](spark, odd_articles).toPandas(), c.sql(ORACLES[name]).df()
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))
