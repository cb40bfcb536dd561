"""Tools and resources over a small corpus, and streams."""

from __future__ import annotations

import pytest

from corpusloom.plans import api
from corpusloom.streaming import ingest as I


@pytest.fixture(scope="module")
def corpus(spark):
    body = lambda t: f"<html lang='en'><head><title>{t}</title><meta name='keywords' content='a,b'></head><body><main><p>{t} hooks guide. {'React hooks keep state between renders. ' * 6}</p><a href='/docs/two'>next</a></main></body></html>"
    rows = [(1, "https://a.com/docs/one#top", body("One")), (2, "https://a.com/docs/two/", body("Two")), (3, "https://b.com/", "<p></p>")]
    return api.ingest(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_ingest(corpus):
    assert {r["url"] for r in corpus.pages.collect()} == {"https://a.com/docs/one", "https://a.com/docs/two", "https://b.com/"}
    assert [(r["from_url"], r["to_url"]) for r in corpus.links.where("from_url <> to_url").collect()] == [("https://a.com/docs/one", "https://a.com/docs/two")]
    assert corpus.chunks.count() == 2
    stats = {r["name"]: (r["pages"], r["chunks"]) for r in api.doc_sources(corpus).collect()}
    assert stats == {"a.com": (2, 2), "b.com": (1, 0)}


@pytest.mark.parametrize("mode", ["vector", "fulltext", "hybrid"])
def test_search(corpus, mode):
    hits = api.doc_search(corpus, "hooks two", mode).collect()
    assert hits[0]["page_title"] == "Two"
    assert [r["score"] for r in hits] == sorted((r["score"] for r in hits), reverse=True)


def test_context_and_ontology(corpus):
    source = corpus.sources.where("name = 'a.com'").first()["id"]
    chunks, concepts, relations = api.doc_context(corpus, "hooks", sources=[source])
    assert chunks.count() == 2 and "hooks" in {r["name"] for r in concepts.collect()}
    assert relations.count() > 0
    names, edges = api.doc_ontology(corpus, source, "hooks")
    assert 0 < names.count() <= 100 and edges.count() > 0
    assert api.doc_context(corpus, "hooks")[2].count() == 0


def test_resources(corpus):
    source = corpus.sources.where("name = 'a.com'").first()["id"]
    assert api.read_resource(corpus, f"doc://sources/{source}/pages?limit=1").count() == 1
    assert api.read_resource(corpus, f"doc://sources/{source}/concepts").count() == 1
    assert api.read_resource(corpus, f"doc://sources/{source}/stats").first()["pages"] == 2
    page = corpus.pages.where("title = 'One'").first()["id"]
    assert api.read_resource(corpus, f"doc://pages/{page}/content").first()["metatags"] == {"keywords": "a,b"}
    with pytest.raises(KeyError):
        api.read_resource(corpus, "doc://nothing")
    with pytest.raises(KeyError):
        api.call_tool(corpus, "nothing")


def test_refresh_and_delete(spark, corpus):
    new = spark.createDataFrame([(3, "https://b.com/", "<p>changed words</p>"), (4, "https://c.com/x", "<p>new</p>")], "page_id long, url string, html string")
    assert {r["url"] for r in api.refresh(corpus, new).collect()} == {"https://b.com/", "https://c.com/x"}
    source = corpus.sources.where("name = 'a.com'").first()["id"]
    left, counts = api.delete_source(corpus, source)
    assert counts.first().asDict()["pages"] == 2
    assert left.pages.count() == 1 and left.chunks.count() == 0


def test_streams(spark, tmp_path):
    rows = [(1, "https://a.com/x#1", "2024-01-01 00:00:00"), (2, "https://a.com/x", "2024-01-01 00:01:00"), (3, "https://a.com/y", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "id long, url string, t string").selectExpr("id", "url", "cast(t as timestamp) as ts", "'view' as event_type", "1.0D as value", "7L as user_id")
    df.write.parquet(str(tmp_path / "in"))
    seen: list[tuple] = []
    query = I.upsert_batches(I.new_urls(I.read_folder(spark, str(tmp_path / "in"), df.schema), "ts"), lambda b, k: seen.extend(r["url"] for r in b.collect()), str(tmp_path / "c"))
    query.awaitTermination()
    assert sorted(seen) == ["https://a.com/x", "https://a.com/y"]
    table = I.run_to_table(I.progress(I.read_folder(spark, str(tmp_path / "in"), df.schema)), "progress_test")
    assert [(r["user_id"], r["n"]) for r in table.collect()] == [(7, 3)]
    table = I.run_to_table(I.windowed(I.read_folder(spark, str(tmp_path / "in"), df.schema)), "windows_test")
    assert sum(r["n"] for r in table.collect()) == 3


# ------------------------------------------------------------- runs, retry, tools
def _html(t):
    return f"<html lang='en'><head><title>{t}</title></head><body><main><p>{t} hooks guide. {'React hooks keep state between renders. ' * 6}</p></main></body></html>"


def test_runs_and_retry(spark):
    fetched = [(1, "https://a.com/one", _html("One"), None), (2, "https://a.com/two", None, "HTTP 500"), (3, "https://b.com/x", None, "HTTP 404"), (4, "https://c.com/", "<p></p>", None)]
    run = api.index_sources(spark.createDataFrame(fetched, "page_id long, url string, html string, error string"), "r1")
    assert {r["pages_crawled"]: r["status"] for r in run.jobs.collect()} == {1: "completed", 0: "failed"}
    t = run.totals.first()
    assert (t["sources_completed"], t["sources_failed"], t["total_pages"], t["failed_pages"], t["total_chunks"], t["empty_pages"]) == (2, 1, 2, 2, 1, 1)
    assert run.failed.count() == 2

    def fetch(urls):
        return urls.selectExpr("url", "CASE WHEN url LIKE '%two' THEN '" + _html("Two").replace("'", "\\'") + "' END AS html", "CASE WHEN url NOT LIKE '%two' THEN 'HTTP 404' END AS error")

    corpus, left, counts = api.retry_failed(run.corpus, run.failed, fetch)
    assert sorted((r["retried"], r["success"], r["failed"]) for r in counts.collect()) == [(1, 0, 1), (1, 1, 0)]
    assert [r["url"] for r in left.collect()] == ["https://b.com/x"]
    assert {r["title"]: r["depth"] for r in corpus.pages.collect()} == {"One": 0, "Two": 0, "": 0}
    assert corpus.chunks.count() == 2 and corpus.chunks.select("id").distinct().count() == 2
    source = run.failed.where("url LIKE '%two'").first()["source_id"]
    _, left, counts = api.retry_failed(run.corpus, run.failed, fetch, source)
    assert [r["url"] for r in left.collect()] == ["https://b.com/x"] and counts.count() == 1
    again, totals = api.reindex_source(corpus, source)
    assert totals.first()["chunks_created"] == 2 and again.chunks.count() == 2
    new = spark.createDataFrame([(9, "https://a.com/one", _html("Changed"))], "page_id long, url string, html string")
    assert {r["title"] for r in api.refreshed(corpus, new).pages.collect()} == {"Changed", "Two", ""}


def test_extractor_in_ingest(spark):
    from corpusloom.operators import extract as X

    rows = [(1, "https://a.com/one", _html("One")), (2, "https://a.com/two", _html("Two")), (3, "https://a.com/three", "<p>short</p>")]
    corpus = api.ingest(spark.createDataFrame(rows, "page_id long, url string, html string"), extractor=X.term_extractor(4))
    concepts = {r["name"]: r["mention_count"] for r in corpus.concepts.collect()}
    assert concepts["hooks"] == 2 and len(concepts) <= 8
    ids = {r["id"] for r in corpus.concepts.collect()}
    edges = corpus.relations.collect()
    assert edges and all(r["from_id"] in ids and r["to_id"] in ids for r in edges)
    assert corpus.mentions.count() > 0 and api.link_stats(corpus).first()["concept_relations"] == len(edges)

    def broken(prompts):
        raise RuntimeError("rate limit")

    failed = X.extract(spark.createDataFrame([(1, "s", "t", "x" * 200), (2, "s", "t", "short")], "k long, source_id string, title string, content string"), broken)
    got = {r["k"]: r for r in failed.collect()}
    assert (got[1]["attempts"], got[2]["attempts"]) == (3, 0) and len(got[1]["errors"]) == 3 and not got[2]["errors"]


def test_doctor_and_tools(spark, corpus):
    components, sources = api.doctor(spark, corpus, provider=lambda texts: 1 / 0)
    state = {r["component"]: (r["healthy"], r["detail"]) for r in components.collect()}
    assert state["tables"][0] and state["extractor"][0] and not state["embeddings"][0] and "zero" in state["embeddings"][1]
    assert {r["name"]: r["pages"] for r in sources.collect()} == {"a.com": 2, "b.com": 1}
    tools = api.list_tools(spark)
    assert {r["tool"] for r in tools.collect()} == set(api.TOOLS)
    assert {r["argument"] for r in tools.where("tool = 'doc_search' AND required").collect()} == {"query"}
    assert api.answer_tool(corpus, "nothing").startswith("Error: no tool")
    assert api.answer_tool(corpus, "doc_search", query="hooks").count() > 0


def test_states_of_one_source(spark):
    from corpusloom.operators import runs as R

    rows = [
        R.log_row(spark, "s", 0, R.UPDATE, pages_crawled=9), R.log_row(spark, "s", 1, R.START, name="n", url="u"), R.log_row(spark, "s", 2, R.UPDATE, pages_crawled=3),
        R.log_row(spark, "s", 3, R.FAIL, error="e"), R.log_row(spark, "s", 4, R.START), R.log_row(spark, "s", 5, R.UPDATE, pages_crawled=1), R.log_row(spark, "x", 1, R.UPDATE),
    ]
    log = rows[0]
    for r in rows[1:]:
        log = log.unionByName(r)
    failed = R.fold_states(log.where("seq < 4")).collect()
    assert [(r["id"], r["status"], r["error"], r["pages_crawled"], r["ended_at"] is None) for r in failed] == [("s", "failed", "e", 3, False)]
    again = R.fold_states(log).first()
    assert (again["status"], again["error"], again["pages_crawled"], again["ended_at"]) == ("indexing", None, 1, None)
