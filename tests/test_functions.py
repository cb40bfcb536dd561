"""Micro-fixtures whose values were derived by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.functions.ids import generate_id
from corpusloom.operators import chunk as C
from corpusloom.operators import graph as G
from corpusloom.operators import html as H
from corpusloom.operators import search as S
from corpusloom.operators import store as K
from corpusloom.operators.embed import embed
from corpusloom.sources import tables as B


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("prefix", "parts", "want"),
    [
        ("source", ["https://docs.example.com"], "source_81b17db38a3f"),
        ("chunk", ["page_abc", "0"], "chunk_51c3ed3e98ef"),
        ("concept", ["src0", "react hook"], "concept_aa39f7896a05"),
        ("x", ["a", "b"], "x_0eab8a0a3380"),
        ("x", [""], "x_e3b0c44298fc"),
    ],
)
def test_generate_id(spark, prefix, parts, want):
    assert one(spark, generate_id(prefix, *map(F.lit, parts))) == want


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [
        ("https://a.com/x/#top", None, "https://a.com/x"),
        ("https://a.com/", None, "https://a.com/"),
        ("https://a.com", None, "https://a.com"),
        ("/guide/", "https://a.com/docs/x", "https://a.com/guide"),
        ("../y?q=1#z", "https://a.com/docs/x/", "https://a.com/docs/y?q=1"),
        ("//cdn.com/p", "https://a.com/", "https://cdn.com/p"),
        ("a.com/x", None, "https://a.com/x"),
        ("y", "https://a.com/docs/x", "https://a.com/docs/y"),
        ("?q=2", "https://a.com/docs/x", "https://a.com/docs/x?q=2"),
        ("../../../z", "https://a.com/d/e/f", "https://a.com/z"),
        ("https://a.com/x;p=1", None, "https://a.com/x"),
    ],
)
def test_normalize_url(spark, url, base, want):
    assert one(spark, U.normalize_url(F.lit(url), F.lit(base) if base else None)) == want


def test_normalize_url_agrees_with_urllib(spark):
    from urllib.parse import urljoin

    base = "https://a.com/docs/x/y"
    refs = ["a", "./a", "../a", "../../a", "../../../a", "/a/../b", "/a/./b/", "a/b/../c", "?q=1", "a?b=c", "b/", "..", "."]
    df = spark.createDataFrame([(r,) for r in refs], "r string").select("r", U.normalize_url("r" and F.col("r"), F.lit(base)).alias("u"))
    for r in df.collect():
        want = urljoin(base, r["r"])
        head, _, q = want.partition("?")
        want = (head.rstrip("/") if head != "https://a.com/" else head) + (f"?{q}" if q else "")
        assert r["u"] == want, r["r"]


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://a.com/docs/intro", True), ("https://a.com/api/v1", False), ("https://a.com/api", True), ("https://a.com/f.PDF", False), ("ftp://a.com/", False), ("https://a.com/next.js/intro", True)],
)
def test_is_valid_doc_url(spark, url, want):
    assert one(spark, U.is_valid_doc_url(F.lit(url))) is want


def test_prefilter(spark):
    root = F.lit("https://docs.example.com")
    assert not one(spark, U.prefilter(F.lit("https://a.com/next.js/intro"), F.lit("https://a.com")))
    assert one(spark, U.prefilter(F.lit("https://example.com/x"), root))
    assert not one(spark, U.prefilter(F.lit("https://notexample.com/x"), root))
    assert one(spark, U.prefilter(F.lit("https://notexample.com/x"), root, label_boundary=False))
    assert one(spark, U.prefilter(F.lit("http://localhost/x"), F.lit("http://localhost")))


@pytest.mark.parametrize(
    ("url", "anchor", "nav", "follow", "priority"),
    [("https://a.com/docs/x", "X", False, True, 0.7), ("https://a.com/docs/x", "X", True, True, 0.4), ("https://a.com/about", "About", False, True, 0.4), ("https://a.com/about", "About", True, False, 0.4)],
)
def test_link_score(spark, url, anchor, nav, follow, priority):
    r = one(spark, U.link_score(F.lit(url), F.lit(anchor), F.lit(nav)))
    assert (r["should_follow"], r["priority"]) == (follow, priority)


def test_url_shape(spark):
    assert one(spark, U.url_shape(F.lit("https://a.com/v/12/deadbeef99/x"))) == "/v/#/#/x"
    assert one(spark, U.url_shape(F.lit("https://a.com/a/1b"))) == "/a/#b"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a ```x``` b", "code_example"), ("Returns a value", "api_reference"), ("Edit the yaml", "configuration"), ("First, do it", "tutorial"),
        ("Fix this bug", "troubleshooting"), ("# Hello", "overview"), ("Plain words", "conceptual"), ("Options and errors", "configuration"),
    ],
)
def test_classify(spark, text, want):
    assert one(spark, T.classify_chunk(F.lit(text))) == want


def test_truncate(spark):
    assert one(spark, T.truncate_text(F.lit("a" * 500))) == "a" * 500
    assert one(spark, T.truncate_text(F.lit("a" * 501))) == "a" * 497 + "..."


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"a": 1}', '{"a": 1}'), ('Sure: {"a": [1, 2,], }', '{"a": [1, 2]}'), ('x\n```json\n{"a": 1}\n```', '{"a": 1}'), ("none", None)],
)
def test_repair_json(spark, raw, want):
    got = one(spark, T.repair_json(F.lit(raw)))
    assert (got.replace(" ", "") if got else got) == (want.replace(" ", "") if want else want)


def test_sentence_pack():
    assert C.sentence_pack("aaaa. bbbb. cccc.", 10) == ["aaaa. bbbb.", "cccc."]


def test_split_points():
    text = list("x" * 130)
    for p in (10, 60, 100, 111):
        text[p - 2 : p] = [".", "\n"]
    assert C.split_points("".join(text)) == [60, 111]


def test_overlap(spark):
    assert one(spark, T.overlapped(F.lit("next"), F.lit("hello big world"), 2)) == "...world\n\nnext"
    assert one(spark, T.overlapped(F.lit("first"), F.lit(None).cast("string"), 2)) == "first"


def test_chunk_keeps_fences_and_headings():
    text = "# Title\n\n" + "word " * 30 + "\n\n```\ncode. \n\n more\n```\n\n## Next\n\n" + "tail " * 30
    chunks = C.chunk_text(text, C.ChunkSizes(target=40, most=60))
    assert any("```\ncode. \n\n more\n```" in c for c in chunks)
    assert len(chunks) > 1


def test_chunk_empty_and_hard_limit():
    assert C.chunk_text("  \n ") == []
    assert C.chunk_text(None) == []
    long = "x" * 20_000
    assert all(len(c) <= 8000 for c in C.chunk_text(long))


def test_chunk_cut_loses_nothing():
    long = ".".join(f"w{k}x" * (k % 40 + 1) for k in range(600))
    chunks = C.chunk_text(long)
    assert len(chunks) > 2 and "".join(chunks) == long
    assert all(len(c) <= 8000 for c in chunks)


def test_rrf(spark):
    vector = spark.createDataFrame([("A", 0.9), ("B", 0.8), ("C", 0.7)], "id string, score double")
    text = spark.createDataFrame([("B", 9.0), ("D", 8.0)], "id string, score double")
    got = [(r["id"], round(r["score"], 6)) for r in S.fuse(vector, text, "id").collect()]
    assert got == [("B", round(1 / 62 + 1 / 61, 6)), ("A", round(1 / 61, 6)), ("D", round(1 / 62, 6)), ("C", round(1 / 63, 6))]
    tie = S.fuse(vector.where("id = 'A'"), text.where("id = 'B'"), "id").collect()
    assert [r["id"] for r in tie] == ["A", "B"]


def test_concept_upsert(spark):
    rows = spark.createDataFrame([("k", "Hook", "short", "api", 0.6, 1, 1), ("k", "hook", "longer text", "tool", 0.5, 1, 2)], "key string, name string, description string, category string, confidence double, mention_count long, seq long")
    r = K.merge(rows, ["key"], K.CONCEPT_POLICY).first()
    assert (r["name"], r["description"], r["category"], r["confidence"], r["mention_count"]) == ("Hook", "longer text", "api", 0.6, 2)


def test_co_occurrence(spark):
    rows = [("k1", c) for c in "abc"] + [("k2", c) for c in "ab"] + [("k3", c) for c in "bc"]
    links = spark.createDataFrame(rows, "chunk string, concept_id string")
    got = [(r["a"], r["b"], r["n"], r["weight"]) for r in G.co_occurrence(links, "chunk").collect()]
    assert got == [("a", "b", 2, 0.2), ("b", "c", 2, 0.2)]


def test_stats_fanout(spark):
    s = spark.createDataFrame([("s",)], "source_id string")
    pages = spark.createDataFrame([("s", 1)], "source_id string, page_id long")
    chunks = spark.createDataFrame([("s", 10), ("s", 10)], "source_id string, token_count long")
    concepts = spark.createDataFrame([("s", x) for x in "abc"], "source_id string, id string")
    assert tuple(G.source_stats(s, pages, chunks, concepts).first()) == ("s", 1, 2, 3, 20)
    assert G.source_stats(s, pages, chunks, concepts, fanout_quirk=True).first()["total_tokens"] == 60


def test_page_upsert(spark):
    cols = "url string, title string, depth int, language string"
    old = spark.createDataFrame([("u", "A", 2, "fr")], cols)
    new = spark.createDataFrame([("u", "B", 0, "en", 1)], cols + ", seq long")
    r = K.upsert(old, new, ["url"], {"title": K.REPLACE, "depth": K.KEEP, "language": K.KEEP}).first()
    assert (r["title"], r["depth"], r["language"]) == ("B", 2, "fr")


def test_rate_schedule(spark):
    rows = spark.createDataFrame([("d", k, t) for k, t in enumerate((0.0, 0.2, 0.3, 5.0))], "g string, id int, t double")
    got = [r["start"] for r in G.rate_schedule(rows, "g", F.col("t"), 1.0, "id").orderBy("id").collect()]
    assert got == [0.0, 1.0, 2.0, 5.0]


def test_metatags(spark):
    tags = [("OG:Title", "T"), ("og:title", "U"), ("viewport", "w"), ("og:x", "y"), ("keywords", " a ")]
    df = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(tags)], "page_id long, pos int, key string, value string")
    got = {(r["key"], r["value"], r["category"]) for r in H.process_metatags(df).collect()}
    assert got == {("og:title", "T", "opengraph"), ("og:x", "y", "opengraph"), ("keywords", "a", "standard")}


def test_html_extraction_chain():
    page = H.describe('<html lang="FR-x"><head><title> A  b </title><meta name="description" content=" d "></head><body><nav><a href="/n">N</a></nav><main><p>' + "word " * 30 + '</p><a href="/x" title="t">X</a></main></body></html>')
    assert (page["title"], page["description"], page["language"], page["extraction_method"]) == ("A b", "d", "fr", "manual")
    assert [(x["href"], x["is_navigation"]) for x in page["links"]] == [("/n", True), ("/x", False)]
    assert "N" not in page["content"].split()
    short = H.describe("<p>tiny</p>")
    assert (short["content"], short["extraction_method"]) == ("tiny", "all_text")
    assert H.describe("")["extraction_method"] == "none"
    assert H.describe(None)["language"] == "en"


def test_html_unclosed_elements():
    page = H.describe("<body><ul><li>one<li>two</ul><p>a<p>b<div>c</div></body>")
    assert page["all_text"] == "one two a b c"


def test_embed_falls_back_to_zeros(spark):
    def broken(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        import numpy as np

        return np.ones((len(texts), 64), dtype="float32")

    df = spark.createDataFrame([("ok",), ("ok bad",), ("badbadbadbad",)], "t string").coalesce(1)
    got = {r["t"]: r["embedding"] for r in embed(df, "t", broken).collect()}
    assert got["ok"][0] == got["ok bad"][0] == 1.0
    assert sum(map(abs, got["badbadbadbad"])) == 0


def test_state_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("a", "A", "u", "indexing", 1, 0), ("b", "B", "v", "done", 2, 1)], "id string, name string, url string, status string, pages_crawled long, pages_failed long")
    f = spark.createDataFrame([("a", "u1", "e", "t")], "source_id string, url string, error string, timestamp string")
    B.write_state(s, f, str(tmp_path / "state"))
    sources, failed = B.read_state(spark, str(tmp_path / "state"))
    assert [r["id"] for r in B.incomplete(sources).collect()] == ["a"]
    assert [tuple(r) for r in failed.collect()] == [("a", "u1", "e", "t")]


def test_views_and_settings(spark):
    assert B.create_views(spark) == len(B.SCHEMAS)
    assert B.verify_views(spark).count() == len(B.SCHEMAS)
    assert B.health(spark)
    with pytest.raises(ValueError):
        B.Settings(max_depth=9)


def test_presets(spark):
    assert tuple(B.estimate_minutes(B.presets(spark)).first()) == (1510, 50, 100)
    assert tuple(B.estimate_minutes(B.preset(spark, "none")).first()) == (0, 1, 2)


def test_bfs_with_a_cycle(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    got = {r["id"]: r["depth"] for r in G.crawl(edges, spark.createDataFrame([(0,)], "id long"), 5).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_partition_count_does_not_matter(spark):
    df = spark.createDataFrame([(k, "for avec " * (k % 5 + 1) + f"w{k}", f"s{k % 3}") for k in range(40)], "doc_id long, text string, source string")
    runs = [[(r["doc_id"], round(r["score"], 9)) for r in S.fulltext_search(df.repartition(n), "for w7", "doc_id", "text").collect()] for n in (1, 7)]
    assert runs[0] == runs[1]


# ---------------------------------------------------------------- best-first crawl
def brute_best_first(edges, root, depth, most):
    import heapq

    queue, seen = [(-1.0, 0, root)], {}
    while queue and len(seen) < most:
        p, d, x = heapq.heappop(queue)
        if x in seen:
            continue
        seen[x] = (d, -p)
        if d < depth:
            for a, b, w in edges:
                if a == x and b not in seen:
                    heapq.heappush(queue, (-w, d + 1, b))
    return seen


def test_best_first_crawl(spark):
    import random

    rng = random.Random(3)
    for most in (7, 100):
        # Priorities are of the page, as a heuristic gives them; ties are taken by depth, then id.
        edges = [(a, b, [0.9, 0.7, 0.4][b % 3]) for a in range(30) for b in rng.sample(range(30), 3)]
        df = spark.createDataFrame(edges, "src long, dst long, priority double")
        got = {r["id"]: (r["depth"], r["priority"]) for r in G.crawl_best_first(df, spark.createDataFrame([(0,)], "id long"), 3, most).collect()}
        # A turn takes a whole priority before it looks at what these pages link to at the same priority.
        want = brute_best_first(edges, 0, 3, 100)
        assert len(got) == min(most, len(got)) and set(got) <= set(want) and got[0] == (0, 1.0)
        if most == 100:
            assert {x: p for x, (_, p) in got.items()} == {x: p for x, (_, p) in want.items()}
    line = spark.createDataFrame([(0, 1, 0.4), (0, 2, 0.9), (2, 3, 0.7), (3, 4, 0.7), (1, 5, 0.9)], "src long, dst long, priority double")
    first = G.crawl_best_first(line, spark.createDataFrame([(0,)], "id long"), 4, 5).orderBy("visit", "id").collect()
    assert [r["id"] for r in first] == [0, 2, 3, 4, 1]


@pytest.mark.parametrize("span", [0.7, 3.0, None])
def test_rate_schedule_in_spans(spark, span):
    import random

    rng = random.Random(5)
    rows = [(k, k % 3, float(rng.randint(0, 40)) / 4) for k in range(300)]
    got = {r["id"]: r["start"] for r in G.rate_schedule(spark.createDataFrame(rows, "id long, g long, t double"), "g", F.col("t"), 0.5, "id", span).collect()}
    for g in range(3):
        last = None
        for k, _, t in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            last = t if last is None else max(t, last + 0.5)
            assert abs(got[k] - last) < 1e-9


# ------------------------------------------------------------------------- fetch
def test_fetch_pages(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from corpusloom.sources import http as W

    asked = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            code = {"/lost": 404, "/moved": 302, "/flaky": 500 if asked.count("/flaky") < 2 else 200}.get(self.path, 200)
            self.send_response(code)
            if code == 302:
                self.send_header("Location", "/page")
            self.send_header("Content-Type", "application/pdf" if self.path == "/file" else "text/html; charset=iso-8859-1")
            self.end_headers()
            self.wfile.write("<p>é</p>".encode("latin-1"))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(f"{base}{p}",) for p in ("/page", "/lost", "/moved", "/file", "/flaky")] + [("http://127.0.0.1:1/",)], "url string")
        got = {r["url"].rsplit("/", 1)[-1]: r for r in W.fetch_pages(urls, wait=(0.01, 0.02), delay=0.0, timeout=5).collect()}
    finally:
        server.shutdown()
    assert got["page"]["html"] == got["moved"]["html"] == got["flaky"]["html"] == "<p>é</p>"
    assert (got["lost"]["html"], got["lost"]["status"], got["lost"]["error"]) == (None, 404, "HTTP 404")
    assert got["file"]["html"] is None and "application/pdf" in got["file"]["error"] and asked.count("/file") == 1
    assert got[""]["status"] is None and got[""]["error"] and asked.count("/flaky") == 2


def test_link_context_is_linear():
    import time

    took = []
    for n in (2000, 8000):
        page = "<body><main>" + "".join(f'<a href="/p{k}">link {k}</a> ' for k in range(n)) + "</main></body>"
        began = time.time()
        assert len(H.describe(page, ("links",))["links"]) == n
        took.append(time.time() - began)
    assert took[1] < 20 * took[0] + 0.5


def test_named_references_end_in_a_semicolon():
    page = H.describe('<title>&lt;&amp</title><p>&copy2 &nope; &ampx; &#38 &hellip;﷐ &</p><a href="/q?a=1&copy=2&amp;b=3">x</a>')
    assert (page["title"], page["all_text"]) == ("<&amp", "<&amp &copy2 &nope; &ampx; & …﷐ & x")
    assert page["links"][0]["href"] == "/q?a=1&copy=2&b=3"


def test_numeric_references_that_are_cut():
    page = H.describe("<title>it&#x27;s&#x2</title><h1>a&#x27</h1><p>&#39;b&#38 c&#3<b>&#x</b>&#</p>d&#X27")
    assert (page["title"], page["headings"][0]["text"]) == ("it's&#x2", "a&#x27")
    assert page["all_text"] == "it's&#x2 a&#x27 'b& c&#3 &#x &# d&#X27"


def test_manual_text_of_stated_articles():
    text = lambda html, stated=True: H.describe(html, ("manual_text",), stated)["manual_text"]
    assert text("<body><p>a<article><p>b<nav>n</nav><b>c</article>d<article>e</article>f") == "b c d e"
    assert [text(html) for html in ("<body><div>a</div>", "<article>a", "<article>a</article><article>b", "<div><article>a</div>b</article>c", None)] == ["", "", "a", "a b", None]
    assert [text(html, False) for html in ("<body><div>a</div>", "<article>a", "<article>a</article><article>b", None)] == ["a", "a", "a", ""]
