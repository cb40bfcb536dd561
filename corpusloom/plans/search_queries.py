"""Search, id, URL and text queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.ids import content_hash, generate_id
from ..operators import search as S
from ..operators.embed import embed
from ..operators.store import changed

QUERY = "for avec und para"
SOURCES = ["src1", "src2", "src3"]
ROOT = "https://docs.example.com"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text", "source")


def _vectors(spark, d):
    own = read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id").select("doc_id", "embedding")
    return own.join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")


def _query_vector(spark, d) -> list[float]:
    return read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def hybrid_search_rrf(spark, d):
    docs = _docs(spark, d)
    hits = S.hybrid_search(docs, _vectors(spark, d), QUERY, _query_vector(spark, d), "doc_id", "text")
    return _rounded(hits.join(docs, "doc_id").select("doc_id", "score", "source", T.truncate_text(F.col("text"), 100).alias("preview")), "score")


def vector_search_topk(spark, d):
    return _rounded(S.vector_search(_vectors(spark, d), _query_vector(spark, d), "doc_id", 10).select("doc_id", "source", "score"), "score")


def vector_search_threshold(spark, d):
    return _rounded(S.vector_search(_vectors(spark, d), _query_vector(spark, d), "doc_id", 50, min_score=0.6).select("doc_id", "score"), "score")


def vector_search_source_prefilter(spark, d):
    return _rounded(S.vector_search(_vectors(spark, d), _query_vector(spark, d), "doc_id", 10, sources=SOURCES).select("doc_id", "source", "score"), "score")


def vector_search_source_postfilter(spark, d):
    return _rounded(S.vector_search(_vectors(spark, d), _query_vector(spark, d), "doc_id", 10, sources=SOURCES, prefilter=False).select("doc_id", "source", "score"), "score")


def fulltext_search_bm25(spark, d):
    return _rounded(S.fulltext_search(_docs(spark, d), QUERY, "doc_id", "text").select("doc_id", "source", "score"), "score")


def fulltext_search_source_filter(spark, d):
    return _rounded(S.fulltext_search(_docs(spark, d), QUERY, "doc_id", "text", sources=SOURCES).select("doc_id", "source", "score"), "score")


def fulltext_search_postings(spark, d):
    docs = _docs(spark, d)
    posted = S.postings(docs, "doc_id", "text")
    return _rounded(S.postings_search(posted, S.corpus_stats(docs, "text"), S.term_stats(posted), QUERY, "doc_id"), "score")


def postings_build(spark, d):
    return S.postings(_docs(spark, d), "doc_id", "text").select("doc_id", "term", "tf", "length")


def term_statistics(spark, d):
    return S.term_stats(S.postings(_docs(spark, d), "doc_id", "text"))


def corpus_stats(spark, d):
    return _rounded(S.corpus_stats(_docs(spark, d), "text"), "avg_length")


def search_result_format(spark, d):
    docs = _docs(spark, d)
    hits = S.fulltext_search(docs, QUERY, "doc_id", "text").select("doc_id", "text", "score")
    return S.format_results(hits, "text").select("doc_id", F.col("text").alias("content"), F.col("display_score").alias("score"))


def search_modes(spark, d):
    docs, vectors, q = _docs(spark, d), _vectors(spark, d), _query_vector(spark, d)
    out = None
    for mode in ("vector", "fulltext", "hybrid"):
        one = S.search(mode, docs, vectors, QUERY, q, "doc_id", "text", limit=5).select(F.lit(mode).alias("mode"), "doc_id", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def embed_documents(spark, d):
    done = embed(read(spark, d, "documents").select("doc_id", "text"), "text")
    return done.select("doc_id", F.size("embedding").cast("long").alias("dimensions"))


def zero_embedding_filter(spark, d):
    e = read(spark, d, "embeddings")
    marked = e.withColumn("embedding", F.when(F.col("label") == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))
    return marked.where(S.is_zero_vector(F.col("embedding"))).select("vec_id")


# ------------------------------------------------------------------ ids, urls, text
def gen_id(spark, d):
    return read(spark, d, "documents").select("doc_id", generate_id("chunk", F.col("source"), F.col("doc_id")).alias("id"))


def content_hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


def change_detection(spark, d):
    """The state before: no French documents yet, and those of one source as they were."""
    now = read(spark, d, "documents").select("doc_id", "lang", "source", content_hash(F.col("text")).alias("digest"))
    old = now.where("lang <> 'fr'").withColumn("digest", F.when(F.col("source") == "src3", "old").otherwise(F.col("digest")))
    return changed(old, now, "doc_id", "digest").select("doc_id")


def normalize_url(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", U.normalize_url(F.col("url")).alias("url"), U.normalize_url(F.concat(F.lit("/guide/p"), F.col("page_id"), F.lit("/?a=1#x")), F.col("url")).alias("resolved"))


def resolve_relative_url(spark, d):
    p = read(spark, d, "pages")
    base = F.concat(F.lit("https://a.com/docs/x"), F.col("page_id"), F.lit("/"))
    return p.select("page_id", U.normalize_url(F.lit("../y?q=1#z"), base).alias("up"), U.normalize_url(F.lit("./z/../w"), base).alias("down"), U.normalize_url(F.lit("?q=2"), base).alias("query"))


def extract_domain(spark, d):
    return read(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


def is_valid_doc_url(spark, d):
    paths = F.array(*[F.lit(x) for x in ("/docs/intro", "/api/v1", "/api", "/f.PDF", "/login", "/next.js/intro", "/a.min.js")])
    p = read(spark, d, "pages").withColumn("candidate", F.concat(U.scheme(F.col("url")), F.lit("://"), U.domain(F.col("url")), F.element_at(paths, (F.col("page_id") % 7 + 1).cast("int"))))
    return p.select("page_id", "candidate", U.is_valid_doc_url(F.col("candidate")).alias("valid"))


def title_from_url(spark, d):
    return read(spark, d, "pages").select("page_id", U.title_from_url(F.col("url")).alias("title"))


def url_shape_pattern(spark, d):
    return read(spark, d, "pages").groupBy(U.url_shape(F.col("url")).alias("shape")).agg(F.count("*").alias("n"))


def same_domain_pairs(spark, d):
    hosts = read(spark, d, "pages").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    return hosts.select("domain", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs")).where("pairs > 0")


def origin_allow_list(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", U.origin_allowed(F.col("url"), ["*.example.com", "http://localhost"]).alias("allowed"))


def include_exclude_patterns(spark, d):
    p = read(spark, d, "pages")
    return p.where(U.include_exclude(F.col("url"), ["/fr/", "/de/"], [r"\?"])).select("page_id", "url")


def clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("digest"), F.length(T.clean_text(F.col("text"))).cast("long").alias("n"))


def truncate_preview(spark, d):
    return read(spark, d, "documents").select("doc_id", T.truncate_text(F.col("text"), 500).alias("preview"))


def word_token_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.token_count(F.col("text")).alias("tokens"))


def embed_truncation(spark, d):
    return read(spark, d, "documents").select("doc_id", F.length(T.truncate_tokens(F.col("text"), 500)).cast("long").alias("n"))


def chunk_classify(spark, d):
    return read(spark, d, "documents").select("doc_id", T.classify_chunk(F.col("text")).alias("semantic_type"))


def navigation_text(spark, d):
    return read(spark, d, "documents").where(T.looks_like_navigation(F.col("text"))).select("doc_id")


def chunk_type_histogram(spark, d):
    return chunk_classify(spark, d).groupBy("semantic_type").agg(F.count("*").alias("n"))


def prompt_texts(spark, d):
    p = read(spark, d, "documents")
    return p.select("doc_id", F.md5(T.ontology_prompt(F.col("source"), F.col("text"))).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search_rrf, vector_search_topk, vector_search_threshold, vector_search_source_prefilter, vector_search_source_postfilter, fulltext_search_bm25,
        fulltext_search_source_filter, fulltext_search_postings, postings_build, term_statistics, corpus_stats, search_result_format, search_modes, embed_documents,
        zero_embedding_filter, gen_id, content_hashes, change_detection, normalize_url, resolve_relative_url, extract_domain, is_valid_doc_url, title_from_url,
        url_shape_pattern, same_domain_pairs, origin_allow_list, include_exclude_patterns, clean_text, truncate_preview, word_token_counts, embed_truncation,
        chunk_classify, navigation_text, chunk_type_histogram, prompt_texts,
    )
}

# --------------------------------------------------------------------- DuckDB
_IN = "('src1', 'src2', 'src3')"
_TERMS = "('for'), ('avec'), ('und'), ('para')"
_VECTOR = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
vec AS (SELECT doc_id, source, (1 + list_inner_product(embedding::DOUBLE[], v) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(v, v)))) / 2 AS score
        FROM embeddings JOIN documents ON vec_id = doc_id, q)"""
_TEXT = rf"""
tok AS (SELECT doc_id, source, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT doc_id, any_value(source) AS source, term, len(any_value(t)) AS dl, len(list_filter(any_value(t), lambda x: x = term)) AS tf FROM tok, (VALUES {_TERMS}) q(term) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
bm AS (SELECT doc_id, any_value(source) AS source, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
       FROM tf JOIN df USING (term), corpus WHERE tf > 0 GROUP BY doc_id)"""
_RRF = """
va AS (SELECT doc_id, 0 AS l, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM vec ORDER BY score DESC, doc_id LIMIT {two})),
ta AS (SELECT doc_id, 1 AS l, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT {two})),
rrf AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS score, min(l * 1000 + r) AS f FROM (SELECT * FROM va UNION ALL SELECT * FROM ta) GROUP BY doc_id ORDER BY score DESC, f LIMIT {one})"""
_WHITE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CLEAN = rf"trim(regexp_replace(text, '{_WHITE}', ' ', 'g'), ' ')"
_PATH = r"regexp_replace(regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
_HOST = r"regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1)"
_NORM = (
    r"regexp_extract({0}, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN " + _PATH + r" = '/' THEN '/' ELSE regexp_replace(" + _PATH + r", '/+$', '') END"
    r" || CASE WHEN regexp_extract({0}, '\?([^#]*)', 1) <> '' THEN '?' || regexp_extract({0}, '\?([^#]*)', 1) ELSE '' END"
)


def _kinds() -> str:
    cases = ["WHEN contains(text, '```') OR (length(text) - length(replace(text, '    ', ''))) / 4 > 5 THEN 'code_example'"]
    for kind, words in T.KINDS:
        cases.append("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{kind}'")
    return "CASE " + " ".join(cases) + " WHEN starts_with(text, '#') OR contains(lower(text), 'introduction') OR contains(lower(text), 'overview') THEN 'overview' ELSE 'conceptual' END"


ORACLES = {
    "hybrid_search_rrf": f"WITH {_VECTOR}, {_TEXT}, {_RRF.format(two=20, one=10)} SELECT doc_id, round(score, 6) AS score, source, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 97) || '...' END AS preview FROM rrf JOIN documents USING (doc_id)",
    "vector_search_topk": f"WITH {_VECTOR} SELECT doc_id, source, round(score, 6) AS score FROM vec ORDER BY vec.score DESC, doc_id LIMIT 10",
    "vector_search_threshold": f"WITH {_VECTOR} SELECT doc_id, round(score, 6) AS score FROM vec WHERE score >= 0.6::DOUBLE ORDER BY vec.score DESC, doc_id LIMIT 50",
    "vector_search_source_prefilter": f"WITH {_VECTOR} SELECT doc_id, source, round(score, 6) AS score FROM vec WHERE source IN {_IN} ORDER BY vec.score DESC, doc_id LIMIT 10",
    "vector_search_source_postfilter": f"WITH {_VECTOR} SELECT doc_id, source, round(score, 6) AS score FROM (SELECT * FROM vec ORDER BY score DESC, doc_id LIMIT 20) v WHERE source IN {_IN} ORDER BY v.score DESC, doc_id LIMIT 10",
    "fulltext_search_bm25": f"WITH {_TEXT} SELECT doc_id, source, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10",
    "fulltext_search_source_filter": f"WITH {_TEXT} SELECT doc_id, source, round(score, 6) AS score FROM bm WHERE source IN {_IN} ORDER BY bm.score DESC, doc_id LIMIT 10",
    "fulltext_search_postings": f"WITH {_TEXT} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10",
    "postings_build": r"SELECT doc_id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)) GROUP BY doc_id, term",
    "term_statistics": r"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY term",
    "corpus_stats": r"SELECT count(*) AS n_docs, round(avg(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))), 6) AS avg_length FROM documents",
    "search_result_format": f"WITH {_TEXT}, top AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10) SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE left(text, 497) || '...' END AS content, round(score, 3) AS score FROM top JOIN documents USING (doc_id)",
    "search_modes": f"WITH {_VECTOR}, {_TEXT}, {_RRF.format(two=10, one=5)} SELECT 'vector' AS mode, doc_id, round(score, 6) AS score FROM (SELECT * FROM vec ORDER BY score DESC, doc_id LIMIT 5) UNION ALL SELECT 'fulltext', doc_id, round(score, 6) FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 5) UNION ALL SELECT 'hybrid', doc_id, round(score, 6) FROM rrf",
    "zero_embedding_filter": "SELECT vec_id FROM embeddings WHERE label = 0",
    "gen_id": "SELECT doc_id, 'chunk_' || substr(sha256(source || '|' || doc_id), 1, 12) AS id FROM documents",
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "change_detection": "SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3'",
    "normalize_url": f"SELECT page_id, {_NORM.format('url')} AS url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/guide/p' || page_id || '?a=1' AS resolved FROM pages",
    "resolve_relative_url": "SELECT page_id, 'https://a.com/docs/y?q=1' AS up, 'https://a.com/docs/x' || page_id || '/w' AS down, 'https://a.com/docs/x' || page_id || '?q=2' AS query FROM pages",
    "extract_domain": f"SELECT page_id, {_HOST.format('url')} AS domain FROM pages",
    "is_valid_doc_url": f"WITH c AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || ['/docs/intro', '/api/v1', '/api', '/f.PDF', '/login', '/next.js/intro', '/a.min.js'][(page_id % 7 + 1)::INT] AS candidate FROM pages) SELECT page_id, candidate, NOT regexp_matches(lower({_PATH.format('candidate')}), '{'|'.join(U.SKIP_PATHS)}') AS valid FROM c",
    "title_from_url": rf"WITH p AS (SELECT page_id, {_HOST.format('url')} AS host, regexp_replace({_PATH.format('url')}, '^/+|/+$', '', 'g') AS p FROM pages), w AS (SELECT page_id, host, p, string_split(regexp_replace(regexp_replace(list_last(string_split(p, '/')), '\.[^.]+$', ''), '[-_]', ' ', 'g'), ' ') AS w FROM p) SELECT page_id, CASE WHEN p = '' THEN host ELSE array_to_string(list_transform(w, lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') END AS title FROM w",
    "url_shape_pattern": rf"SELECT regexp_replace(regexp_replace({_PATH.format('url')}, '/\d+', '/#', 'g'), '/[a-f0-9]{{8,}}', '/#', 'g') AS shape, count(*) AS n FROM pages GROUP BY 1",
    "same_domain_pairs": f"SELECT {_HOST.format('a.url')} AS domain, count(*) AS pairs FROM pages a JOIN pages b ON {_HOST.format('a.url')} = {_HOST.format('b.url')} AND a.page_id < b.page_id GROUP BY 1",
    "origin_allow_list": f"SELECT page_id, {_HOST.format('url')} LIKE '%.example.com' OR {_HOST.format('url')} IN ('localhost', '127.0.0.1') AS allowed FROM pages",
    "include_exclude_patterns": "SELECT page_id, url FROM pages WHERE (url LIKE '%/fr/%' OR url LIKE '%/de/%') AND url NOT LIKE '%?%'",
    "clean_text": f"SELECT doc_id, md5({_CLEAN}) AS digest, length({_CLEAN})::BIGINT AS n FROM documents",
    "truncate_preview": "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE left(text, 497) || '...' END AS preview FROM documents",
    "word_token_counts": f"SELECT doc_id, CASE WHEN {_CLEAN} = '' THEN 0 ELSE len(string_split({_CLEAN}, ' ')) END::BIGINT AS words, (length(text) // 4)::BIGINT AS tokens FROM documents",
    "embed_truncation": "SELECT doc_id, CASE WHEN length(text) // 4 <= 500 THEN length(text) ELSE 2000 END::BIGINT AS n FROM documents",
    "chunk_classify": f"SELECT doc_id, {_kinds()} AS semantic_type FROM documents",
    "navigation_text": "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{p}')" for p in T.NAVIGATION_PHRASES),
    "chunk_type_histogram": f"SELECT {_kinds()} AS semantic_type, count(*) AS n FROM documents GROUP BY 1",
    "prompt_texts": "SELECT doc_id, md5('Extract concepts and relationships from this page.' || chr(10) || chr(10) || 'Title: ' || source || chr(10) || chr(10) || 'Content:' || chr(10) || left(text, 8000)) AS digest FROM documents",
}
ORACLES["embed_documents"] = "SELECT doc_id, 64::BIGINT AS dimensions FROM documents"
