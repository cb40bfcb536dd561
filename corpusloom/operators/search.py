"""Vector, full-text and hybrid search as single declarative plans.

An ad-hoc query needs no shuffle of the corpus: every row computes its score
beside a few corpus-wide numbers, and the top k is a TakeOrderedAndProject.
Repeated queries can use the postings tables instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75  # BM25
RRF_K = 60
DEFAULT_LIMIT, MAX_LIMIT = 10, 50


def clamp_limit(limit: int) -> int:
    return min(max(1, limit), MAX_LIMIT)


# ---------------------------------------------------------------------- vector
def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(_dot(a, b) / norm)


def is_zero_vector(v: Column) -> Column:
    """The first ten dimensions are all 0: the mark of a failed embedding."""
    return F.forall(F.slice(v, 1, 10), lambda x: x == 0)


def vector_scores(vectors: DataFrame, query: list[float] | Column, embedding: str = "embedding") -> DataFrame:
    """vectors with score = (1 + cosine) / 2.

    With a literal query its norm is a constant, so each row costs two passes
    over its own dimensions.
    """
    if isinstance(query, Column):
        return vectors.withColumn("score", (1 + cosine(F.col(embedding), query)) / 2)
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(float(x) ** 2 for x in query) ** 0.5
    norm = F.sqrt(_dot(F.col(embedding), F.col(embedding))) * F.lit(size)
    return vectors.withColumn("score", (1 + F.when(norm == 0, F.lit(0.0)).otherwise(_dot(F.col(embedding), q) / norm)) / 2)


def vector_search(
    vectors: DataFrame,
    query: list[float] | Column,
    key: str,
    limit: int = DEFAULT_LIMIT,
    min_score: float | None = None,
    sources: list[str] | None = None,
    prefilter: bool = True,
) -> DataFrame:
    """The `limit` nearest rows, score descending, then key.

    prefilter=False takes the nearest 2 * limit of all sources first and
    filters them afterwards, which may leave fewer than limit.
    """
    if sources and prefilter:
        vectors = vectors.where(F.col("source").isin(sources))
    scored = vector_scores(vectors, query)
    order = [F.desc("score"), F.col(key)]
    if sources and not prefilter:
        scored = scored.orderBy(*order).limit(2 * limit).where(F.col("source").isin(sources))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(*order).limit(limit)


# ------------------------------------------------------------------- full text
def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, length: one row for each distinct term of a text."""
    each = docs.select(key, T.tokens(F.col(text)).alias("_t")).withColumn("length", F.size("_t").cast("long"))
    return each.select(key, "length", F.explode("_t").alias("term")).groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame) -> DataFrame:
    """term, df."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of texts, mean length in terms."""
    return docs.select(F.size(T.tokens(F.col(text))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_length"))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _bm25(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order; no operators are read."""
    term = ""
    out: list[str] = []
    for c in query.lower() + " ":
        if c.isalnum():
            term += c
        elif term:
            out.append(term)
            term = ""
    return list(dict.fromkeys(out))


def _count_of(tokens: Column, term: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, term))


def fulltext_scores(docs: DataFrame, query: str, text: str) -> DataFrame:
    """docs that have a query term, with their BM25 score.

    One pass counts (one row results, which is broadcast), one scores.
    """
    terms = query_terms(query)
    if not terms:
        return docs.where("false").withColumn("score", F.lit(0.0))
    tokens = T.tokens(F.col(text))
    counts = F.array(*[_count_of(F.col("_t"), q) for q in terms])
    counted = docs.withColumn("_t", tokens).withColumn("_length", F.size("_t")).withColumn("_tf", counts).drop("_t")
    totals = counted.agg(F.count("*").alias("_n"), F.avg("_length").alias("_avg"), *[F.sum((F.col("_tf")[k] > 0).cast("long")).alias(f"_df{k}") for k in range(len(terms))])
    joined = counted.where(F.exists("_tf", lambda x: x > 0)).crossJoin(F.broadcast(totals))  # totals is one row
    score = sum((_idf(F.col("_n"), F.col(f"_df{k}")) * _bm25(F.col("_tf")[k], F.col("_length"), F.col("_avg")) for k in range(len(terms))), F.lit(0.0))
    return joined.withColumn("score", score).select(*docs.columns, "score")


def fulltext_search(docs: DataFrame, query: str, key: str, text: str, limit: int = DEFAULT_LIMIT, sources: list[str] | None = None) -> DataFrame:
    """The best `limit` texts; the source filter comes before the limit and after the statistics."""
    scored = fulltext_scores(docs, query, text)
    if sources:
        scored = scored.where(F.col("source").isin(sources))
    return scored.orderBy(F.desc("score"), F.col(key)).limit(limit)


def postings_search(posted: DataFrame, stats: DataFrame, terms_df: DataFrame, query: str, key: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The same over prepared tables: only the postings of the query's terms are read."""
    hit = posted.where(F.col("term").isin(query_terms(query))).join(terms_df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    part = _idf(F.col("n_docs"), F.col("df")) * _bm25(F.col("tf"), F.col("length"), F.col("avg_length"))
    return hit.groupBy(key).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), F.col(key)).limit(limit)


# ---------------------------------------------------------------------- hybrid
def ranked(hits: DataFrame, key: str) -> DataFrame:
    """key, rank (from 1) of a result list; lists are bounded by their limit."""
    return hits.select(key, F.row_number().over(Window.orderBy(F.desc("score"), F.col(key))).alias("rank"))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, key: str, limit: int = DEFAULT_LIMIT, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; ties keep the order vector list, then text list."""
    parts = ranked(vector_hits, key).withColumn("_list", F.lit(0)).unionByName(ranked(text_hits, key).withColumn("_list", F.lit(1)))
    fused = parts.groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))
    return fused.orderBy(F.desc("score"), "_first").limit(limit).select(key, "score")


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float] | Column, key: str, text: str, limit: int = DEFAULT_LIMIT, sources: list[str] | None = None) -> DataFrame:
    """Both searches at twice the limit, fused."""
    near = vector_search(vectors, vector, key, 2 * limit, sources=sources)
    found = fulltext_search(docs, query, key, text, 2 * limit, sources)
    return fuse(near, found, key, limit)


def search(mode: str, docs: DataFrame, vectors: DataFrame, query: str, vector: list[float] | Column, key: str, text: str, limit: int = DEFAULT_LIMIT, sources: list[str] | None = None, min_score: float | None = None) -> DataFrame:
    """key, score by mode vector, fulltext or hybrid; any other mode is hybrid."""
    limit = clamp_limit(limit)
    if mode == "vector":
        return vector_search(vectors, vector, key, limit, min_score, sources).select(key, "score")
    if mode == "fulltext":
        return fulltext_search(docs, query, key, text, limit, sources).select(key, "score")
    return hybrid_search(docs, vectors, query, vector, key, text, limit, sources)


def format_results(hits: DataFrame, text: str, most: int = 500) -> DataFrame:
    """Content cut to `most` characters and scores rounded to three places, for display."""
    return hits.withColumn(text, T.truncate_text(F.col(text), most)).withColumn("display_score", F.round("score", 3))
