"""Indexing by page: chunks of a page replace those it had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunk as C
from . import search as S
from .embed import Provider, embed
from .graph import cut_lineage

STATS = ("chunks_created", "chunks_failed", "total_tokens", "empty_pages", "embedding_failures")


def index_pages(pages: DataFrame, chunks: DataFrame | None = None, provider: Provider | None = None, sizes: C.ChunkSizes = C.ChunkSizes(), key: str = "id", text: str = "content", empty: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of these pages beside those of all others, and STATS of each page.

    A page without text, or one for which `empty` holds where that is given,
    keeps what it had and counts as empty; any other that gives no chunk loses
    what it had.  Chunks whose vector starts with zeros are failures of the
    provider and left out.
    """
    if empty is None:
        empty = F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")) == ""
    full = pages.where(~empty).withColumnRenamed(key, "page_id")
    pages = pages.withColumnRenamed(key, "page_id")
    heading = "title" if "title" in pages.columns else None
    made = C.chunk_documents(full, "page_id", text, sizes, heading)
    if "source_id" in pages.columns:
        made = made.join(full.select("page_id", F.col("source_id").alias("source")), "page_id")
    made = cut_lineage(embed(made, "content", provider).withColumn("_failed", S.is_zero_vector(F.col("embedding"))))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    per = made.groupBy("page_id").agg(count((~F.col("_failed")).cast("int")).alias("chunks_created"), count(F.col("_failed").cast("int")).alias("chunks_failed"), count(F.when(~F.col("_failed"), F.col("token_count"))).alias("total_tokens"))
    filled = full.select("page_id", F.lit(0).cast("long").alias("empty_pages"))
    stats = pages.select("page_id").join(per, "page_id", "left").join(filled, "page_id", "left")
    stats = stats.na.fill(1, ["empty_pages"]).na.fill(0, list(STATS[:3])).withColumn("embedding_failures", F.col("chunks_failed")).select("page_id", *STATS)
    fresh = made.where("NOT _failed").drop("_failed")
    if chunks is None:
        return fresh, stats
    others = chunks.join(full.select("page_id"), "page_id", "left_anti")
    return others.unionByName(fresh, allowMissingColumns=True), stats


def totals(stats: DataFrame) -> DataFrame:
    """One row: STATS of all pages."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in STATS])
