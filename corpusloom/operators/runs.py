"""Index runs over many sources: states folded from a log, job rows, failed pages and their retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.ids import generate_id

START, UPDATE, COMPLETE, FAIL = "start", "update", "complete", "fail"
COUNTERS = ("pages_crawled", "pages_failed", "chunks_created", "concepts_extracted")
_STATUS = {START: "indexing", COMPLETE: "completed", FAIL: "failed"}


def fold_states(log: DataFrame) -> DataFrame:
    """id, name, url, status, error, started_at, ended_at and COUNTERS of every started source.

    log: id, seq, action (START, UPDATE, COMPLETE, FAIL), at, and what the
    action sets (nulls set nothing).  A start begins anew with counters at 0;
    rows of a source before its first start are without effect.
    """
    last = log.where(F.col("action") == START).groupBy("id").agg(F.max("seq").alias("_from"))
    rows = log.join(last, "id").where("seq >= _from")
    status = F.coalesce(*[F.when(F.col("action") == a, F.lit(s)) for a, s in _STATUS.items()])
    latest = lambda c, when=None: F.max_by(c, F.when(c.isNotNull() if when is None else when, F.col("seq")))
    ended = F.col("action").isin(COMPLETE, FAIL)
    return rows.groupBy("id").agg(
        *[latest(F.col(c)).alias(c) for c in ("name", "url")],
        latest(status).alias("status"),
        latest(F.col("error"), F.col("action") == FAIL).alias("error"),
        F.min_by("at", "seq").alias("started_at"),
        latest(F.col("at"), ended).alias("ended_at"),
        *[F.coalesce(latest(F.col(c)), F.lit(0)).cast("long").alias(c) for c in COUNTERS],
    )


def log_row(spark, source_id: str, seq: int, action: str, at: Column | None = None, **sets) -> DataFrame:
    """One transition as a row of the log."""
    names = ("name", "url", "error")
    row = spark.range(1).select(F.lit(source_id).alias("id"), F.lit(seq).cast("long").alias("seq"), F.lit(action).alias("action"), (at if at is not None else F.current_timestamp()).alias("at"))
    return row.withColumns({n: F.lit(sets.get(n)).cast("string" if n in names else "long") for n in (*names, *COUNTERS)})


def failed_pages(failed: DataFrame, source_id: str | None = None) -> DataFrame:
    return failed if source_id is None else failed.where(F.col("source_id") == source_id)


def clear_failed(failed: DataFrame, source_id: str) -> DataFrame:
    return failed.where(F.col("source_id") != source_id)


def source_of(url: Column) -> Column:
    """Id of the source that a page belongs to: its host."""
    return generate_id("source", U.domain(url))


def jobs_of(raw: DataFrame, run: str, now: Column | None = None) -> DataFrame:
    """A job row for each source of fetched pages (url, html, error); a source without any page has failed."""
    rows = raw.withColumn("_url", U.normalize_url(F.col("url"))).withColumn("source_id", source_of(F.col("_url")))
    crawled, lost = F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())
    per = rows.groupBy("source_id").agg(crawled.alias("pages_crawled"), lost.alias("pages_failed"), F.min("error").alias("_error"))
    done = F.col("pages_crawled") > 0
    return per.select(
        generate_id("job", F.col("source_id"), F.lit(run)).alias("id"),
        "source_id",
        F.when(done, "completed").otherwise("failed").alias("status"),
        F.when(~done, F.col("_error")).alias("error_message"),
        (now if now is not None else F.current_timestamp()).alias("completed_at"),
        "pages_crawled",
        "pages_failed",
    )


def failed_of(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """source_id, url, error, timestamp of the pages that could not be fetched."""
    return raw.where("error IS NOT NULL").select(source_of(U.normalize_url(F.col("url"))).alias("source_id"), "url", "error", (now if now is not None else F.current_timestamp()).alias("timestamp"))


def run_totals(jobs: DataFrame, stats: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row: what a run over many sources has done."""
    of_jobs = jobs.agg(
        F.count_if(F.col("status") == "completed").alias("sources_completed"),
        F.count_if(F.col("status") == "failed").alias("sources_failed"),
        F.coalesce(F.sum("pages_crawled"), F.lit(0)).cast("long").alias("total_pages"),
        F.coalesce(F.sum("pages_failed"), F.lit(0)).cast("long").alias("failed_pages"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    of_pages = stats.agg(total("chunks_created").alias("total_chunks"), total("empty_pages").alias("empty_pages"), total("embedding_failures").alias("embedding_failures"))
    return of_jobs.crossJoin(of_pages).crossJoin(concepts.agg(F.count("*").alias("total_concepts")))  # one row each
