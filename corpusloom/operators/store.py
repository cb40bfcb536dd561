"""Keyed upserts, deletes and lookups over node and edge tables.

An upsert is one union and one aggregation with a policy for each column;
rows have a sequence number, so the result does not depend on arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, FIRST, REPLACE, MAX, LONGEST, COUNT = "keep", "first", "replace", "max", "longest", "count"


def _policy(column: str, policy: str, seq: str) -> Column:
    c = F.col(column)
    if policy == KEEP:
        return F.min_by(c, F.when(c.isNotNull(), F.col(seq)))
    if policy == FIRST:  # a null too
        return F.min_by(c, F.col(seq))
    if policy == REPLACE:
        return F.max_by(c, F.when(c.isNotNull(), F.col(seq)))
    if policy == MAX:
        return F.max(c)
    if policy == LONGEST:  # the earliest of the longest
        return F.max_by(c, F.struct(F.coalesce(F.length(c), F.lit(-1)), -F.col(seq)))
    if policy == COUNT:
        return F.sum(F.coalesce(c, F.lit(1)))
    raise ValueError(policy)


def merge(rows: DataFrame, keys: list[str], policies: dict[str, str], seq: str = "seq") -> DataFrame:
    """One row a key from rows in the order of seq."""
    return rows.groupBy(*keys).agg(*[_policy(c, p, seq).alias(c) for c, p in policies.items()])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], policies: dict[str, str], seq: str = "seq") -> DataFrame:
    """existing rows come before incoming ones, whose order is seq."""
    first = existing.withColumn(seq, F.lit(-1).cast("long")).select(*keys, *policies, seq)
    return merge(first.unionByName(incoming.select(*keys, *policies, F.col(seq).cast("long").alias(seq))), keys, policies, seq)


SOURCE_POLICY = {"root_url": KEEP, "domain": KEEP, "name": REPLACE, "description": REPLACE, "status": KEEP, "total_pages": KEEP, "created_at": KEEP, "updated_at": REPLACE}
PAGE_POLICY = {
    "url": KEEP, "source_id": KEEP, "title": REPLACE, "description": REPLACE, "content_preview": REPLACE, "content_hash": REPLACE, "word_count": REPLACE,
    "depth": KEEP, "language": KEEP, "crawled_at": KEEP, "updated_at": REPLACE,
}
CONCEPT_POLICY = {"name": KEEP, "description": LONGEST, "category": KEEP, "confidence": MAX, "mention_count": COUNT}
EDGE_POLICY = {"type": REPLACE, "weight": REPLACE}


def existing_only(rows: DataFrame, nodes: DataFrame, on: str, key: str) -> DataFrame:
    """Rows whose endpoint exists."""
    return rows.join(nodes.select(F.col(key).alias(on)), on, "left_semi")


CHUNK_POLICY = {"page_id": KEEP, "content": REPLACE, "semantic_type": REPLACE, "heading_context": REPLACE, "chunk_index": REPLACE, "token_count": REPLACE}


def create_chunks(existing: DataFrame, incoming: DataFrame, pages: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """All chunks after an upsert of those whose page exists, and the new rows without their vectors."""
    known = existing_only(incoming, pages, "page_id", "id")
    policy = CHUNK_POLICY | ({"embedding": REPLACE} if "embedding" in incoming.columns else {})
    return upsert(existing, known, ["id"], policy, seq), merge(known, ["id"], CHUNK_POLICY, seq)


def delete_cascade(keys: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows whose column is a key, and one row of how many rows each loses."""
    left, counts = {}, None
    for name, (df, column) in tables.items():
        side = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
        left[name] = df.join(side, column, "left_anti")
        lost = df.join(side, column, "left_semi").agg(F.count("*").alias(name))
        counts = lost if counts is None else counts.crossJoin(lost)  # one row each
    return left, counts


def latest(df: DataFrame, by: str, order: Column, tie: str) -> DataFrame:
    """The last row of each group; ties go to the least tie column.

    max_by keeps one row a group on the map side, where a window would sort all.
    """
    columns = [c for c in df.columns if c != by]
    best = df.groupBy(by).agg(F.max_by(F.struct(*columns), F.struct(order, -F.col(tie))).alias("_r"))
    return best.select(by, *[F.col(f"_r.{c}").alias(c) for c in columns])


def paged(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def changed(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """Incoming rows that are new or whose digest differs."""
    return incoming.join(existing.select(key, digest), [key, digest], "left_anti")


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def status_update(sources: DataFrame, source_id: str, status: str, total_pages: int | None = None, now: Column | None = None) -> DataFrame:
    """Sets the status; with a page count also the count and the time of the crawl."""
    hit = F.col("id") == source_id
    out = sources.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))
    if total_pages is not None:
        out = out.withColumn("total_pages", F.when(hit, F.lit(total_pages)).otherwise(F.col("total_pages")))
        out = out.withColumn("last_crawled", F.when(hit, now if now is not None else F.current_timestamp()).otherwise(F.col("last_crawled")))
    return out


def job_update(jobs: DataFrame, job_id: str, status: str | None = None, pages_crawled: int | None = None, pages_failed: int | None = None, error: str | None = None, now: Column | None = None) -> DataFrame:
    """Sets what is given; completed_at follows a final status."""
    hit = F.col("id") == job_id
    for name, value in (("status", status), ("pages_crawled", pages_crawled), ("pages_failed", pages_failed), ("error_message", error)):
        if value is not None:
            jobs = jobs.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    if status in ("completed", "failed"):
        jobs = jobs.withColumn("completed_at", F.when(hit, now if now is not None else F.current_timestamp()).otherwise(F.col("completed_at")))
    return jobs
