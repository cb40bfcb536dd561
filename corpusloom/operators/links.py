"""Which links of a page to follow: site filter, decisions remembered by URL shape, a provider, the heuristic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# A provider takes links (url, anchor_text, title, is_navigation, context) and gives the URLs to follow,
# or, in detail, a decision (follow, priority, reason) for some of the URLs; it may raise.
Batch = Callable[[list[dict]], set[str]]
Detailed = Callable[[list[dict]], dict[str, tuple[bool, float, str]]]
_DECISION = "should_follow boolean, priority double, reason string"
# Reasons and priorities of decisions.
CACHED, BATCH, NOT_EVALUATED = "cached decision", "batch evaluation", "not evaluated"
CACHED_PRIORITY, BATCH_PRIORITY = 0.5, 0.6


def _decided(batch: Batch | None, detailed: Detailed | None):
    """Column function: link -> decision, null where the provider failed."""

    def decide(links: list[dict]) -> list[tuple]:
        if detailed is not None:
            said = detailed(links)
            return [said.get(x["url"], (False, 0.0, NOT_EVALUATED)) for x in links]
        follow = batch(links)
        return [(x["url"] in follow, BATCH_PRIORITY if x["url"] in follow else 0.0, BATCH) for x in links]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for links in batches:
            try:
                rows = decide(links.to_dict("records"))
            except Exception:  # noqa: BLE001  a provider may raise anything
                rows = [(None, None, None)] * len(links)
            yield pd.DataFrame(rows, columns=["should_follow", "priority", "reason"])

    return F.pandas_udf(run, _DECISION)


def evaluate_links(links: DataFrame, root: str, cache: DataFrame | None = None, batch: Batch | None = None, detailed: Detailed | None = None) -> DataFrame:
    """Links of the root's site with should_follow, priority, reason and shape.

    cache (shape, should_follow) holds earlier decisions and settles links of
    the same shape.  Without a provider, and where it fails, the heuristic
    decides.
    """
    near = links.where(U.prefilter(F.col("url"), F.lit(root))).withColumn("shape", U.url_shape(F.col("url")))
    if cache is None:
        near = near.withColumn("_cached", F.lit(None).cast("boolean"))
    else:
        near = near.join(cache.select("shape", F.col("should_follow").alias("_cached")), "shape", "left")
    settled = near.where("_cached IS NOT NULL").withColumn(
        "_d", F.struct(F.col("_cached").alias("should_follow"), F.when(F.col("_cached"), CACHED_PRIORITY).otherwise(F.lit(0.0)).alias("priority"), F.lit(CACHED).alias("reason"))
    )
    open_ = near.where("_cached IS NULL")
    own = U.link_score(F.col("url"), F.col("anchor_text"), F.col("is_navigation"))
    if batch is not None or detailed is not None:
        told = _decided(batch, detailed)(F.struct("url", "anchor_text", "title", "is_navigation", "context"))
        open_ = open_.withColumn("_told", told).withColumn("_d", F.when(F.col("_told.should_follow").isNotNull(), F.col("_told")).otherwise(own)).drop("_told")
    else:
        open_ = open_.withColumn("_d", own)
    return settled.unionByName(open_).select(*links.columns, "shape", "_d.*")


def remember(evaluated: DataFrame, cache: DataFrame | None = None, seq: str = "pos") -> DataFrame:
    """shape, should_follow: the last decision of each shape; new ones replace those of the cache."""
    fresh = evaluated.where(F.col("reason") != CACHED).select("shape", "should_follow", F.struct(F.lit(1).alias("r"), F.col(seq).cast("long").alias("s")).alias("_seq"))
    if cache is not None:
        fresh = fresh.unionByName(cache.select("shape", "should_follow", F.struct(F.lit(0).alias("r"), F.lit(0).cast("long").alias("s")).alias("_seq")))
    return fresh.groupBy("shape").agg(F.max_by("should_follow", "_seq").alias("should_follow"))
