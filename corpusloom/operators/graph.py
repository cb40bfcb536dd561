"""Concepts, mentions, co-occurrence, neighbourhoods, page links, statistics."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import generate_id
from .store import top_per_group

MAX_CONCEPTS = 1000  # concepts of a source that mentions are sought for
SALTS = 16  # parts that the chunks of one source are dealt to


_own: list[str] = []


def shared_folder(spark) -> str:
    """spark.checkpoint.dir, or (in local mode only, where it is unset) a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="corpusloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extract_concepts(docs: DataFrame, text: str, source: str = "source", per_source: int = 50, least: int = 5, length: int = 4) -> DataFrame:
    """The commonest terms of each source: source_id, name, mention_count (documents), confidence.

    A deterministic stand-in for an extractor behind a model.
    """
    each = docs.select(F.col(source).alias("source_id"), F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("name")).where(F.length("name") >= length)
    counted = each.groupBy("source_id", "name").agg(F.count("*").alias("mention_count")).where(F.col("mention_count") >= least)
    top = top_per_group(counted, "source_id", [F.desc("mention_count"), F.col("name")], per_source)
    return top.select(
        generate_id("concept", F.col("source_id"), F.col("name")).alias("id"),
        "source_id",
        "name",
        F.lit("").alias("description"),
        F.lit("concept").alias("category"),
        F.least(F.lit(1.0), F.col("mention_count") / 10).alias("confidence"),
        "mention_count",
    )


def concepts_of(concepts: DataFrame, source: str | None = None, category: str | None = None, limit: int = 100) -> DataFrame:
    if source is not None:
        concepts = concepts.where(F.col("source_id") == source)
    if category is not None:
        concepts = concepts.where(F.col("category") == category)
    return concepts.orderBy(F.desc("mention_count"), "id").limit(limit)


def concepts_by_category(concepts: DataFrame, limit: int = 200) -> DataFrame:
    """category, n, names (sorted)."""
    return concepts.orderBy(F.desc("mention_count"), "id").limit(limit).groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def mentions(chunks: DataFrame, concepts: DataFrame, key: str, text: str, confidence: float = 0.7, whole_words: bool = False, most: int = MAX_CONCEPTS) -> DataFrame:
    """key, concept_id, confidence for every concept of a chunk's source whose name or alias the chunk contains.

    Each source has at most `most` concepts, folded to one array a source,
    so a chunk meets its source's names in one equi-join and no pairs that
    don't match are made; the array is there once for each of SALTS parts of a
    source's chunks, so that a large source is not one task.  whole_words
    matches tokens instead.
    """
    names = F.array(F.lower("name"))
    if "aliases" in concepts.columns:
        names = F.concat(names, F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a)))
    top = top_per_group(concepts, "source_id", [F.desc("mention_count"), F.col("id")], most)
    per = top.groupBy("source_id").agg(F.collect_list(F.struct(F.col("id"), names.alias("names"))).alias("_known"))
    per = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = chunks.select(key, F.col("source").alias("source_id"), F.lower(text).alias("_text"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_salt"))
    joined = dealt.join(per, ["source_id", "_salt"])
    if whole_words:
        joined = joined.withColumn("_tokens", F.array_distinct(F.regexp_extract_all("_text", F.lit(T.TOKEN), 0)))
        found = F.filter("_known", lambda c: F.arrays_overlap(c["names"], F.col("_tokens")))
    else:
        found = F.filter("_known", lambda c: F.exists(c["names"], lambda n: F.col("_text").contains(n)))
    return joined.select(key, F.explode(F.transform(found, lambda c: c["id"])).alias("concept_id")).withColumn("confidence", F.lit(confidence))


def last_mention(links: DataFrame, seq: str) -> DataFrame:
    """One row a (chunk, concept), the confidence of the last write."""
    return links.groupBy("chunk_id", "concept_id").agg(F.max_by("confidence", seq).alias("confidence"))


def co_occurrence(links: DataFrame, key: str, least: int = 2, limit: int | None = 100) -> DataFrame:
    """a, b, n, weight: concepts (a before b) named together in at least `least` chunks.

    Pairs are made inside each chunk's array of concepts, so no self-join
    deals mentions out twice.
    """
    per = links.groupBy(key).agg(F.array_sort(F.collect_set("concept_id")).alias("c"))
    pairs = per.select(F.explode(F.flatten(F.transform("c", lambda a, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    counted = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out = counted.withColumn("weight", F.least(F.lit(1.0), F.col("n") / 10))
    return out.orderBy(F.desc("n"), "a", "b").limit(limit) if limit else out


def merge_relations(relations: DataFrame, seq: str, inferred: DataFrame | None = None, keep_typed: bool = True) -> DataFrame:
    """One row a (from_id, to_id): the last type and weight; inferred pairs yield to typed ones unless keep_typed is off."""
    rows = relations.withColumn("_rank", F.struct(F.lit(1).alias("r"), F.col(seq).alias("s")))
    if inferred is not None:
        other = inferred.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("related_to").alias("type"), "weight")
        rows = rows.drop(seq).unionByName(other.withColumn("_rank", F.struct(F.lit(0 if keep_typed else 2).alias("r"), F.lit(0).cast(relations.schema[seq].dataType).alias("s"))))
    return rows.groupBy("from_id", "to_id").agg(F.max_by(F.struct("type", "weight"), "_rank").alias("m")).select("from_id", "to_id", "m.type", "m.weight")


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("x"), F.col("to_id").alias("y")).unionByName(edges.select(F.col("to_id").alias("x"), F.col("from_id").alias("y")))


def neighbourhood(start: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """id, depth of the nodes that at most `depth` undirected edges reach (0: the start)."""
    both = _undirected(edges).distinct()
    seen = start.select(F.col(start.columns[0]).alias("id")).distinct().withColumn("depth", F.lit(0))
    front = seen.select("id")
    for d in range(1, depth + 1):
        step = front.join(both, front["id"] == both["x"]).select(F.col("y").alias("id")).distinct()
        front = step.join(seen, "id", "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
        if depth > 2:
            seen = cut_lineage(seen)
            front = seen.where(F.col("depth") == d).select("id")
    return seen


def graph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def focused_graph(concepts: DataFrame, edges: DataFrame, source: str, name: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Concepts around those of a source whose name contains `name`, and the edges between them."""
    start = concepts.where((F.col("source_id") == source) & F.lower("name").contains(name.lower())).select("id")
    near = neighbourhood(start, edges, depth)
    return concepts.join(near, "id"), graph_edges(near, edges)


def full_graph(concepts: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Concepts of a source and all edges that touch one of them."""
    own = concepts.where(F.col("source_id") == source)
    ids = own.select("id")
    touching = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)).distinct()
    return own, touching


# ------------------------------------------------------------------ page links
def link_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """from_url, to_url, anchor_text: links between pages that exist; the last anchor of a pair counts."""
    urls = pages.select("url").distinct()
    both = links.join(urls.withColumnRenamed("url", "from_url"), "from_url", "left_semi").join(urls.withColumnRenamed("url", "to_url"), "to_url", "left_semi")
    return both.groupBy("from_url", "to_url").agg(F.max_by("anchor_text", "seq").alias("anchor_text"))


def indegree(edges: DataFrame, to: str) -> DataFrame:
    return edges.groupBy(to).agg(F.count("*").alias("indegree"))


# ------------------------------------------------------------------- statistics
def source_stats(sources: DataFrame, pages: DataFrame, chunks: DataFrame, concepts: DataFrame, fanout_quirk: bool = False) -> DataFrame:
    """source_id, pages, chunks, concepts, total_tokens.

    Each child is summed before it is joined; fanout_quirk multiplies tokens
    by the number of concepts, as a chain of optional matches would.
    """
    per_page = pages.groupBy("source_id").agg(F.countDistinct("page_id").alias("pages"))
    per_chunk = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("total_tokens"))
    per_concept = concepts.groupBy("source_id").agg(F.countDistinct("id").alias("concepts"))
    out = sources.select("source_id").distinct()
    for side in (per_page, per_chunk, per_concept):
        out = out.join(side, "source_id", "left")
    out = out.na.fill(0, ["pages", "chunks", "concepts", "total_tokens"])
    if fanout_quirk:
        out = out.withColumn("total_tokens", F.col("total_tokens") * F.greatest(F.col("concepts"), F.lit(1)))
    return out.select("source_id", "pages", "chunks", "concepts", "total_tokens")


def rate_schedule(arrivals: DataFrame, group: str, at: Column, delay: float, tie: str, span: float | None = None) -> DataFrame:
    """start (seconds) of each request when a group's requests are at least `delay` apart.

    start_i = max(arrival_i, start_{i-1} + delay) in closed form: the running
    maximum of arrival - i * delay, plus i * delay.  A group is cut into
    spans of arrival time (a thousand delays unless given), whose counts and maxima are carried over, so that
    no window holds more than one span of one group.
    """
    part, span = [group, "_span"], span or 1000 * delay or 1.0
    rows = arrivals.withColumn("_at", at.cast("double")).withColumn("_span", F.floor(F.col("_at") / F.lit(span)))
    before = Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # over spans, not rows
    counts = rows.groupBy(*part).agg(F.count("*").alias("_n")).withColumn("_past", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = Window.partitionBy(*part).orderBy("_at", tie)
    rows = rows.join(counts, part).withColumn("_i", F.col("_past") + F.row_number().over(here))
    rows = rows.withColumn("_v", F.col("_at") - F.col("_i") * F.lit(delay))
    most = rows.groupBy(*part).agg(F.max("_v").alias("_m")).withColumn("_most", F.max("_m").over(before)).drop("_m")
    running = F.max("_v").over(here.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_run", running).join(most, part)
    return out.withColumn("start", F.greatest("_run", "_most") + F.col("_i") * F.lit(delay)).drop("_i", "_at", "_span", "_past", "_v", "_run", "_most")


def crawl(edges: DataFrame, roots: DataFrame, max_depth: int = 2, max_pages: int | None = None, priority: str | None = None) -> DataFrame:
    """id, depth of pages in breadth-first order; with max_pages the best of the last depth that fit.

    edges: src, dst and perhaps a priority (higher first).  Only the size of
    the frontier comes to the driver.
    """
    seen = roots.select(F.col(roots.columns[0]).alias("id")).distinct().withColumn("depth", F.lit(0))
    front, taken = seen, None
    if max_pages is not None:
        taken = seen.count()
    rank = F.max(priority).alias("p") if priority else F.max(F.lit(0.0)).alias("p")
    for d in range(1, max_depth + 1):
        step = front.select(F.col("id").alias("src")).join(edges, "src").groupBy("dst").agg(rank).select(F.col("dst").alias("id"), "p")
        step = step.join(seen, "id", "left_anti")
        if max_pages is not None:
            step = step.orderBy(F.desc("p"), "id").limit(max(0, max_pages - taken))
        front = cut_lineage(step.select("id", F.lit(d).alias("depth")))
        if max_pages is not None:
            taken += front.count()
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def crawl_best_first(edges: DataFrame, roots: DataFrame, max_depth: int = 2, max_pages: int = 500) -> DataFrame:
    """id, depth, priority, visit (turn) of pages taken from one queue over all depths, the best first.

    edges: src, dst, priority (higher first).  A turn takes all pages that
    hold the best priority of the queue, least depth and id first, and queues
    what they link to, so that turns are as many as priorities and depths
    alternate, not as pages.  A page has the depth of its first visit.
    """
    empty = roots.select(F.col(roots.columns[0]).alias("id")).distinct().select("id", F.lit(0).alias("depth"), F.lit(1.0).alias("priority"))
    queue, seen, taken, turn = cut_lineage(empty), None, 0, 0
    while taken < max_pages:
        best = queue.agg(F.max("priority")).first()[0]
        if best is None:
            break
        # An id may wait several times: it leaves with its least depth.
        now = queue.where(F.col("priority") == best).groupBy("id").agg(F.min("depth").alias("depth"))
        now = cut_lineage(now.orderBy("depth", "id").limit(max_pages - taken).select("id", "depth", F.lit(best).alias("priority"), F.lit(turn).alias("visit")))
        seen = now if seen is None else seen.unionByName(now)
        taken, turn = taken + now.count(), turn + 1
        if turn % 10 == 0:  # a union of ten tables at most
            seen = cut_lineage(seen)
        open_ = now.where(F.col("depth") < max_depth).select(F.col("id").alias("src"), (F.col("depth") + 1).alias("depth"))
        fresh = open_.join(edges, "src").groupBy(F.col("dst").alias("id"), "depth").agg(F.max(F.col("priority").cast("double")).alias("priority"))
        queue = cut_lineage(queue.unionByName(fresh).join(seen.select("id"), "id", "left_anti"))
    return seen if seen is not None else empty.withColumn("visit", F.lit(0)).limit(0)


def link_stats(page_links: DataFrame, mentioned: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: links between pages, from chunks to concepts, and between concepts."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(page_links, "page_links_created").crossJoin(n(mentioned, "chunk_concept_links")).crossJoin(n(relations, "concept_relations"))  # one row each
