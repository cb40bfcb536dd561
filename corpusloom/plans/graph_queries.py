"""Concept, graph, store, crawl, state and streaming queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import generate_id
from ..operators import graph as G
from ..operators import search as S
from ..operators import store as K
from ..sources import tables as B
from ..streaming import ingest as I
from .search_queries import QUERY, _docs, _rounded, _TEXT, read


def _concepts(spark, d):
    return G.extract_concepts(read(spark, d, "documents"), "text", per_source=20)


def concept_extract(spark, d):
    return _rounded(_concepts(spark, d), "confidence")


def concept_upsert_merge(spark, d):
    """Mentions of concepts folded into one row each, in the order of doc_id."""
    rows = read(spark, d, "documents").select(
        F.col("source").alias("source_id"),
        F.lower(F.col("lang")).alias("key"),
        F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("name"),
        F.col("text").alias("description"),
        F.concat(F.lit("c"), F.col("doc_id") % 3).alias("category"),
        (F.col("doc_id") % 10 / 10).alias("confidence"),
        F.lit(1).cast("long").alias("mention_count"),
        F.col("doc_id").alias("seq"),
    )
    return K.merge(rows, ["source_id", "key"], K.CONCEPT_POLICY).withColumn("description", F.md5("description"))


def concepts_topk(spark, d):
    return G.concepts_of(_concepts(spark, d), "src1", limit=10).select("id", "name", "mention_count")


def concepts_by_category(spark, d):
    marked = _concepts(spark, d).withColumn("category", F.concat(F.lit("len"), F.length("name")))
    return G.concepts_by_category(marked).select("category", "n", F.array_join("names", ",").alias("names"))


def _mentions(spark, d):
    return G.mentions(read(spark, d, "documents"), _concepts(spark, d), "doc_id", "text")


def mentions_contains(spark, d):
    return _mentions(spark, d)


def mentions_whole_words(spark, d):
    return G.mentions(read(spark, d, "documents"), _concepts(spark, d), "doc_id", "text", whole_words=True).groupBy("concept_id").agg(F.count("*").alias("n"))


def mentions_confidence_last(spark, d):
    rows = read(spark, d, "documents").select(F.concat(F.lit("k"), F.col("doc_id") % 50).alias("chunk_id"), F.concat(F.lit("c"), F.col("doc_id") % 7).alias("concept_id"), (F.col("doc_id") % 11 / 10).alias("confidence"), "doc_id")
    return _rounded(G.last_mention(rows, "doc_id"), "confidence")


def concept_cooccurrence(spark, d):
    return _rounded(G.co_occurrence(_mentions(spark, d), "doc_id"), "weight")


def _relations(spark, d) -> DataFrame:
    """A made-up graph over doc_ids: i -> 7i + k modulo n."""
    docs = read(spark, d, "documents").select("doc_id")
    n = docs.count()
    each = docs.crossJoin(F.broadcast(docs.sparkSession.range(1, 4).withColumnRenamed("id", "k")))  # three rows
    return each.select(F.col("doc_id").alias("from_id"), ((F.col("doc_id") * 7 + F.col("k")) % n).alias("to_id"), F.concat(F.lit("t"), F.col("k")).alias("type"), (F.col("k") / 10).alias("weight"), F.col("k").alias("seq"))


def concept_relations_merged(spark, d):
    rows = _relations(spark, d).select((F.col("from_id") % 20).alias("from_id"), (F.col("to_id") % 20).alias("to_id"), F.col("type"), F.col("weight"), (F.col("from_id") * 10 + F.col("seq")).alias("seq"))
    return _rounded(G.merge_relations(rows, "seq"), "weight")


def concept_graph_2hop(spark, d):
    start = read(spark, d, "documents").where("source = 'src7'").select("doc_id")
    return G.neighbourhood(start, _relations(spark, d), 2).select("id", F.col("depth").cast("long").alias("depth"))


def concept_graph_full(spark, d):
    nodes = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"))
    return G.full_graph(nodes, _relations(spark, d).select("from_id", "to_id", "type"), "src1")[1].select("from_id", "to_id", "type")


def page_link_graph(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    n = p.count()
    links = p.crossJoin(F.broadcast(spark.range(1, 4).withColumnRenamed("id", "k"))).select(F.col("url").alias("from_url"), ((F.col("page_id") * 7 + F.col("k")) % (n + 20)).alias("page_id"), F.concat(F.lit("a"), F.col("k")).alias("anchor_text"), F.col("k").alias("seq"))
    named = links.join(p.withColumnRenamed("url", "to_url"), "page_id", "left").withColumn("to_url", F.coalesce("to_url", F.lit("https://gone.example.com/")))
    return G.link_pages(named, p)


def page_indegree(spark, d):
    return G.indegree(page_link_graph(spark, d), "to_url")


# ---------------------------------------------------------------------- sources
def _parts(spark, d):
    docs = read(spark, d, "documents")
    pages = docs.select(F.col("source").alias("source_id"), F.col("doc_id").alias("page_id"))
    chunks = docs.select(F.col("source").alias("source_id"), T.token_count(F.col("text")).alias("token_count"))
    return docs.select(F.col("source").alias("source_id")).distinct(), pages, chunks, _concepts(spark, d)


def source_stats(spark, d):
    return G.source_stats(*_parts(spark, d))


def source_stats_fanout_quirk(spark, d):
    return G.source_stats(*_parts(spark, d), fanout_quirk=True)


def list_sources(spark, d):
    docs = read(spark, d, "documents")
    s = docs.groupBy(F.col("source").alias("name")).agg(F.max("doc_id").alias("created_at")).withColumn("id", generate_id("source", F.col("name")))
    return s.withColumn("status", F.when(F.col("created_at") % 2 == 0, "completed").otherwise("indexing")).where("status = 'completed'").orderBy(F.desc("created_at"), "id").select("id", "name", "status", "created_at")


def doc_sources(spark, d):
    return source_stats(spark, d).select(F.col("source_id").alias("name"), generate_id("source", F.col("source_id")).alias("id"), "pages", "chunks", "concepts")


def source_status_update(spark, d):
    s = read(spark, d, "documents").groupBy(F.col("source").alias("id")).agg(F.lit("pending").alias("status"), F.count("*").alias("total_pages"), F.lit(None).cast("timestamp").alias("last_crawled"))
    return K.status_update(s, "src1", "completed", 99, F.lit("2024-01-01 00:00:00").cast("timestamp")).select("id", "status", "total_pages", F.col("last_crawled").isNotNull().alias("crawled"))


def delete_source_cascade(spark, d):
    _, pages, chunks, concepts = _parts(spark, d)
    keys = spark.createDataFrame([("src1",), ("src2",)], "source_id string")
    return K.delete_cascade(keys, {"pages": (pages, "source_id"), "chunks": (chunks, "source_id"), "concepts": (concepts, "source_id")})[1]


def delete_page_chunks(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang")
    keys = docs.where("lang = 'de'").select("doc_id")
    return K.delete_cascade(keys, {"chunks": (docs, "doc_id")})[0]["chunks"].select("doc_id")


def upsert_page_policy(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select(F.concat(F.lit("u"), F.col("doc_id") % 100).alias("url"), F.col("lang").alias("language"), F.md5("text").alias("title"), (F.col("doc_id") % 4).cast("int").alias("depth"), F.col("doc_id").alias("seq"))
    return K.merge(rows, ["url"], {"title": K.REPLACE, "language": K.KEEP, "depth": K.KEEP})


def upsert_source_policy(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select(F.col("source").alias("root_url"), F.concat(F.lit("n"), F.col("doc_id")).alias("name"), F.concat(F.lit("s"), F.col("doc_id")).alias("status"), F.col("doc_id").alias("seq"))
    return K.upsert(rows.where("seq < 40").drop("seq").dropDuplicates(["root_url"]).withColumn("name", F.lit("old")).withColumn("status", F.lit("old")), rows.where("seq >= 40"), ["root_url"], {"name": K.REPLACE, "status": K.KEEP})


def node_lookup(spark, d):
    return read(spark, d, "documents").where("doc_id = 7").select("doc_id", "source", "lang")


def list_pages_paged(spark, d):
    return K.paged(read(spark, d, "pages").select("page_id", "url"), [F.desc("page_id")], 20, 40)


# ------------------------------------------------------------------ jobs, state
def _jobs(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"), "value")


def latest_job_per_source(spark, d):
    return K.latest(_jobs(spark, d), "source_id", F.col("started_at"), "id").select("source_id", "id", "status")


def job_status_rollup(spark, d):
    return _jobs(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def incomplete_sources(spark, d):
    last = K.latest(_jobs(spark, d), "source_id", F.col("started_at"), "id")
    return B.incomplete(last.withColumn("status", F.when(F.col("status") == "view", "indexing").otherwise(F.col("status")))).select("source_id")


def failed_pages_latest(spark, d):
    failed = _jobs(spark, d).where("status = 'error'")
    return failed.orderBy(F.desc("started_at"), "id").limit(20).select("id", "source_id")


def run_report(spark, d):
    """Totals of a run: pages, failures, success rate."""
    t = _jobs(spark, d).agg(F.sum((F.col("status") != "error").cast("long")).alias("pages"), F.sum((F.col("status") == "error").cast("long")).alias("failed"))
    return t.select("pages", "failed", F.round(F.col("pages") / (F.col("pages") + F.col("failed")) * 100, 6).alias("success_rate"))


def rate_limit_schedule(spark, d):
    e = read(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    out = G.rate_schedule(e.select("event_id", "user_id", "ts"), "user_id", at, 3600.0, "event_id")
    return out.select("event_id", F.round("start", 3).alias("start"))


def _edges(spark, d):
    r = _relations(spark, d)
    return r.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), (1 - F.col("weight")).alias("priority"))


def crawl_bfs_depth(spark, d):
    roots = read(spark, d, "documents").where("doc_id = 0").select("doc_id")
    return G.crawl(_edges(spark, d), roots, 3).select("id", F.col("depth").cast("long").alias("depth"))


def crawl_max_pages(spark, d):
    roots = read(spark, d, "documents").where("doc_id = 0").select("doc_id")
    return G.crawl(_edges(spark, d), roots, 5, 30, "priority").groupBy("depth").agg(F.count("*").alias("n")).select(F.col("depth").cast("long").alias("depth"), "n")


# ------------------------------------------------------------------ JSON repair
def _payloads(spark, d):
    e = read(spark, d, "events").select("event_id", "props")
    k = F.col("event_id") % 4
    return e.select(
        "event_id",
        F.when(k == 0, F.col("props"))
        .when(k == 1, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Here: "), F.regexp_replace("props", r"\}$", ", }"), F.lit(" ok")))
        .otherwise(F.lit("no object"))
        .alias("raw"),
        "props",
    )


def llm_json_repair(spark, d):
    return _payloads(spark, d).select("event_id", F.get_json_object(T.repair_json(F.col("raw")), "$.k").cast("long").alias("k"))


def ontology_partial_extract(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("t"))
    body = F.concat(
        F.lit('{"concepts": [{"name": "'), F.col("t"), F.lit('", "confidence": 0.5}, {"description": "no name"}, {"name": "b", "category": "tool"}], "relationships": [{"from": "'),
        F.col("t"), F.lit('", "to": "b", "type": "uses"}, {"from": "x"},]}'),
    )
    o = T.parse_ontology(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    concepts = e.select("event_id", F.explode(o["concepts"]).alias("c"))
    return concepts.select("event_id", "c.name", "c.category", F.round("c.confidence", 6).alias("confidence"))


def ontology_relations(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("t"))
    body = F.concat(F.lit('{"concepts": [], "relationships": [{"from_concept": "'), F.col("t"), F.lit('", "to": "b", "type": "uses"}, {"from": "x"}]}'))
    rels = e.select("event_id", F.explode(T.parse_ontology(body)["relationships"]).alias("r"))
    return rels.select("event_id", F.col("r.from").alias("from_id"), F.col("r.to").alias("to_id"), "r.type", F.round("r.confidence", 6).alias("confidence"))


# ------------------------------------------------------------------ context pack
def context_pack_chunks(spark, d):
    docs = _docs(spark, d)
    hits = S.fulltext_search(docs, QUERY, "doc_id", "text", 10).select("doc_id", "source", F.round("score", 6).alias("score"), T.truncate_text(F.col("text"), 200).alias("content"))
    return hits


def context_pack_concepts(spark, d):
    """Concepts of the first three sources that the hits come from."""
    hits = S.fulltext_search(_docs(spark, d), QUERY, "doc_id", "text", 10)
    first = hits.groupBy("source").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "source").limit(3).select(F.col("source").alias("source_id"))
    near = _concepts(spark, d).join(first, "source_id")
    return K.top_per_group(near, "source_id", [F.desc("mention_count"), F.col("id")], 30).orderBy(F.desc("mention_count"), "id").limit(20).select("id", "source_id", "name", "mention_count")


def preset_estimates(spark, d):
    return B.estimate_minutes(B.presets(spark))


def ingest_progress_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each event type, by a stream over the events that ends when it has read them."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders: the table's own file by its name, or all files of it.
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if not _is_folder(spark, path) else "*.parquet").parquet(folder if not _is_folder(spark, path) else path)
    counted = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return I.run_to_table(counted, f"progress_{uuid.uuid4().hex[:8]}")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {
    f.__name__: f
    for f in (
        concept_extract, concept_upsert_merge, concepts_topk, concepts_by_category, mentions_contains, mentions_whole_words, mentions_confidence_last, concept_cooccurrence,
        concept_relations_merged, concept_graph_2hop, concept_graph_full, page_link_graph, page_indegree, source_stats, source_stats_fanout_quirk, list_sources, doc_sources,
        source_status_update, delete_source_cascade, delete_page_chunks, upsert_page_policy, upsert_source_policy, node_lookup, list_pages_paged, latest_job_per_source,
        job_status_rollup, incomplete_sources, failed_pages_latest, run_report, rate_limit_schedule, crawl_bfs_depth, crawl_max_pages, llm_json_repair,
        ontology_partial_extract, ontology_relations, context_pack_chunks, context_pack_concepts, preset_estimates, ingest_progress_stream,
    )
}

# --------------------------------------------------------------------- DuckDB
_CONC = r"""
terms AS (SELECT source AS source_id, term AS name, count(*) AS mention_count FROM (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) WHERE length(term) >= 4 GROUP BY 1, 2 HAVING count(*) >= 5),
conc AS (SELECT 'concept_' || substr(sha256(source_id || '|' || name), 1, 12) AS id, * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY mention_count DESC, name) AS rn FROM terms) WHERE rn <= 20)"""
_MENT = "ment AS (SELECT doc_id, id AS concept_id FROM documents JOIN conc ON source = source_id AND contains(lower(text), name))"
_REL = "rel AS (SELECT doc_id AS from_id, (doc_id * 7 + k) % (SELECT count(*) FROM documents) AS to_id, 't' || k AS type, k / 10.0::DOUBLE AS weight, k FROM documents, range(1, 4) r(k))"
_STATS = f"""
WITH {_CONC} SELECT s.source AS source_id, count(*) AS pages, count(*) AS chunks, any_value(coalesce(c.n, 0)) AS concepts, sum(length(text) // 4)::BIGINT @ AS total_tokens
FROM documents s LEFT JOIN (SELECT source_id, count(*) AS n FROM conc GROUP BY 1) c ON c.source_id = s.source GROUP BY s.source"""
_PLINK = """
n AS (SELECT count(*) + 20 AS n FROM pages),
raw AS (SELECT url AS from_url, (page_id * 7 + k) % n AS t, k FROM pages, range(1, 4) r(k), n),
edges AS (SELECT from_url, url AS to_url, 'a' || max(k) AS anchor_text FROM raw JOIN pages ON page_id = t GROUP BY 1, 2)"""
_LAST = "last AS (SELECT user_id AS source_id, event_id AS id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1)"
_BFS = f"""
WITH RECURSIVE {_REL},
bfs AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT to_id, depth + 1 FROM bfs JOIN rel ON from_id = id WHERE depth < @)"""



def _best_of_each_depth(depth: int, most: int) -> str:
    """The crawl with a page limit, one CTE for each depth."""
    parts = [f"WITH {_REL}, d0 AS (SELECT 0::BIGINT AS id), s0 AS (SELECT * FROM d0)"]
    for k in range(1, depth + 1):
        parts.append(
            f"d{k} AS (SELECT to_id AS id FROM rel JOIN d{k - 1} ON from_id = id WHERE to_id NOT IN (FROM s{k - 1}) GROUP BY to_id ORDER BY max(1 - weight) DESC, to_id LIMIT (SELECT greatest(0, {most} - count(*)) FROM s{k - 1})),"
            f" s{k} AS (FROM s{k - 1} UNION ALL FROM d{k})"
        )
    return ", ".join(parts) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k}::BIGINT AS depth, count(*) AS n FROM d{k}" for k in range(depth + 1)) + ") WHERE n > 0"


ORACLES = {
    "concept_extract": f"WITH {_CONC} SELECT id, source_id, name, '' AS description, 'concept' AS category, round(least(1.0, mention_count / 10)::DOUBLE, 6) AS confidence, mention_count FROM conc",
    "concept_upsert_merge": "SELECT source AS source_id, lower(lang) AS key, arg_min(CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END, doc_id) AS name, md5(arg_max(text, length(text) * 10000000 - doc_id)) AS description, arg_min('c' || doc_id % 3, doc_id) AS category, max((doc_id % 10)::DOUBLE / 10) AS confidence, count(*) AS mention_count FROM documents GROUP BY 1, 2",
    "concepts_topk": f"WITH {_CONC} SELECT id, name, mention_count FROM conc WHERE source_id = 'src1' ORDER BY mention_count DESC, id LIMIT 10",
    "concepts_by_category": f"WITH {_CONC}, top AS (SELECT * FROM conc ORDER BY mention_count DESC, id LIMIT 200) SELECT 'len' || length(name) AS category, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM top GROUP BY 1",
    "mentions_contains": f"WITH {_CONC}, {_MENT} SELECT doc_id, concept_id, 0.7::DOUBLE AS confidence FROM ment",
    "mentions_whole_words": rf"WITH {_CONC}, w AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents) SELECT id AS concept_id, count(*) AS n FROM w JOIN conc ON source = source_id AND term = name GROUP BY 1",
    "mentions_confidence_last": "SELECT 'k' || doc_id % 50 AS chunk_id, 'c' || doc_id % 7 AS concept_id, round(arg_max((doc_id % 11)::DOUBLE / 10, doc_id), 6) AS confidence FROM documents GROUP BY 1, 2",
    "concept_cooccurrence": f"WITH {_CONC}, {_MENT} SELECT x.concept_id AS a, y.concept_id AS b, count(*) AS n, round(least(1.0, count(*) / 10)::DOUBLE, 6) AS weight FROM ment x JOIN ment y ON x.doc_id = y.doc_id AND x.concept_id < y.concept_id GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 100",
    "concept_relations_merged": f"WITH {_REL} SELECT from_id % 20 AS from_id, to_id % 20 AS to_id, arg_max(type, from_id * 10 + k) AS type, round(arg_max(weight, from_id * 10 + k), 6) AS weight FROM rel GROUP BY 1, 2",
    "concept_graph_2hop": f"WITH {_REL}, both_ AS (SELECT from_id AS x, to_id AS y FROM rel UNION SELECT to_id, from_id FROM rel), h0 AS (SELECT doc_id AS id, 0 AS depth FROM documents WHERE source = 'src7'), h1 AS (SELECT y AS id, 1 AS depth FROM h0 JOIN both_ ON x = id), h2 AS (SELECT y AS id, 2 AS depth FROM h1 JOIN both_ ON x = id) SELECT id, min(depth)::BIGINT AS depth FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY id",
    "concept_graph_full": f"WITH {_REL}, own AS (SELECT doc_id FROM documents WHERE source = 'src1') SELECT DISTINCT from_id, to_id, type FROM rel WHERE from_id IN (FROM own) OR to_id IN (FROM own)",
    "page_link_graph": f"WITH {_PLINK} SELECT * FROM edges",
    "page_indegree": f"WITH {_PLINK} SELECT to_url, count(*) AS indegree FROM edges GROUP BY 1",
    "source_stats": _STATS.replace("@", ""),
    "source_stats_fanout_quirk": _STATS.replace("@", "* greatest(any_value(coalesce(c.n, 0)), 1)"),
    "list_sources": "SELECT 'source_' || substr(sha256(source), 1, 12) AS id, source AS name, 'completed' AS status, max(doc_id) AS created_at FROM documents GROUP BY source HAVING max(doc_id) % 2 = 0",
    "doc_sources": f"WITH {_CONC} SELECT source AS name, 'source_' || substr(sha256(source), 1, 12) AS id, count(*) AS pages, count(*) AS chunks, any_value(coalesce(c.n, 0)) AS concepts FROM documents LEFT JOIN (SELECT source_id, count(*) AS n FROM conc GROUP BY 1) c ON source_id = source GROUP BY source",
    "source_status_update": "SELECT source AS id, CASE WHEN source = 'src1' THEN 'completed' ELSE 'pending' END AS status, CASE WHEN source = 'src1' THEN 99 ELSE count(*) END AS total_pages, source = 'src1' AS crawled FROM documents GROUP BY source",
    "delete_source_cascade": f"WITH {_CONC} SELECT count(*) AS pages, count(*) AS chunks, (SELECT count(*) FROM conc WHERE source_id IN ('src1', 'src2')) AS concepts FROM documents WHERE source IN ('src1', 'src2')",
    "delete_page_chunks": "SELECT doc_id FROM documents WHERE lang <> 'de'",
    "upsert_page_policy": "SELECT 'u' || doc_id % 100 AS url, arg_max(md5(text), doc_id) AS title, arg_min(lang, doc_id) AS language, arg_min((doc_id % 4)::INT, doc_id) AS depth FROM documents GROUP BY 1",
    "upsert_source_policy": "SELECT source AS root_url, CASE WHEN max(doc_id) >= 40 THEN 'n' || max(doc_id) ELSE 'old' END AS name, CASE WHEN min(doc_id) < 40 THEN 'old' ELSE 's' || min(doc_id) END AS status FROM documents GROUP BY source",
    "node_lookup": "SELECT doc_id, source, lang FROM documents WHERE doc_id = 7",
    "list_pages_paged": "SELECT page_id, url FROM pages ORDER BY page_id DESC LIMIT 20 OFFSET 40",
    "latest_job_per_source": f"WITH {_LAST} SELECT * FROM last",
    "job_status_rollup": "SELECT event_type AS status, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "incomplete_sources": f"WITH {_LAST} SELECT source_id FROM last WHERE status = 'view'",
    "failed_pages_latest": "SELECT event_id AS id, user_id AS source_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20",
    "run_report": "SELECT count(*) FILTER (WHERE event_type <> 'error') AS pages, count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) FILTER (WHERE event_type <> 'error') / count(*) * 100, 6) AS success_rate FROM events",
    "rate_limit_schedule": "WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT event_id, round(max(t - i * 3600.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY i) + i * 3600.0::DOUBLE, 3) AS start FROM e",
    "crawl_bfs_depth": _BFS.replace("@", "3") + " SELECT id, min(depth)::BIGINT AS depth FROM bfs GROUP BY id",
    "crawl_max_pages": _best_of_each_depth(5, 30),
    "llm_json_repair": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (props->>'$.k')::BIGINT END AS k FROM events",
    "ontology_partial_extract": "SELECT event_id, event_type AS name, 'concept' AS category, 0.5::DOUBLE AS confidence FROM events UNION ALL SELECT event_id, 'b', 'tool', 0.8::DOUBLE FROM events",
    "ontology_relations": "SELECT event_id, event_type AS from_id, 'b' AS to_id, 'uses' AS type, 0.8::DOUBLE AS confidence FROM events",
    "context_pack_chunks": f"WITH {_TEXT} SELECT doc_id, bm.source, round(score, 6) AS score, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 197) || '...' END AS content FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 10) bm JOIN documents USING (doc_id)",
    "context_pack_concepts": f"WITH {_TEXT}, {_CONC}, hits AS (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 10), first3 AS (SELECT source, max(score) AS s FROM hits GROUP BY 1 ORDER BY s DESC, source LIMIT 3) SELECT id, source_id, name, mention_count FROM conc JOIN first3 ON source = source_id ORDER BY mention_count DESC, id LIMIT 20",
    "preset_estimates": "SELECT 1510::BIGINT AS pages, 50::BIGINT AS min_minutes, 100::BIGINT AS max_minutes",
    "ingest_progress_stream": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
}
