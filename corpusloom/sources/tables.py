"""Schemas of node and edge tables, readers and writers, state tables, presets, settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "sources": "id string, root_url string, domain string, name string, description string, status string, total_pages bigint, created_at timestamp, updated_at timestamp, last_crawled timestamp",
    "pages": "id string, url string, source_id string, title string, description string, content string, content_preview string, content_hash string, language string, depth int, word_count int, crawled_at timestamp, updated_at timestamp",
    "chunks": "id string, page_id string, content string, semantic_type string, heading_context string, embedding array<float>, chunk_index int, token_count int, created_at timestamp, updated_at timestamp",
    "metatags": "id string, page_id string, key string, value string, category string",
    "concepts": "id string, source_id string, name string, description string, category string, confidence double, mention_count bigint, aliases array<string>",
    "links_to": "from_url string, to_url string, anchor_text string",
    "mentions": "chunk_id string, concept_id string, confidence double",
    "relates_to": "from_id string, to_id string, type string, weight double",
    "jobs": "id string, source_id string, status string, error_message string, started_at timestamp, completed_at timestamp, pages_crawled int, pages_failed int",
    "failed_pages": "source_id string, url string, error string, timestamp timestamp",
    "relation_types": "id string, name string, description string, source_concept_type string, target_concept_type string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def create_views(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> int:
    """Register every table as a view, empty where none is given; returns how many."""
    tables = tables or {}
    for name in SCHEMAS:
        df = tables.get(name)
        (df if df is not None else spark.createDataFrame([], schema(name))).createOrReplaceTempView(name)
    return len(SCHEMAS)


def verify_views(spark: SparkSession) -> DataFrame:
    """table, columns: what is registered."""
    known = {t.name for t in spark.catalog.listTables()}
    rows = [(n, len(spark.table(n).columns)) for n in SCHEMAS if n in known]
    return spark.createDataFrame(rows, "table string, columns int")


def health(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A Parquet table; with a known name its schema is not inferred."""
    return (spark.read.schema(schema(name)) if name in SCHEMAS else spark.read).parquet(path)


def run_sql(spark: SparkSession, statement: str, **arguments: object) -> DataFrame:
    """A statement with named parameters (:name), which are never pasted into its text."""
    return spark.sql(statement, args=arguments)


def write_table(df: DataFrame, path: str, mode: str = "append") -> dict[str, int]:
    """Write df as Parquet; rows and null ids written, counted on the way."""
    seen = Observation()
    missing = F.count_if(F.col("id").isNull()) if "id" in df.columns else F.lit(0).cast("long")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), (missing if "id" in df.columns else F.max(missing)).alias("null_ids")).write.mode(mode).parquet(path)
    return {"rows": seen.get["rows"], "null_ids": seen.get["null_ids"] or 0}


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# -------------------------------------------------------------------- state file
STATE_DDL = "sources map<string,struct<name:string,url:string,status:string,pages_crawled:bigint,pages_failed:bigint>>, failed_pages map<string,array<struct<url:string,error:string,timestamp:string>>>"


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sources and failed pages of a JSON state file, as two tables."""
    raw = spark.read.schema(STATE_DDL).option("multiLine", True).json(path)
    sources = raw.select(F.explode("sources").alias("id", "s")).select("id", "s.*")
    failed = raw.select(F.explode("failed_pages").alias("source_id", "f")).select("source_id", F.explode("f").alias("f")).select("source_id", "f.*")
    return sources, failed


def write_state(sources: DataFrame, failed: DataFrame, path: str) -> None:
    """The two tables as one JSON object; both have a row for each source or failed page of a run."""
    s = sources.agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("name", "url", "status", "pages_crawled", "pages_failed")))).alias("sources"))
    per = failed.groupBy("source_id").agg(F.collect_list(F.struct("url", "error", "timestamp")).alias("f"))
    f = per.agg(F.map_from_entries(F.collect_list(F.struct("source_id", "f"))).alias("failed_pages"))
    s.crossJoin(f).write.mode("overwrite").json(path)  # one row each


def incomplete(sources: DataFrame) -> DataFrame:
    return sources.where("status = 'indexing'")


# ----------------------------------------------------------------------- presets
# The catalogue of documentation sites (key, name, url, depth, description, pages).
PRESETS = (
    ("langchain", "LangChain Python", "https://python.langchain.com/docs/", 2, "LangChain framework for LLM applications", 250),
    ("llamaindex", "LlamaIndex", "https://docs.llamaindex.ai/en/stable/", 2, "LlamaIndex data framework for LLM apps", 200),
    ("openai", "OpenAI API", "https://platform.openai.com/docs/", 2, "OpenAI API reference and guides", 150),
    ("nextjs", "Next.js", "https://nextjs.org/docs", 2, "Next.js React framework", 180),
    ("react", "React", "https://react.dev/reference/react", 2, "React library reference", 120),
    ("python-tutorial", "Python Tutorial", "https://docs.python.org/3/tutorial/", 1, "Official Python tutorial", 50),
    ("fastapi", "FastAPI", "https://fastapi.tiangolo.com/", 2, "FastAPI web framework", 100),
    ("pydantic", "Pydantic", "https://docs.pydantic.dev/latest/", 2, "Pydantic data validation", 80),
    ("anthropic", "Anthropic Claude API", "https://docs.anthropic.com/", 2, "Anthropic Claude API documentation", 80),
    ("huggingface", "Hugging Face Transformers", "https://huggingface.co/docs/transformers/", 2, "Hugging Face Transformers library", 300),
)


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "key string, name string, url string, max_depth int, description string, estimated_pages int")


def preset(spark: SparkSession, key: str) -> DataFrame:
    return presets(spark).where(F.col("key") == key.lower())


def estimate_minutes(chosen: DataFrame) -> DataFrame:
    """pages, min_minutes, max_minutes at two to four seconds a page."""
    pages = F.coalesce(F.sum("estimated_pages"), F.lit(0)).cast("long")
    total = chosen.agg(pages.alias("pages"))
    return total.select("pages", F.greatest(F.lit(1), F.expr("pages * 2 div 60")).cast("long").alias("min_minutes"), F.greatest(F.lit(2), F.expr("pages * 4 div 60")).cast("long").alias("max_minutes"))


# ---------------------------------------------------------------------- settings
@dataclass(frozen=True)
class Settings:
    """Bounds are checked when an instance is made."""

    max_depth: int = 2
    rate_limit: float = 1.0
    concurrency: int = 5
    timeout: int = 30
    max_pages: int = 500
    chunk_size: int = 800
    chunk_overlap: int = 100
    threshold: float = 0.7
    dimensions: int = 3072

    def __post_init__(self):
        bounds = {
            "max_depth": (1, 5), "rate_limit": (0.1, 10), "concurrency": (1, 20), "timeout": (5, 120), "max_pages": (10, 5000),
            "chunk_size": (200, 2000), "chunk_overlap": (0, 500), "threshold": (0, 1), "dimensions": (1, 65536),
        }
        for f in fields(self):
            low, high = bounds[f.name]
            if not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} must be between {low} and {high}")
