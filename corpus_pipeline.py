"""The corpus pipeline: five stages, each on all that its predecessor kept.

A stage is a function of (spark, docs, sf_dir) and gives a DataFrame, which
run() writes as Parquet in the shared folder and reads again as the docs of
the next.  All but the last give the columns of documents; n_chars follows
the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, linededup, neardup, packing, quality
from corpusloom.llm.scratch import drop, materialize, passing

#: Near-dedup by sketches and best-fit packing are not expressible in SQL.
ORACLE_SQL = None


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    metrics = materialize(quality.measured(docs), "quality-metrics")
    cutoffs = materialize(quality.select_cutoffs(metrics, labels), "quality-cutoffs")
    return quality.judged(metrics, cutoffs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten or more of them have."""
    cut = linededup.LineIndex.of(docs, min_docs=10).apply(docs)
    return _with_length(cut.select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that hold a window of a benchmark item."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _with_length(decontam.cut_spans(found).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 2048 ids."""
    return packing.pack(packing.pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _guarded(stage):
    """The stage with columns it doesn't know under names that can't clash with its own."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = [c if c in ("doc_id", "text", "lang", "source", "n_chars") else f"extra_{k}" for k, c in enumerate(names)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*names)

    return run_stage


STAGES = [
    ("quality rules", _guarded(quality_rules)),
    ("line dedup", _guarded(line_dedup)),
    ("MinHash near-dedup", _guarded(near_dedup)),
    ("benchmark decontamination", _guarded(decontaminate)),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; tables that a stage needed for itself go when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(docs)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
