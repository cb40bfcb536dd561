"""Concept extraction and chunk classification behind providers.

A provider takes a list of prompts and gives a reply for each; it may raise.
Replies are repaired and parsed by native expressions, and only rows whose
reply is not JSON are asked again.
"""

from __future__ import annotations

import json
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import generate_id
from . import graph as G
from . import store as K

Extractor = Callable[[list[str]], list[str]]
Classifier = Callable[[list[str]], list[dict]]

MIN_CONTENT = 100  # shorter pages are not sent
ATTEMPTS = 3
JSON_ONLY = "\n\nReply with one JSON object and nothing else."
EXTRACTED = "extracted"
# How errors of an attempt begin, and what a chunk is when no classifier tells.
FAILED, NO_JSON = "Extraction error (attempt {})", "JSON parse error (attempt {})"
DEFAULT_CLASS = {"semantic_type": "general", "confidence": 0.5, "complexity": "intermediate"}


def term_extractor(most: int = 10, length: int = 4) -> Extractor:
    """Deterministic stand-in for a model: the commonest terms of the content, the first related to all others."""

    def reply(prompt: str) -> str:
        content = prompt.partition("\n\nContent:\n")[2].removesuffix(JSON_ONLY)
        counted = Counter(w for w in re.findall(r"[^\W_]+", content.lower()) if len(w) >= length)
        names = [w for w, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:most]]
        concepts = [{"name": n, "category": "concept", "confidence": 0.8} for n in names]
        relations = [{"from": names[0], "to": n, "type": "related_to", "confidence": 0.5} for n in names[1:]]
        return json.dumps({"concepts": concepts, "relationships": relations}, ensure_ascii=False)

    return lambda prompts: [reply(p) for p in prompts]


def _asked(extractor: Extractor, attempt: int, backoff: float, batch: int):
    """A column function: prompt (null: not asked) -> reply and error of one attempt."""

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return extractor([prompt])[0], None
        except Exception as e:  # noqa: BLE001  a provider may raise anything
            # Providers that ask for patience get four times as much.
            time.sleep(backoff * 2**attempt * (4 if re.search("rate|limit", str(e).lower()) else 1))
            return None, str(e)[:100]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            out = pd.DataFrame({"reply": [None] * len(prompts), "error": [None] * len(prompts)}, dtype=object)
            at = [k for k, p in enumerate(prompts) if p is not None and p == p]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                asked = [prompts.iloc[i] for i in part]
                try:
                    got = [(r, None) for r in extractor(asked)]
                except Exception:  # noqa: BLE001
                    got = [one(p) for p in asked]
                for i, (r, e) in zip(part, got, strict=True):
                    out.iloc[i, 0], out.iloc[i, 1] = r, e
            yield out

    return F.pandas_udf(run, "reply string, error string").asNondeterministic()


def extract(pages: DataFrame, extractor: Extractor, attempts: int = ATTEMPTS, backoff: float = 0.0, batch: int = 16) -> DataFrame:
    """pages (with title and content) and: extracted (concepts, relationships), errors (array), attempts.

    Pages of fewer than MIN_CONTENT characters are not sent and have an empty
    result.  A reply that is no JSON after repair, or an exception, is an
    error and the page is asked again, up to `attempts` times; a page never
    fails the batch.
    """
    prompt = F.when(F.length("content") >= MIN_CONTENT, T.ontology_prompt(F.col("title"), F.col("content")))
    out = pages.withColumns({"_json": F.lit(None).cast("string"), "_errors": F.expr("CAST(array() AS array<string>)"), "_tries": F.lit(0)})
    for k in range(attempts):
        ask = F.when(F.col("_json").isNull(), F.concat(prompt, F.lit(JSON_ONLY)) if k else prompt)
        out = out.withColumn("_got", _asked(extractor, k, backoff, batch)(ask))
        wanted = F.col("_json").isNull() & (F.coalesce(F.length("content"), F.lit(0)) >= MIN_CONTENT)
        repaired = T.repair_json(F.col("_got.reply"))
        message = F.when(F.col("_got.error").isNotNull(), F.concat(F.lit(f"{FAILED.format(k + 1)}: "), F.col("_got.error"))).otherwise(F.lit(NO_JSON.format(k + 1)))
        failed = wanted & (F.col("_got.error").isNotNull() | repaired.isNull())
        out = out.withColumns(
            {
                "_errors": F.when(failed, F.concat("_errors", F.array(message))).otherwise(F.col("_errors")),
                "_tries": F.col("_tries") + wanted.cast("int"),
                "_json": F.coalesce("_json", F.when(F.col("_got.error").isNull(), repaired)),
            }
        )
    return out.withColumns({EXTRACTED: T.parse_ontology(F.col("_json")), "errors": F.col("_errors"), "attempts": F.col("_tries")}).drop("_json", "_errors", "_tries", "_got")


def concepts_and_relations(extracted: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """Concepts (upserted in the order of seq) and relations whose ends the same page names.

    extracted has source_id and the result of extract().
    """
    concept_id = lambda name: generate_id("concept", F.col("source_id"), F.lower(name))
    page = F.col(seq).cast("decimal(20,0)") * 1_000_000
    one = extracted.select("source_id", page.alias("_page"), F.posexplode(f"{EXTRACTED}.concepts").alias("_at", "c"))
    rows = one.select(concept_id(F.col("c.name")).alias("id"), "source_id", "c.*", F.lit(1).cast("long").alias("mention_count"), (F.col("_page") + F.col("_at")).alias("seq"))
    concepts = K.merge(rows, ["id"], {"source_id": K.KEEP} | K.CONCEPT_POLICY)
    named = lambda c, end: F.lower(c["name"]) == F.lower(end)
    rel = extracted.select("source_id", page.alias("_page"), F.col(f"{EXTRACTED}.concepts").alias("k"), F.posexplode(f"{EXTRACTED}.relationships").alias("_at", "r"))
    known = rel.where(F.exists("k", lambda c: named(c, F.col("r.from"))) & F.exists("k", lambda c: named(c, F.col("r.to"))))
    edges = known.select(
        concept_id(F.col("r.from")).alias("from_id"), concept_id(F.col("r.to")).alias("to_id"), F.col("r.type").alias("type"), F.col("r.confidence").alias("weight"), (F.col("_page") + F.col("_at")).alias("seq")
    )
    return concepts, G.merge_relations(edges, "seq")


def classify(chunks: DataFrame, text: str, classifier: Classifier, most: int = 2000) -> DataFrame:
    """chunks with classified (semantic_type, confidence, complexity); what the classifier refuses gets DEFAULT_CLASS."""

    def one(prompt: str) -> dict:
        try:
            return DEFAULT_CLASS | classifier([prompt])[0]
        except Exception:  # noqa: BLE001
            return DEFAULT_CLASS

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            given = prompts.fillna("").tolist()
            try:
                got = [DEFAULT_CLASS | x for x in classifier(given)]
            except Exception:  # noqa: BLE001
                got = [one(p) for p in given]
            yield pd.DataFrame(got, columns=list(DEFAULT_CLASS))

    return chunks.withColumn("classified", F.pandas_udf(run, "semantic_type string, confidence double, complexity string")(F.substring(text, 1, most)))


def mentions_alternate(chunks: DataFrame, concepts: DataFrame, key: str, text: str) -> DataFrame:
    """The alternate linking: at most 500 concepts of a source, names of more than two characters, confidence 0.8."""
    return G.mentions(chunks, concepts.drop("aliases").where(F.length("name") > 2), key, text, confidence=0.8, most=500)
