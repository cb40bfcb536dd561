"""Substring dedup by sliding sentence spans.

A run is RUN consecutive sentences, however short; one starts at every sentence
that has enough after it, so the runs of a longer repeated passage cover all of
its sentences.  All runs are hashed (128 bits) and joined globally; of a run
found more than once the first place (least doc_id, then text, then place in
the text) stays, and every sentence inside any other place of it is removed.

A document is what doc_id and text say together: rows that share a doc_id but
not the text are documents of their own, as are rows without a doc_id.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bloom, bloom_hits, drop, materialize, put_back, set_aside, small_batches, tidy

RUN = 2  # sentences
# A sentence ends after . ! or ? before white space, and at a line feed.
_END = re.compile(rb"[.!?]+(?=[\x20\x09-\x0D])|\n")


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Start and end (bytes) of all sentences that have a word; together with blanks between them they are the text."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].split()]


def runs(text: bytes | None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Sentences, and runs: first sentence, one past the last, 128-bit hash of the words as two signed integers."""
    parts = sentences(text or b"")
    joined = [b" ".join((text or b"")[a:b].lower().split()) for a, b in parts]
    out = []
    for i in range(len(parts) - RUN + 1):
        x = xxhash.xxh3_128_digest(b" ".join(joined[i : i + RUN]))
        out.append((i, i + RUN, int.from_bytes(x[:8], "big", signed=True), int.from_bytes(x[8:], "big", signed=True)))
    return parts, out


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _id and _key, which tell documents apart.

    Without a doc_id a second hash of the text stands for it, below all
    ordinary ids.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    instead = F.shiftrightunsigned(F.xxhash64(text, F.lit(1)), 2) + F.lit(-(1 << 63))
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), instead), "_key": F.xxhash64(text)})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """_id, _key, first, last: sentences [first, last) of a document inside a non-first place of a repeated run."""
    small_batches(docs.sparkSession)
    given = _keyed(docs).select("_id", "_key", F.col("text").cast("string"))
    names = ["_id", "_key", "first", "last", "high", "low"]

    def every(batches, bitmap=None):
        for batch in batches:
            per = [runs(t)[1] for t in _texts(batch)]
            x = np.array([r for found in per for r in found], dtype=np.int64).reshape(-1, 4)
            if not len(x):
                continue
            row = np.repeat(np.arange(len(per)), [len(found) for found in per])
            if bitmap is not None:
                near = bloom_hits(bitmap.value, x[:, 3])
                x, row = x[near], row[near]
            held = [batch.column(c).take(pa.array(row)) for c in ("_id", "_key")]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(x[:, k]) for k in range(4))], names=names)

    schema = "_id long, _key long, first long, last long, high long, low long"
    # Repeated rows (one doc_id, one text) are the same place, so places are counted as distinct.
    place = F.struct("_id", "_key", "first")
    found = given.mapInArrow(tidy(every), schema).groupBy("high", "low").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most")
    again = materialize(found.select("high", "low", "least"), "repeated-runs")
    held = docs.sparkSession.sparkContext.broadcast(bloom(again, "low", again.count()))
    near = given.mapInArrow(tidy(lambda batches: every(batches, held)), schema)
    hits = near.join(again, ["high", "low"]).where(place != F.col("least")).select("_id", "_key", "first", "last")
    out = materialize(hits.distinct(), "span-hits")
    drop(again)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with text cut, and n_sentences, n_removed (long).

    Sentences inside a non-first place of a repeated run go, with the white
    space up to the next sentence.  Null and empty texts have no sentences and
    stay as they are.  Rows equal in doc_id and text are one document and stay
    alike; rows that share only a doc_id, or have none, are documents of their
    own, the latter before all others.  Input columns n_sentences and
    n_removed are replaced, all others kept, whatever their names.
    """
    docs, given = set_aside(docs, ("doc_id", "text"), ("n_sentences", "n_removed"))
    hits = repeated_spans(docs)
    ids = hits.select("_key").distinct()
    held = docs.sparkSession.sparkContext.broadcast(bloom(ids, "_key", ids.count()))
    per = hits.groupBy("_id", "_key").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))  # at most a document's sentences
    marked = _keyed(docs)
    names = docs.columns
    empty = F.lit(None).cast("array<struct<first:bigint,last:bigint>>")

    def mark(batches):
        for batch in batches:
            yield batch.append_column("_touched", pa.array(bloom_hits(held.value, batch.column("_key").to_numpy())))

    marked = marked.mapInArrow(mark, marked.limit(0).withColumn("_touched", F.lit(True)).schema)
    touched = marked.where("_touched").join(per, ["_id", "_key"], "left").select(*names, "_spans")
    rest = marked.where("NOT _touched").select(*names, empty.alias("_spans"))

    def cut(batches):
        for batch in batches:
            texts, total, gone = batch.column("text").to_pylist(), [], []
            for k, (raw, spans) in enumerate(zip(_texts(batch), batch.column("_spans").to_pylist(), strict=True)):
                parts = sentences(raw or b"")
                total.append(len(parts))
                out = np.zeros(len(parts) + 1, dtype=np.int64)
                for s in spans or ():
                    out[s["first"]] += 1
                    out[s["last"]] -= 1
                out = np.cumsum(out)[:-1] > 0
                gone.append(int(out.sum()))
                if gone[-1]:
                    ends = [parts[i + 1][0] if i + 1 < len(parts) else len(raw) for i in range(len(parts))]
                    texts[k] = (raw[: parts[0][0]] + b"".join(raw[a:e] for (a, _), e, o in zip(parts, ends, out, strict=True) if not o)).decode()
            columns = [pa.array(texts, f.type) if f.name == "text" else batch.column(f.name) for f in batch.schema if f.name != "_spans"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_sentences", "n_removed"])

    schema = docs.limit(0).withColumn("n_sentences", F.lit(0).cast("long")).withColumn("n_removed", F.lit(0).cast("long")).schema
    return put_back(touched.mapInArrow(tidy(cut), schema).unionByName(rest.mapInArrow(tidy(cut), schema)), given)
