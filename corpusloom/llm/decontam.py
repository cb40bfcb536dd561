"""Benchmark decontamination: an FM-index for each shard of training texts.

A task gathers documents into a shard of about SHARD_WORDS words, builds the
FM-index of the shard's word sequence and searches the benchmark's windows in
it.  Words that no window has share one symbol, which no search asks for; each
document ends with a separator, so that no occurrence spans two documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .scratch import put_back, set_aside, small_batches, tidy

WINDOW = 8
SHARD_WORDS = 1 << 19
# A slice of the benchmark is one broadcast; a scan searches several slices in one index of each shard.
SLICE_ITEMS = 20_000
SLICE_CHARS = 5_000_000
SCAN_SLICES = 8
_END, _GAP, _OTHER = 0, 1, 2

# Bytes of words: 0-9, letters (lower-cased), all bytes of other characters.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def word_spans(text: bytes) -> np.ndarray:
    """Start and end of every word, in bytes."""
    inside = np.frombuffer(b" " + text.translate(_FOLD) + b" ", dtype=np.uint8) != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges.reshape(-1, 2)


class Phrases:
    """The windows of benchmark items over a small alphabet of their words.

    `symbols` may be shared by several slices, so that one index serves all.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW, symbols: dict[bytes, int] | None = None):
        symbols = {} if symbols is None else symbols
        by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [symbols.setdefault(w, len(symbols) + 3) for w in words(text)]
            if ids:
                n = min(window, len(ids))
                held = by_length.setdefault(n, {})
                for k in range(len(ids) - n + 1):
                    held.setdefault(tuple(ids[k : k + n]), set()).add(item)
        self.patterns = {n: np.array(list(h), dtype=np.int64) for n, h in by_length.items()}
        self.items = {n: [sorted(x, key=str) for x in h.values()] for n, h in by_length.items()}


class _Shard:
    def __init__(self):
        self.rows: list = []
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, row, ids: np.ndarray) -> None:
        self.rows.append((row, self.n, len(ids)))
        self.parts += [ids, np.array([_GAP], dtype=np.int64)]
        self.n += len(ids) + 1

    def search(self, slices: list[Phrases]) -> Iterator[tuple]:
        """(row, words, hit word flags or None, items found) of each document."""
        text = np.concatenate([*self.parts, np.array([_END], dtype=np.int64)])
        starts = np.array([s for _, s, _ in self.rows], dtype=np.int64)
        delta = np.zeros(len(text) + 1, dtype=np.int32)
        found: dict[int, set] = {}
        index = FMIndex(text)
        for phrases in slices:
            for n, patterns in phrases.patterns.items():
                first, last = index.ranges(patterns)
                which = np.flatnonzero(last > first)
                size = last[which] - first[which]
                rows = np.repeat(first[which] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                at = index.locate(rows)
                np.add.at(delta, at, 1)
                np.add.at(delta, at + n, -1)
                doc = np.searchsorted(starts, at, side="right") - 1
                pairs = np.unique(np.stack([doc, np.repeat(which, size)]), axis=1)
                for d, p in pairs.T.tolist():
                    found.setdefault(d, set()).update(phrases.items[n][p])
        hit = np.cumsum(delta)[:-1] > 0
        for d, (row, s, n) in enumerate(self.rows):
            yield row, n, hit[s : s + n] if d in found else None, found.get(d, ())


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[object, bytes | None]]]:
    """Items in parts of a bounded size; a part is all that a task holds of the benchmark."""
    part, chars = [], 0
    rows = benchmark.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        part.append((r["item_id"], bytes(r["text"])))
        chars += len(r["text"])
        if len(part) >= SLICE_ITEMS or chars >= SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


_FOUND = {"_n_words": "long", "_spans": "array<struct<a:bigint,b:bigint,from:bigint,to:bigint>>", "_items": "array<string>"}


def _scan(docs: DataFrame, symbols, slices: list) -> DataFrame:
    """docs with _n_words, _spans (hit words as [start, end) in words and bytes), _items; those of an earlier scan are added to."""
    given = [c for c in docs.columns if c not in _FOUND]
    schema = docs.select(*given, *[F.lit(None).cast(t).alias(c) for c, t in _FOUND.items()]).limit(0).schema
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("from", pa.int64()), ("to", pa.int64())]))

    def search(batches):
        held = [x.value for x in slices]
        known = symbols.value

        def flush(shard: _Shard, columns: list[pa.RecordBatch]):
            n, spans, items = [], [], []
            rows = zip(shard.search(held), (r for b in columns for r in _before(b)), strict=True)
            for (text, n_words, hit, found), (old_spans, old_items) in rows:
                n.append(n_words)
                items.append(sorted({*map(str, found), *old_items}))
                if hit is None:
                    spans.append(old_spans)
                    continue
                hit = hit.astype(np.int8)
                for s in old_spans:
                    hit[s["a"] : s["b"]] = 1
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]))).reshape(-1, 2)
                at = word_spans(text)
                spans.append([{"a": a, "b": b, "from": int(at[a, 0]), "to": int(at[b - 1, 1])} for a, b in edge.tolist()])
            extra = [pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            k = 0
            for batch in columns:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), *(x.slice(k, batch.num_rows) for x in extra)], names=[*given, *_FOUND])
                k += batch.num_rows

        shard, columns = _Shard(), []
        for batch in batches:
            columns.append(batch)
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                got = words(text)
                shard.add(text, np.array([known.get(w, _OTHER) for w in got], dtype=np.int64))
            if shard.n >= SHARD_WORDS:
                yield from flush(shard, columns)
                shard, columns = _Shard(), []
        if columns:
            yield from flush(shard, columns)

    return docs.mapInArrow(tidy(search), schema)


def _before(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Spans and items that an earlier scan found."""
    if "_spans" not in batch.schema.names:
        return (([], []) for _ in range(batch.num_rows))
    return zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), strict=True)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, spans (bytes of the UTF-8 text to remove), item_ids (as strings, sorted).

    Null and empty texts have no words.  Items without words are never found;
    an item of fewer words than the window is one window.  Repeated rows are
    rows of their own.  Input columns n_words, n_hit, spans and item_ids are
    replaced, all others kept, whatever their names.  An empty benchmark finds
    nothing.  The index of a shard is built once for SCAN_SLICES slices of the
    benchmark (which bounds what a task holds of it).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs, given = set_aside(docs, ("doc_id", "text"), ("n_words", "n_hit", "spans", "item_ids"))
    names, out, slices = docs.columns, None, _slices(benchmark)
    while True:
        symbols: dict[bytes, int] = {}
        held = [spark.sparkContext.broadcast(Phrases(part, window, symbols)) for part in islice(slices, SCAN_SLICES)]
        if out is not None and not held:
            break
        out = _scan(docs if out is None else out, spark.sparkContext.broadcast(symbols), held)
    out = out.select(
        *names,
        F.col("_n_words").alias("n_words"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]).alias("n_hit"),
        F.transform("_spans", lambda s: F.struct(s["from"], s["to"])).alias("spans"),
        F.col("_items").alias("item_ids"),
    )
    return put_back(out, given)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of contamination()."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("item_ids") >= 2).alias("contaminated"),
    )


def cut_spans(found: DataFrame) -> DataFrame:
    """Texts without the spans of contamination(); its columns go.

    Spans start and end between characters, so that the stretches between
    them are strings.
    """
    start = "coalesce(get(spans, i - 1)['to'], 0L)"
    stop = "coalesce(get(spans, i)['from'], CAST(length(raw) AS BIGINT))"
    stretch = f"CAST(substring(raw, CAST({start} + 1 AS INT), CAST({stop} - {start} AS INT)) AS STRING)"
    rest = f"get(transform(array(CAST(CAST(text AS STRING) AS BINARY)), raw -> array_join(transform(sequence(0, size(spans)), i -> {stretch}), '')), 0)"
    return found.withColumn("text", F.expr(f"CASE WHEN size(spans) > 0 THEN {rest} ELSE text END")).drop("n_words", "n_hit", "spans", "item_ids")


def items_digest(items: list[str]) -> str:
    """sha256 of sorted item ids joined by commas (used to check digests)."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
