"""Semantic chunking.

Cutting and greedy packing depend on what came before and run per text in an
Arrow pass; overlap, classification and counts are native expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import generate_id


@dataclass(frozen=True)
class ChunkSizes:
    """In tokens of about four characters."""

    target: int = 800
    most: int = 1000
    overlap: int = 100
    absolute: int = 2000


_FENCE = re.compile(r"```.*?```", re.S)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
MIN_DISTANCE = 50


def _tokens(text: str) -> int:
    return len(text) // 4


def split_points(text: str) -> list[int]:
    """Headings, blank lines and ends of sentences at line ends, at least MIN_DISTANCE apart."""
    # The kinds overlap (a blank line may follow a sentence), so each is sought by itself.
    at = [m.start() for m in re.finditer(r"^#{1,6}\s+.+$", text, re.M)]
    at += [m.start() for m in re.finditer(r"\n\n+", text)]
    at += [m.end() for m in re.finditer(r"\.\n", text)]
    kept, last = [], -1
    for p in sorted(at):
        if p > last + MIN_DISTANCE:
            kept.append(p)
            last = p
    return kept


def sentence_pack(text: str, target_chars: int) -> list[str]:
    """Sentences packed greedily; the blanks between them are not counted."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for s in _SENTENCE_END.split(text):
        if size + len(s) > target_chars:
            if size:
                out.append(" ".join(held).strip())
            held, size = [s], len(s)
        elif size:
            held.append(s)
            size += len(s) + 1
        else:
            held, size = [s], len(s)
    if size:
        out.append(" ".join(held).strip())
    return out


def _cut(text: str, most: int) -> list[str]:
    """Windows of an overlong chunk, each up to its last period if that is past the middle; the next starts there."""
    width, out, at = most * 4 - 200, [], 0
    while at < len(text):
        part = text[at : at + width]
        period = part.rfind(".")
        if period > len(part) // 2:
            part = part[: period + 1]
        at += len(part)
        if part.strip():
            out.append(part.strip())
    return out or [text[: most * 4]]


def chunk_text(text: str | None, sizes: ChunkSizes = ChunkSizes()) -> list[str]:
    """Chunks of a text, before overlap."""
    if not text or not text.strip():
        return []
    fences: list[str] = []

    def protect(m: re.Match) -> str:
        fences.append(m[0])
        return f"__CODE_BLOCK_{len(fences) - 1}__"

    guarded = _FENCE.sub(protect, text)
    points = [0, *split_points(guarded), len(guarded)]
    raw = [p for a, b in zip(points, points[1:], strict=False) if (p := guarded[a:b].strip())] if len(points) > 2 else [guarded]
    for k, code in enumerate(fences):
        raw = [r.replace(f"__CODE_BLOCK_{k}__", code) for r in raw]

    sized: list[str] = []
    held = ""
    for r in raw:
        if _tokens(r) > sizes.most:
            sized += [held] * bool(held) + sentence_pack(r, sizes.target * 4)
            held = ""
            continue
        both = f"{held}\n\n{r}" if held else r
        if _tokens(both) > sizes.target:
            sized += [held] * bool(held)
            held = r
        else:
            held = both
    sized += [held] * bool(held)
    return [p for s in sized for p in ([s] if _tokens(s) <= sizes.absolute else _cut(s, sizes.absolute))]


def _exploded(df: DataFrame, key: str, text: str, function) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = [(k, i, c) for k, t in zip(pdf["k"], pdf["t"], strict=True) for i, c in enumerate(function(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "content"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, chunk_index int, content string")


def pack_sentences(df: DataFrame, key: str, text: str, target_chars: int = 3200) -> DataFrame:
    return _exploded(df, key, text, lambda t: sentence_pack(t, target_chars) if t else [])


def raw_chunks(df: DataFrame, key: str, text: str, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """key, chunk_index, content without overlap."""
    return _exploded(df, key, text, lambda t: chunk_text(t, sizes))


def text_split_points(df: DataFrame, key: str, text: str) -> DataFrame:
    out = _exploded(df, key, text, lambda t: map(str, split_points(t or "")))
    return out.select(key, F.col("chunk_index").alias("n"), F.col("content").cast("int").alias("position"))


def finish(raw: DataFrame, key: str, overlap: int = ChunkSizes.overlap) -> DataFrame:
    """Overlap, token count, kind, and approximate character offsets of raw chunks.

    The window is over the chunks of one text, which one row held before.
    """
    order = Window.partitionBy(key).orderBy("chunk_index")
    out = raw.withColumn("content", T.overlapped(F.col("content"), F.lag("content").over(order), overlap)) if overlap > 0 else raw
    start = F.coalesce(F.sum(F.length("content") - overlap * 4).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    out = out.withColumn("start_char", start)
    return out.withColumns(
        {
            "end_char": F.col("start_char") + F.length("content"),
            "token_count": T.token_count(F.col("content")),
            "semantic_type": T.classify_chunk(F.col("content")),
        }
    )


def chunk_documents(df: DataFrame, key: str, text: str, sizes: ChunkSizes = ChunkSizes(), heading: str | None = None) -> DataFrame:
    """Chunks of every text, with ids made from the key and the place."""
    done = finish(raw_chunks(df, key, text, sizes), key, sizes.overlap)
    done = done.withColumn("id", generate_id("chunk", F.col(key), F.col("chunk_index")))
    if heading is None:
        return done.withColumn("heading_context", F.lit(""))
    return done.join(df.select(key, F.col(heading).alias("heading_context")), key)
