"""Embedding providers: Arrow batches in, float arrays out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Provider = Callable[[list[str]], np.ndarray]


def hashing_provider(dimensions: int = 64) -> Provider:
    """Deterministic bag-of-words vectors: each word adds to a hashed dimension with a hashed sign.

    Half as much goes to one of the first ten, since vectors that have zeros
    there count as failed.
    """

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh3_64_intdigest(w.encode())
                sign = 1 if h >> 63 else -1
                out[k, h % dimensions] += sign
                out[k, (h >> 40) % min(10, dimensions)] += sign / 2
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def embed(df: DataFrame, text: str, provider: Provider | None = None, batch: int = 256, attempts: tuple[float, ...] = (1.0, 0.5, 0.25), most_tokens: int = 7900) -> DataFrame:
    """df with embedding.

    A batch that the provider refuses is tried text by text, each cut to the
    given shares of its length; what fails at all of them gets zeros, which
    is_zero_vector() finds.
    """
    provider = provider or hashing_provider()

    def one(t: str, width: int) -> np.ndarray:
        for share in attempts:
            try:
                return provider([t[: int(len(t) * share)]])[0]
            except Exception:  # noqa: BLE001  a provider may raise anything
                continue
        return np.zeros(width, dtype=np.float32)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows: list[np.ndarray] = []
            given = texts.fillna("").tolist()
            for k in range(0, len(given), batch):
                part = given[k : k + batch]
                try:
                    rows.extend(provider(part))
                except Exception:  # noqa: BLE001
                    width = len(rows[0]) if rows else 64
                    rows.extend(one(t, width) for t in part)
            yield pd.Series(rows)

    vectors = F.pandas_udf(run, "array<float>")
    return df.withColumn("embedding", vectors(T.truncate_tokens(F.col(text), most_tokens)))
