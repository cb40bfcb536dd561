"""Content-addressed ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def generate_id(prefix: str, *parts: Column) -> Column:
    """prefix, an underscore and 12 hex digits of the sha256 of the parts joined by bars; nulls count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 12))


def content_hash(text: Column) -> Column:
    """sha256 of the UTF-8 text, as lowercase hex."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)
