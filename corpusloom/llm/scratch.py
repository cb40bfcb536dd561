"""Shared-folder tables and size-bounded Bloom bitmaps used by the operators.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` (the
folder all executors share).  The setting is read from the session; where it
is unset in local mode (tests, notebooks) a folder for this process is made.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder in spark.checkpoint.dir, or (in local mode only) one of our own where that is unset."""
    global _own
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch: whole texts must fit a Python worker.

    The limits are the session's, there are none of a plan.  All operators
    ask for the same ones, and a lower limit set by the caller stays.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):  # unlimited, or more
            spark.conf.set(name, str(most))


def set_aside(docs: DataFrame, reads: tuple[str, ...], replaced: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns an operator doesn't read under names that can't clash with its own.

    `replaced` ones, which the operator makes anew, go.  The second value is
    for put_back().
    """
    plain = [c if c in reads else f"_given{k}" for k, c in enumerate(docs.columns)]
    gone = {p for p, c in zip(plain, docs.columns, strict=True) if c in replaced and p != c}
    return docs.toDF(*plain).drop(*gone), {p: c for p, c in zip(plain, docs.columns, strict=True) if p not in gone}


def put_back(out: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under the names they were given."""
    return out.toDF(*[names.get(c, c) for c in out.columns])


def tidy(work):
    """work (an Arrow batch function) with freed memory given back to the system at its end.

    Python workers outlive their tasks and wait for the next one; what they
    don't use would count against the executor meanwhile.
    """

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return run


_made: list[str] = []  # tables that are not deleted yet


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder for a table that passing() may delete."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing will read again."""
    _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _made:
        _made.remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables made inside are deleted at the end, but for those put in the list.

    For callers that have written a result: what is lazy still reads them.
    """
    before, keep = set(_made), []
    yield keep
    stays = {df.scratch_path for df in keep}
    for path in [p for p in _made if p not in before and p not in stays]:
        _delete(spark, path)


# --------------------------------------------------------------------- Bloom
MAX_BLOOM_BITS = 1 << 26  # 8 MB: what is broadcast never exceeds this
_BLOCK = 1 << 16


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each 64-bit key."""
    x = keys.astype(np.int64).view(np.uint64)
    a = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    b = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return np.stack([a >> shift, b >> shift]).astype(np.int64)


def bloom(df: DataFrame, column: str, rows: int) -> np.ndarray:
    """Bitmap (uint8) of a long column; at most MAX_BLOOM_BITS whatever the input.

    The bitmap only thins out rows before an exact join, so that false
    positives cost time and never change a result.
    """
    bits = _BLOCK
    while bits < min(MAX_BLOOM_BITS, 16 * max(1, rows)):
        bits *= 2

    def place(batches):
        for pdf in batches:
            pos = np.unique(_positions(pdf["key"].to_numpy(), bits).ravel())
            yield pd.DataFrame({"block": pos // _BLOCK, "bit": pos % _BLOCK})

    def gather(pdf):
        bitmap = np.zeros(_BLOCK, dtype=np.uint8)
        bitmap[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bitmap": [np.packbits(bitmap, bitorder="little").tobytes()]})

    keys = df.select(F.col(column).cast("long").alias("key")).where("key is not null")
    placed = keys.mapInPandas(place, "block long, bit long").distinct()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in placed.groupBy("block").applyInPandas(gather, "block long, bitmap binary").collect():  # bits / 8 bytes in all
        out[r["block"] * _BLOCK // 8 : (r["block"] + 1) * _BLOCK // 8] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    return out


def bloom_hits(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set."""
    pos = _positions(keys, len(bitmap) * 8)
    found = (bitmap[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1
    return (found[0] & found[1]).astype(bool)
