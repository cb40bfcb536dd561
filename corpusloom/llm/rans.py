"""Token ids as files of static range-asymmetric-numeral-system blocks.

File format (a Parquet folder, one row a block, so that Spark's commit
protocol makes the write atomic and a lost executor costs one task):

* ``shard`` (partition << 20 | number in it) and ``block`` order the blocks;
  a shard holds whole documents in ascending doc_id order and has one shared
  frequency table, which every block repeats (about 2 per cent of its bytes).
* ``doc_ids``, ``doc_tokens``: the documents of the block; ``start``: tokens
  of the partition before the block.
* ``payload``: the bytes of one interleaved rANS stream: header, the state of
  every lane, checkpoints (step, word position, lane states), 32-bit words.
* ``crc``: unsigned crc32 of the payload, checked before decoding.

A block decodes by itself, and within it any stretch from a checkpoint; a
document longer than a block is one block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, small_batches, tidy
from .tokens import END_ID, encoder

SCALE_BITS = 20
_LOW = np.uint64(1 << 31)
LANES = 1024
BLOCK_TOKENS = 1 << 19
SHARD_TOKENS = 1 << 23
CHECKPOINT_STEPS = 256
_HEAD = struct.Struct("<4sIIIII")  # magic, tokens, lanes, steps, checkpoints, words
_MAGIC = b"RNS1"

FILE_SCHEMA = (
    "shard long, block int, start long, doc_ids array<long>, doc_tokens array<long>, n_tokens long,"
    " table binary, payload binary, crc long"
)


# ------------------------------------------------------------------- coding
def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE_BITS, at least 1 for each symbol that occurs."""
    total = 1 << SCALE_BITS
    present = np.flatnonzero(counts)
    exact = counts[present] * (total / counts.sum())
    scaled = np.maximum(1, np.floor(exact)).astype(np.int64)
    while (gap := total - int(scaled.sum())) != 0:
        if gap > 0:
            for k in np.argsort(-(exact - scaled), kind="stable")[:gap]:
                scaled[k] += 1
        else:  # take from the largest, which lose least by it
            order = np.argsort(-scaled, kind="stable")
            order = order[scaled[order] > 1][: -gap]
            scaled[order] -= 1
    out = np.zeros(len(counts), dtype=np.uint32)
    out[present] = scaled
    return out


def table_bytes(freq: np.ndarray) -> bytes:
    present = np.flatnonzero(freq)
    body = np.concatenate([present.astype("<u4"), freq[present].astype("<u4")])
    return zlib.compress(struct.pack("<I", len(present)) + body.tobytes(), 6)


def table_from(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    body = np.frombuffer(raw, dtype="<u4", offset=4)
    freq = np.zeros(int(body[n - 1]) + 1 if n else 1, dtype=np.uint32)
    freq[body[:n]] = body[n:]
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray) -> bytes:
    """One interleaved stream; ids must occur in the table."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    grid = np.full(lanes * steps, ids[-1] if n else 0, dtype=np.int64)
    grid[:n] = ids
    starts = np.concatenate([[0], np.cumsum(freq.astype(np.uint64))[:-1]]).astype(np.uint64)
    fs = freq.astype(np.uint64)[grid].reshape(steps, lanes)
    cs = starts[grid].reshape(steps, lanes)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    out, saved, written = [], [], 0
    up, shift, scale = np.uint64(63 - SCALE_BITS), np.uint64(32), np.uint64(SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        f = fs[t]
        full = np.flatnonzero(state >= (f << up))
        if len(full):
            high = state[full]
            out.append(high.astype(np.uint32))
            written += len(full)
            state[full] = high >> shift
        q = state // f
        state = (q << scale) + (state - q * f) + cs[t]
        if t and t % CHECKPOINT_STEPS == 0:
            saved.append((t, written, state.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    parts = [_HEAD.pack(_MAGIC, n, lanes, steps, len(saved), len(words)), state.astype("<u8").tobytes()]
    for t, so_far, x in reversed(saved):
        parts.append(struct.pack("<II", t, len(words) - so_far) + x.astype("<u8").tobytes())
    parts.append(words.astype("<u4").tobytes())
    return b"".join(parts)


def decode_block(payload: bytes, freq: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """ids[first:last] of a block, from the last checkpoint before first."""
    magic, n, lanes, steps, checkpoints, n_words = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a block of this format")
    last = n if last is None else min(last, n)
    at = _HEAD.size
    state = np.frombuffer(payload, "<u8", lanes, at).astype(np.uint64)
    at += 8 * lanes
    t0, pos = 0, 0
    for _ in range(checkpoints):
        t, so_far = struct.unpack_from("<II", payload, at)
        if t * lanes <= first:
            t0, pos, state = t, so_far, np.frombuffer(payload, "<u8", lanes, at + 8).astype(np.uint64)
        at += 8 + 8 * lanes
    words = np.frombuffer(payload, "<u4", n_words, at).astype(np.uint64)
    wide = freq.astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(wide)[:-1]]).astype(np.uint64)
    symbols = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    t1 = min(steps, -(-last // lanes))
    out = np.empty((max(0, t1 - t0), lanes), dtype=np.uint32)
    mask, scale, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    for t in range(t0, t1):
        slot = state & mask
        s = symbols[slot]
        out[t - t0] = s
        state = wide[s] * (state >> scale) + slot - starts[s]
        low = np.flatnonzero(state < _LOW)
        if len(low):
            state[low] = (state[low] << shift) | words[pos : pos + len(low)]
            pos += len(low)
    return out.ravel()[first - t0 * lanes : last - t0 * lanes]


# -------------------------------------------------------------------- files
class _ShardWriter:
    """Gathers whole documents and turns them into the blocks of a shard."""

    def __init__(self, partition: int):
        self.partition, self.number, self.before = partition, 0, 0
        self._reset()

    def _reset(self):
        self.docs, self.sizes, self.ids, self.n = [], [], [], 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.ids.append(ids.astype(np.uint32))
        self.n += len(ids)

    def rows(self):
        if not self.docs:
            return
        every = np.concatenate(self.ids)
        freq = frequency_table(np.bincount(every))
        table = table_bytes(freq)
        shard = self.partition << 20 | self.number
        ends = np.cumsum(self.sizes)
        d0, block = 0, 0
        while d0 < len(self.docs):
            t0 = int(ends[d0 - 1]) if d0 else 0
            d1 = min(len(self.docs), max(d0 + 1, int(np.searchsorted(ends, t0 + BLOCK_TOKENS, side="right"))))
            t1 = int(ends[d1 - 1])
            payload = encode_block(every[t0:t1], freq)
            yield shard, block, self.before + t0, self.docs[d0:d1], self.sizes[d0:d1], t1 - t0, table, payload, zlib.crc32(payload)
            d0, block = d1, block + 1
        self.before += len(every)
        self.number += 1
        self._reset()


_ARROW = pa.schema(
    [
        ("shard", pa.int64()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("table", pa.binary()), ("payload", pa.binary()), ("crc", pa.int64()),
    ]
)


def _as_batch(row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


def write_token_files(docs: DataFrame, path: str, partitions: int | None = None, vocabulary: str | None = None) -> None:
    """Encode every text (null: empty) and write blocks in ascending doc_id order.

    The only shuffle deals whole texts into ranges of doc_id.  A task holds
    one shard (SHARD_TOKENS ids, or one longer document) at a time.  Rows with
    the same doc_id stay next to each other, ordered by text; a null doc_id
    sorts first.  Other columns are not read.  An empty table writes no block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        made = _ShardWriter(TaskContext.get().partitionId())
        enc = encoder(vocabulary)
        for batch in batches:
            ids, ends = enc.batch(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                made.add(doc_id, np.append(ids[ends[k] : ends[k + 1]], np.uint32(END_ID)))
                if made.n >= SHARD_TOKENS:
                    yield from map(_as_batch, made.rows())
        yield from map(_as_batch, made.rows())

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(encode), FILE_SCHEMA).write.option("compression", "uncompressed").option("parquet.block.size", str(8 << 20)).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) from the files alone."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy(F.shiftright("shard", 20).alias("p")).agg(F.sum("n_tokens").alias("n")).orderBy("p").collect()  # a row for each partition of the writer
    before, at = {}, 0
    for r in totals:
        before[r["p"]] = at
        at += r["n"]

    def decode(batches):
        last, freq = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["payload"]) != r["crc"]:
                    raise ValueError(f"block {r['block']} of shard {r['shard']} is damaged")
                if r["table"] != last:
                    last, freq = r["table"], table_from(r["table"])
                ids = decode_block(r["payload"], freq)
                ends = np.concatenate([[0], np.cumsum(r["doc_tokens"])])
                start = before[r["shard"] >> 20] + r["start"]
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(start + ends[:-1], pa.int64()),
                        pa.array(r["doc_tokens"], pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(tidy(decode), "doc_id long, start long, n_tokens long, ids binary")


def token_digests(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    path = path or new_path(spark, "tokens")
    write_token_files(docs, path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
