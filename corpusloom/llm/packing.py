"""Best-fit-decreasing packing, certified by dual-feasible lower bounds.

Pieces are dealt evenly over partitions, and each is packed by best-fit
decreasing on its own.  Dual-feasible functions bound from below the sequences
that its pieces can need, which certifies its count.  Partitions whose count
is above their bound give the pieces of their open sequences away: these are
dealt among as many groups as hold them, all packed again at the same time,
and the new packing is kept if it takes fewer sequences.  It ends when every
partition is certified, or all together are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize, small_batches, tidy
from .tokens import END_ID, encoder

CAPACITY = 2048
PER_PARTITION = 200_000  # pieces packed by one task
ROUNDS = 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, free long, sequences long, bound long"


# ------------------------------------------------------------ bounds, packing
def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that items need at least; counts[s] items have size s.

    The greatest of the sums of dual-feasible functions: u(k) of Fekete and
    Schepers for k up to 20 (k = 1 counts halves) and the threshold function
    for every size up to half.  All in integers.
    """
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > 0]
    n = counts[sizes].astype(object)
    if not len(sizes):
        return 0
    total = int((sizes.astype(object) * n).sum())
    best = -(-total // capacity)
    for k in range(1, 21):
        whole = (k + 1) * sizes % capacity == 0
        value = np.where(whole, k * sizes, (k + 1) * sizes // capacity * capacity).astype(object)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    wide = np.zeros(capacity + 2, dtype=np.int64)
    wide[sizes] = counts[sizes]
    items, volume = np.cumsum(wide), np.cumsum(wide * np.arange(capacity + 2))
    for least in range(capacity // 2 + 1):  # over capacity - least: 1; under least: 0
        large = int(items[capacity] - items[capacity - least])
        middle = int(volume[capacity - least] - (volume[least - 1] if least else 0))
        best = max(best, large + -(-middle // capacity))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit for items in the given (decreasing) order: sequence, offset of each; free space of each sequence."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    some = 0  # bit r: a sequence with r free places exists
    for k, s in enumerate(sizes.tolist()):
        fits = some >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            b, r = len(free), capacity
            free.append(capacity)
        sequence[k], offset[k] = b, capacity - r
        free[b] = left = r - s
        if left:
            if not room[left]:
                some |= 1 << left
            room[left].append(b)
    return sequence, offset, np.array(free, dtype=np.int64)


# --------------------------------------------------------------------- Spark
def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids of every text (null: empty) and its end id.

    Only longer documents are cut; the first piece takes the remainder.  With
    with_ids a column ids (little-endian unsigned 32-bit) follows.
    """
    small_batches(docs.sparkSession)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            ids, ends = enc.batch(batch.column("text"))
            raw, out = memoryview(ids).cast("B"), []
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                data = bytes(raw[4 * ends[k] : 4 * ends[k + 1]]) + end
                n = len(data) // 4
                a, b = 0, (n - 1) % capacity + 1
                piece = 0
                while a < n:
                    part = data[4 * a : 4 * b]
                    out.append((doc_id, piece, a, b - a, zlib.crc32(part)) + (part,) * with_ids)
                    a, b, piece = b, b + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)

    schema = PIECES + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(cut), schema)


def _packed(df: DataFrame, partitions: int, turn: int, capacity: int) -> DataFrame:
    """Deal evenly, pack each partition, add its certificate (sequences, bound)."""

    def pack(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        length = t.column("length").to_numpy()
        ids, piece = (t.column(c).fill_null(-1).to_numpy() for c in ("doc_id", "piece"))
        crc = t.column("ids_crc32").to_numpy()
        order = np.lexsort((crc, piece, ids, -length))  # a rerun of the task finds the same packing
        sequence, offset, free = best_fit(length[order], capacity)
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        base = turn << 56 | TaskContext.get().partitionId() << 32
        t = t.take(pa.array(order))
        for name, x in (("sequence_id", base + sequence), ("offset", offset), ("free", free[sequence]), ("sequences", np.full(len(order), len(free))), ("bound", np.full(len(order), bound))):
            t = t.append_column(name, pa.array(x.astype(np.int64)))
        yield from t.to_batches(max_chunksize=20_000)

    dealt = df.repartition(partitions, F.xxhash64("doc_id", "piece", F.lit(turn)))
    return dealt.mapInArrow(tidy(pack), PACKED)


def pack(cut: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """Places for pieces(): each gets sequence_id and offset, sequences have no gaps.

    Also returned: free (places left in the sequence) and the certificate of
    the partition that packed it (sequences it took, bound: what it needs at
    least).  Empty input gives an empty result; repeated rows are packed as
    rows of their own.
    """
    cut = materialize(cut.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in cut.groupBy("length").count().collect():  # at most capacity rows
        histogram[r["length"]] = r["count"]
    n, needed = int(histogram.sum()), lower_bound(histogram, capacity)
    packed = materialize(_packed(cut, max(1, -(-n // per_partition)), 0, capacity), "packed")
    drop(cut)
    # Every sequence has one piece at offset 0.
    gap = (F.col("sequences") > F.col("bound")) & (F.col("free") > 0)
    first, home = F.col("offset") == 0, F.shiftright("sequence_id", 32)
    for turn in range(1, rounds + 1):
        r = packed.agg(F.count_if(first).alias("used"), F.count_if(gap & first).alias("open"), F.count_if(gap).alias("pieces"), F.countDistinct(F.when(gap, home)).alias("homes")).first()
        if r["used"] <= needed or r["homes"] < 2:
            break
        given = packed.where(gap).select("doc_id", "piece", "start", "length", "ids_crc32")
        again = materialize(_packed(given, max(1, -(-r["pieces"] // per_partition)), turn, capacity), "packed")
        if again.where(first).count() >= r["open"]:
            drop(again)
            break
        packed = packed.where(~gap).unionByName(again)
    return packed


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (pieces end to end).

    A sequence has at most capacity pieces, so the group is bounded.
    """
    held = pieces(docs, capacity, vocabulary, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids")
    key = ["doc_id", "piece", "ids_crc32"]
    held = held.dropDuplicates(key)
    joined = packed.alias("p").join(held.alias("h"), [F.col(f"p.{c}").eqNullSafe(F.col(f"h.{c}")) for c in key]).select("sequence_id", "offset", "ids")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return joined.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
