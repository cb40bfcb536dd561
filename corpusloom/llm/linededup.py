"""Line dedup with exact reference counts and sharded cuckoo filters.

State: a table of reference counts (line key -> documents that have it) and,
for each shard of keys, a cuckoo filter of the keys that are blocked (found in
at least min_docs documents).  insert() and delete() change counts by +1 and
-1 for each document and move keys into and out of the filters, so that taking
a document away undoes what adding it did.

apply() drops the lines with blocked keys.  Filters settle nearly all lines;
the few that pass are confirmed against the exact keys.  Up to
MAX_BROADCAST_KEYS blocked keys, filters and keys go to every task; beyond
that, line keys that a bitmap of bounded size lets pass are dealt to the
filter of their shard, and what passes it to the exact keys.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuckoo import CuckooFilter
from .scratch import bloom, bloom_hits, materialize, put_back, set_aside, small_batches, tidy

SPACE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 500_000
MAX_BROADCAST_KEYS = 1_000_000  # blocked keys: two arrays of 8 MB, and 2.5 to 5 MB of filters
PARTS = 8  # tasks that probe one shard's filter
COUNTS = "high long, low long, n_docs long"
_M64 = (1 << 64) - 1


def line_key(line: bytes, least: int = 1) -> bytes | None:
    """The key of a line, or None where it has fewer than `least` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or least > 1 and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _keys(text: bytes, least: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if (k := line_key(line, least)) is not None}


def _hashed(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    high, low = x >> 64, x & _M64
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def line_counts(docs: DataFrame, least: int = 1) -> DataFrame:
    """high, low, n_docs: documents (rows) in which each key is found."""

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for text in _texts(batch):
                found.update(_keys(text, least))
            if found:
                keys = np.array([_hashed(k) for k in found], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(found.values()), pa.int64())], names=["high", "low", "n_docs"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string")).mapInArrow(tidy(count), COUNTS)
    return rows.groupBy("high", "low").agg(F.sum("n_docs").alias("n_docs"))


class LineIndex:
    """Reference counts and filters; every change gives a new index."""

    def __init__(self, spark: SparkSession, counts: DataFrame, min_docs: int = 10, least: int = 1, shards: int | None = None):
        self.spark, self.counts, self.min_docs, self.least = spark, counts, min_docs, least
        self.blocked = materialize(counts.where(F.col("n_docs") >= min_docs).select("high", "low"), "blocked-lines")
        self.n_blocked = self.blocked.count()
        self.shards = shards or max(1, -(-self.n_blocked // SHARD_KEYS))
        self.filters = self._filters()

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = 10, least: int = 1) -> LineIndex:
        counts = materialize(line_counts(docs, least), "line-counts")
        return cls(docs.sparkSession, counts, min_docs, least)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = line_counts(docs, self.least).withColumn("n_docs", F.col("n_docs") * sign)
        both = self.counts.unionByName(delta).groupBy("high", "low").agg(F.sum("n_docs").alias("n_docs"))
        counts = materialize(both.where("n_docs > 0"), "line-counts")
        return self._moved(counts)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Count the lines of these documents."""
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Undo insert() of these documents (their texts are needed)."""
        return self._changed(docs, -1)

    def _moved(self, counts: DataFrame) -> LineIndex:
        """The index of new counts: keys that crossed min_docs move in or out of this one's filters."""
        out = object.__new__(LineIndex)
        out.spark, out.counts, out.min_docs, out.least, out.shards = self.spark, counts, self.min_docs, self.least, self.shards
        out.blocked = materialize(counts.where(F.col("n_docs") >= self.min_docs).select("high", "low"), "blocked-lines")
        out.n_blocked = out.blocked.count()
        if out.n_blocked > 2 * SHARD_KEYS * out.shards:
            out.shards = -(-out.n_blocked // SHARD_KEYS)
            out.filters = out._filters()
            return out
        new = out.blocked.join(self.blocked, ["high", "low"], "left_anti").withColumn("added", F.lit(True))
        gone = self.blocked.join(out.blocked, ["high", "low"], "left_anti").withColumn("added", F.lit(False))
        moves = self._sharded(new.unionByName(gone)).select("shard", "high", "low", "added", F.lit(None).cast("binary").alias("filter"))
        old = self.filters.select("shard", F.lit(None).cast("long").alias("high"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("boolean").alias("added"), "filter")
        exact = self._sharded(out.blocked)

        def change(key, pdf):
            held = pdf["filter"].dropna()
            f = CuckooFilter.from_bytes(held.iloc[0]) if len(held) else CuckooFilter.build(np.zeros(0, np.int64), np.zeros(0, np.int64))
            rows = pdf[pdf["high"].notna()]
            added = rows["added"].astype(bool).to_numpy()
            high, low = rows["high"].astype("int64").to_numpy(), rows["low"].astype("int64").to_numpy()
            f.delete(high[~added], low[~added])
            full = not f.insert(high[added], low[added])
            return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()], "full": [full]})

        # As strings: pandas has no 64-bit integers beside nulls.
        typed = moves.unionByName(old).select("shard", *[F.col(k).cast("string").alias(k) for k in ("high", "low")], "added", "filter")
        changed = materialize(typed.groupBy("shard").applyInPandas(change, "shard int, filter binary, full boolean"), "line-filters")
        full = changed.where("full").select("shard")
        rebuilt = exact.join(F.broadcast(full), "shard", "left_semi").groupBy("shard").applyInPandas(_built, "shard int, filter binary")  # shards, not keys, are broadcast
        out.filters = materialize(changed.where("not full").select("shard", "filter").unionByName(rebuilt), "line-filters")
        return out

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.shiftright("high", 40), F.lit(self.shards)).cast("int"))

    def _filters(self) -> DataFrame:
        """shard, filter: a shard has about SHARD_KEYS keys, hashed evenly."""
        return materialize(self._sharded(self.blocked).groupBy("shard").applyInPandas(_built, "shard int, filter binary"), "line-filters")

    # ------------------------------------------------------------------ apply
    def apply(self, docs: DataFrame, broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
        """docs with text cut, and n_lines, n_dropped (long).

        While the blocked keys are at most broadcast_keys, filters and exact
        keys go to every task and nothing is shuffled.  Beyond that, line keys
        are dealt to the filters, and the texts of the documents that lose
        lines by their hash.
        A null text is one empty line and stays null; an empty table gives an
        empty result; a repeated row counts as a document of its own.  Input
        columns n_lines and n_dropped are replaced, all others kept.
        """
        small_batches(self.spark)
        docs, given = set_aside(docs, ("doc_id", "text"), ("n_lines", "n_dropped"))
        return put_back(self._apply_here(docs) if self.n_blocked <= broadcast_keys else self._apply_dealt(docs), given)

    def _apply_here(self, docs: DataFrame) -> DataFrame:
        filters = {r["shard"]: r["filter"] for r in self.filters.collect()}
        exact = self.blocked.orderBy("high").toArrow()
        held = self.spark.sparkContext.broadcast((filters, exact.column("high").to_numpy(), exact.column("low").to_numpy()))
        least, shards = self.least, self.shards

        def cut(batches):
            raw, high, low = held.value
            filters = {s: CuckooFilter.from_bytes(f) for s, f in raw.items()}
            for batch in batches:
                texts = _texts(batch)
                lines = [t.split(b"\n") for t in texts]
                keys = set().union(*(_keys(t, least) for t in texts))
                blocked = _blocked(list(keys), filters, high, low, shards)
                out, n, dropped = [], [], []
                for text, one in zip(batch.column("text").to_pylist(), lines, strict=True):
                    stay = [x for x in one if line_key(x, least) not in blocked] if blocked else one
                    n.append(len(one))
                    dropped.append(len(one) - len(stay))
                    out.append(text if len(stay) == len(one) else b"\n".join(stay).decode())
                yield _with(batch, out, n, dropped)

        return docs.mapInArrow(tidy(cut), _schema(docs))

    def _passing(self, lines: DataFrame) -> DataFrame:
        """The rows (h, high, low) whose key the filter of its shard may have."""
        held = self.spark.sparkContext.broadcast(bloom(self.blocked, "low", self.n_blocked))

        def thin(batches):
            for batch in batches:
                yield batch.filter(pa.array(bloom_hits(held.value, batch.column("low").to_numpy())))

        near = self._sharded(lines.mapInArrow(tidy(thin), lines.schema)).withColumns({"part": F.pmod(F.xxhash64("h", "low"), F.lit(PARTS)).cast("int"), "filter": F.lit(None).cast("binary")})
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "filter", *[F.lit(None).cast("long").alias(c) for c in ("h", "high", "low")])
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        both = near.unionByName(filters).repartition(n, "shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())

        def probe(batches):
            f, at = None, None
            for batch in batches:
                shard, raw = batch.column("shard").to_numpy(), batch.column("filter")
                edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for a, b in zip(edges, edges[1:], strict=False):
                    rows = batch.slice(a, b - a)
                    while rows.num_rows and rows.column("filter")[0].is_valid:  # one for each part that is here
                        f, at = CuckooFilter.from_bytes(rows.column("filter")[0].as_py()), shard[a]
                        k = next((i for i in range(1, rows.num_rows) if rows.column("filter")[i].is_valid), rows.num_rows)
                        yield from _probed(rows.slice(1, k - 1), f)
                        rows = rows.slice(k)
                    if rows.num_rows and at == shard[a]:
                        yield from _probed(rows, f)

        return both.mapInArrow(tidy(probe), "h long, high long, low long")

    def _apply_dealt(self, docs: DataFrame) -> DataFrame:
        least = self.least
        key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h")

        def lines(batches):
            for batch in batches:
                rows = [(h, *_hashed(k)) for h, t in zip(batch.column("h").to_pylist(), _texts(batch), strict=True) for k in _keys(t, least)]
                if rows:
                    a = np.array(rows, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a[:, j]) for j in range(3)], names=["h", "high", "low"])

        every = docs.select("text", key).mapInArrow(tidy(lines), "h long, high long, low long")
        hit = self._passing(every).join(self.blocked, ["high", "low"])
        hit = materialize(hit, "dropped-lines")  # h: of the text, so that equal texts share their decisions
        per = hit.select("h").distinct()
        bitmap = self.spark.sparkContext.broadcast(bloom(per, "h", per.count()))
        keys = hit.groupBy("h").agg(F.collect_set(F.struct("high", "low")).alias("_blocked"))  # at most the lines of one text

        def thin(batches):
            for batch in batches:
                yield batch.append_column("_touched", pa.array(bloom_hits(bitmap.value, batch.column("_h").to_numpy())))

        schema = docs.schema
        with_key = docs.withColumn("_h", key)
        marked = with_key.mapInArrow(tidy(thin), with_key.limit(0).withColumn("_touched", F.lit(True)).schema)

        def cut(batches):
            for batch in batches:
                out, n, dropped = [], [], []
                for text, raw, drop in zip(batch.column("text").to_pylist(), _texts(batch), batch.column("_blocked").to_pylist(), strict=True):
                    gone = {(d["high"], d["low"]) for d in drop or ()}
                    one = raw.split(b"\n")
                    stay = [x for x in one if (k := line_key(x, least)) is None or _hashed(k) not in gone] if gone else one
                    n.append(len(one))
                    dropped.append(len(one) - len(stay))
                    out.append(text if len(stay) == len(one) else b"\n".join(stay).decode())
                yield _with(batch.select(schema.names), out, n, dropped)

        touched = marked.where("_touched").join(keys.withColumnRenamed("h", "_h"), "_h", "left").select(*schema.names, "_blocked")
        rest = marked.where("not _touched").withColumn("_blocked", F.lit(None).cast("array<struct<high:bigint,low:bigint>>")).select(*schema.names, "_blocked")
        return touched.mapInArrow(tidy(cut), _schema(docs)).unionByName(rest.mapInArrow(tidy(cut), _schema(docs)))


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    f = CuckooFilter.build(pdf["high"].to_numpy(), pdf["low"].to_numpy(), room=len(pdf) // 2)
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [f.to_bytes()]})


def _probed(rows: pa.RecordBatch, f: CuckooFilter):
    """h, high, low of the rows that the filter may have."""
    if rows.num_rows:
        found = f.may_have(rows.column("high").to_numpy(), rows.column("low").to_numpy())
        yield rows.select(["h", "high", "low"]).filter(pa.array(found))


def _blocked(keys: list[bytes], filters: dict[int, CuckooFilter], high: np.ndarray, low: np.ndarray, shards: int) -> set[bytes]:
    """Keys that the filter of their shard may have and the exact keys (sorted by high) have."""
    if not keys or not filters:
        return set()
    hashed = np.array([_hashed(k) for k in keys], dtype=np.int64)
    shard = (hashed[:, 0] >> 40) % shards
    out = set()
    for s, f in filters.items():
        at = np.flatnonzero(shard == s)
        passed = at[f.may_have(hashed[at, 0], hashed[at, 1])]
        first, end = np.searchsorted(high, hashed[passed, 0]), np.searchsorted(high, hashed[passed, 0], side="right")
        out |= {keys[i] for i, a, b in zip(passed.tolist(), first.tolist(), end.tolist(), strict=True) if (low[a:b] == hashed[i, 1]).any()}
    return out


def _schema(docs: DataFrame):
    return docs.limit(0).withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_dropped", F.lit(0).cast("long")).schema


def _with(batch: pa.RecordBatch, texts: list, n: list[int], dropped: list[int]) -> pa.RecordBatch:
    columns = [pa.array(texts, f.type) if f.name == "text" else batch.column(k) for k, f in enumerate(batch.schema)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=[*batch.schema.names, "n_lines", "n_dropped"])
