"""MinHash near-dedup on HyperMinHash sketches.

1. Every document's set of five-word shingles gets a sketch and band keys;
   documents with equal sets become one class, which is a node.
2. Classes that share a band key are candidates.  First each class meets the
   least class of its bucket.  Then, in buckets that still hold more than one
   component, each class meets its nearest classes of other components by
   estimated similarity: 4, then all that the estimate can't rule out.  No
   pair within a component is looked at again, so that large groups of copies
   cost pairs in proportion to their size.
3. Pairs that the estimate lets pass are confirmed on the full sets.
4. Confirmed links are contracted to components by hooking each component to
   its least neighbour; a component is named by its least doc_id.

Large buckets are cut into blocks; nothing is collected to the driver.  Rows
that share a doc_id but not the text are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hyperminhash import plausible, shingles, sketches, unpack
from .scratch import bloom, bloom_hits, drop, materialize, put_back, set_aside, small_batches, tidy

SIMILARITY = 75  # per cent
WIDTH = 5
BLOCK = 256  # classes of one bucket compared in one place
PARTNERS = 64  # pairs confirmed against one copy of a set
NEAREST = (4, 1 << 40)

_SIGS = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("small", pa.binary()), ("large", pa.binary()),
        ("small_keys", pa.list_(pa.int64())), ("large_keys", pa.list_(pa.int64())),
    ]
)
SIGS = "doc_id long, text_key long, n_shingles long, high long, low long, small binary, large binary, small_keys array<long>, large_keys array<long>"


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each row of docs: size and digest of its shingle set, sketches, band keys."""
    small_batches(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), _texts(batch), strict=True):
                s = shingles(text, width)
                if not len(s):
                    rows.append((doc_id, key, 0, None, None, None, None, [], []))
                    continue
                x = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((doc_id, key, len(s), int.from_bytes(x[:8], "big", signed=True), int.from_bytes(x[8:], "big", signed=True), *sketches(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SIGS, strict=True)] if rows else [pa.array([], f.type) for f in _SIGS], schema=_SIGS)

    return _keyed(docs).mapInArrow(tidy(sign), SIGS)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key: doc_id and the key tell documents apart."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))


# --------------------------------------------------------------- candidates
def _buckets(classes: DataFrame) -> DataFrame:
    """zone, bucket, hub, node: buckets of at least two classes; hub is the least of them."""
    keys = classes.select("node", F.lit(0).alias("zone"), F.explode("small_keys").alias("bucket")).unionByName(classes.select("node", F.lit(1).alias("zone"), F.explode("large_keys").alias("bucket")))
    shared = materialize(keys.groupBy("zone", "bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "buckets")
    held = shared.sparkSession.sparkContext.broadcast(bloom(shared, "bucket", shared.count()))

    def thin(batches):
        for batch in batches:
            yield batch.filter(pa.array(bloom_hits(held.value, batch.column("bucket").to_numpy())))

    near = keys.mapInArrow(tidy(thin), keys.schema)
    out = materialize(near.join(shared, ["zone", "bucket"]).select("zone", "bucket", "hub", "node"), "members")
    drop(shared)
    return out


def _estimated(pairs: DataFrame, registers: DataFrame, least: float) -> DataFrame:
    """zone, a, b -> distinct a, b that the estimate can't rule out."""
    side = [registers.select("zone", F.col("node").alias(c), F.col("registers").alias(f"r{c}")) for c in "ab"]
    joined = pairs.join(side[0], ["zone", "a"]).join(side[1], ["zone", "b"]).select("a", "b", "ra", "rb")

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (unpack(batch.column(c).to_pylist())[0] for c in ("ra", "rb"))
                yield batch.select(["a", "b"]).filter(pa.array(plausible(a, b, least)[1]))

    return joined.mapInArrow(tidy(keep), "a long, b long").distinct()


def _blocks(members: DataFrame, labels: DataFrame, registers: DataFrame) -> DataFrame:
    """Members of the buckets with more than one component, dealt into blocks.

    The commonest component of a bucket needs no comparison within itself: its
    blocks of BLOCK members each meet the blocks of all others.
    """
    labelled = members.join(labels.withColumnRenamed("label", "l"), "node", "left").select("zone", "bucket", "node", F.coalesce("l", "node").alias("label"))
    per = labelled.groupBy("zone", "bucket", "label").agg(F.count("*").alias("n")).groupBy("zone", "bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("labels"))
    # Two classes have met at their hub.
    open_ = per.where("labels > 1 and all > 2").select("zone", "bucket", F.col("m.label").alias("major"), F.ceil(F.col("m.n") / BLOCK).alias("majors"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).alias("minors"))
    rows = labelled.join(open_, ["zone", "bucket"])
    part = F.pmod(F.xxhash64("node"), F.when(F.col("label") == F.col("major"), F.col("majors")).otherwise(F.col("minors")))
    with_major = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda q: F.struct(F.lit(0).alias("kind"), F.col("part").alias("p"), q.alias("q")))
    with_minor = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda p: F.struct(F.lit(1).alias("kind"), F.least("part", p).alias("p"), F.greatest("part", p).alias("q")))
    # Minors of one part meet each other beside the majors.
    minor = F.concat(with_major, F.filter(with_minor, lambda x: x["p"] != x["q"]))
    major = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda p: F.struct(F.lit(0).alias("kind"), p.alias("p"), F.col("part").alias("q")))
    dealt = rows.withColumn("part", part).withColumn("block", F.explode(F.when(F.col("label") == F.col("major"), major).otherwise(minor)))
    dealt = dealt.select("zone", F.xxhash64("bucket", "block").alias("block"), F.col("bucket").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key"), "node", "label")
    return dealt.join(registers, ["zone", "node"])


def _nearest(blocks: DataFrame, least: float, most: int) -> DataFrame:
    """a, b: for each class of a block its `most` nearest ones of other components, by estimate."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks.select("block", "key", "node", "label", "registers").repartition(n, "block").sortWithinPartitions("block", "node")

    def compare(batches):
        for group in _groups(batches):
            yield from _pairs(*group, least, most)

    return ordered.mapInArrow(tidy(compare), "a long, b long").distinct()


def _groups(batches) -> Iterator[tuple]:
    """Runs of whole blocks from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        change = np.flatnonzero(block[1:] != block[:-1])
        if held and block[0] != held[-1].column("block")[-1].as_py():
            yield _columns(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield _columns([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> tuple:
    t = pa.Table.from_batches(batches)
    return (*(t.column(c).to_numpy() for c in ("block", "key", "node", "label")), *unpack(t.column("registers").to_pylist()))


def _pairs(block, key, node, label, regs, prints, least: float, most: int) -> Iterator[pa.RecordBatch]:
    """Compares row i with the rows after it in its block, many rows at a time.

    Of the buckets that two classes share only that of their first common band
    gives the pair.
    """
    end = np.searchsorted(block, block, side="right")
    reach = end - np.arange(len(block)) - 1
    at, left, right, near = 0, [], [], []
    while at < len(block):
        # Rows whose comparisons together fill about 60,000 register rows.
        upto = max(at + 1, int(np.searchsorted(np.cumsum(reach[at:]), 60_000)) + at)
        size = reach[at:upto]
        i = np.repeat(np.arange(at, upto), size)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        other = label[i] != label[j]
        i, j = i[other], j[other]
        for k in range(0, len(i), 8_000):
            x, y = i[k : k + 8_000], j[k : k + 8_000]
            common = prints[x] == prints[y]
            first = prints[x, common.argmax(axis=1)] == key[x]
            x, y = x[first], y[first]
            s, fit = plausible(regs[x], regs[y], least)
            left.append(x[fit])
            right.append(y[fit])
            near.append(s[fit])
        at = upto
    if not left:
        return
    i, j, s = np.concatenate(left), np.concatenate(right), np.concatenate(near)
    if len(i) and most < len(block):
        who, which, score = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2), np.concatenate([s, s])
        order = np.lexsort((which, -score, who))
        who, which = who[order], which[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kept = np.unique(which[rank < most])
        i, j = i[kept], j[kept]
    if len(i):
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


# ------------------------------------------------------------- confirmation
def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, shingles (sorted unsigned 64-bit) of these (node, doc_id, text_key); other texts are not shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(nodes, "text_key", nodes.count()))

    def thin(batches):
        seen = set()  # a repeated row gives its set once in a task
        for batch in batches:
            hit = batch.filter(pa.array(bloom_hits(held.value, batch.column("text_key").to_numpy())))
            rows = []
            for i, k, t in zip(hit.column("doc_id").to_pylist(), hit.column("text_key").to_pylist(), _texts(hit), strict=True):
                if i is not None and (i, k) not in seen:
                    seen.add((i, k))
                    rows.append((i, k, shingles(t, width).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "text_key", "shingles"])

    some = _keyed(docs).mapInArrow(tidy(thin), "doc_id long, text_key long, shingles binary")
    return some.join(nodes, ["doc_id", "text_key"]).select("node", "shingles")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union.

    A set meets up to PARTNERS others in one place, where it is sent once,
    before them.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("node"))
    other = dealt.join(sets, "node").select("a", "part", F.col("node").alias("b"), "shingles")
    own = parts.withColumnRenamed("a", "node").join(sets, "node")
    own = own.select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = own.unionByName(other).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def check(batches):
        x = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                y = np.frombuffer(s, np.uint64)
                if b is None:
                    x = y
                elif 100 * len(x) >= percent * len(y) and 100 * len(y) >= percent * len(x):
                    both = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return together.mapInArrow(tidy(check), "a long, b long").distinct()


# --------------------------------------------------------------- components
def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, label (least node that edges reach) for every node of an edge; labels: those so far.

    Each turn contracts edges by the labels, hooks every component to its
    least neighbour and follows three hooks.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    fresh = nodes.select("node", F.col("node").alias("label"))
    if labels is not None:
        fresh = labels.unionByName(nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    labels = materialize(fresh, "labels")
    while True:
        ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
        apart = edges.join(ends[0], "a").join(ends[1], "b").where("la <> lb").select("la", "lb").distinct()
        apart = materialize(apart, "apart")
        if apart.isEmpty():
            drop(apart)
            return labels
        both = apart.select(F.col("la").alias("x"), F.col("lb").alias("y")).unionByName(apart.select(F.col("lb").alias("x"), F.col("la").alias("y")))
        hook = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("up"))
        hook = materialize(hook, "hooks")
        for _ in range(3):
            higher = hook.select(F.col("x").alias("up"), F.col("up").alias("higher"))
            step = materialize(hook.join(higher, "up").select("x", F.col("higher").alias("up")), "hooks")
            drop(hook)
            hook = step
        moved = labels.join(hook.withColumnRenamed("x", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        moved = materialize(moved, "labels")
        for old in (labels, apart, hook):
            drop(old)
        labels = moved


# ------------------------------------------------------------------ operator
def _grouped(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and group (null: linked with nothing) of every row."""
    small_batches(docs.sparkSession)
    least = percent / 100
    signed = materialize(signatures(docs, width), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # A node's number has no meaning; the written table fixes it.
    per_set = full.groupBy("high", "low").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).withColumn("node", F.monotonically_increasing_id())
    per_set = materialize(per_set.select("high", "low", "node", "first.doc_id", "first.text_key"), "classes")
    classes = full.join(per_set, ["high", "low", "doc_id", "text_key"]).dropDuplicates(["high", "low"])
    classes = materialize(classes.select("node", "small", "large", "small_keys", "large_keys"), "class-sketches")
    registers = classes.where("small is not null").select("node", F.lit(0).alias("zone"), F.col("small").alias("registers"))
    registers = registers.unionByName(classes.where("large is not null").select("node", F.lit(1).alias("zone"), F.col("large").alias("registers")))
    members = _buckets(classes)

    star = members.where("node <> hub").select("zone", F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = materialize(_estimated(star, registers, least), "pairs")
    labels, tested, spent = None, None, [classes, members]
    for most in (None, *NEAREST):
        if most is not None:
            pairs = _nearest(_blocks(members, labels, registers), least, most)
            pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        spent.append(pairs)
        if pairs.isEmpty():
            if most is None:
                labels, tested = materialize(per_set.select("node", F.col("node").alias("label")).limit(0), "labels"), pairs
            continue
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        nodes = materialize(nodes.join(per_set, "node").select("node", "doc_id", "text_key"), "nodes")
        sets = materialize(_sets(docs, nodes, width), "sets")
        links = materialize(_confirmed(pairs, sets, percent), "links")
        labels = components(links, labels)
        for done in (nodes, sets, links):
            drop(done)
        tested = pairs if tested is None else tested.unionByName(pairs)
    named = per_set.join(labels, "node", "left").select("high", "low", "doc_id", F.coalesce("label", "node").alias("group"))
    least_id = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.drop("doc_id").join(least_id, "group"), "named-classes")
    for done in spent:
        drop(done)
    out = signed.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("high")).alias("high"), "low").join(named, ["high", "low"], "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component), kept.

    A row for each row of docs.  Words are what white space (ASCII) separates,
    A-Z lower-cased.  Texts without words, or null, have an empty set and are
    linked with nothing.  Rows that share a doc_id but not the text are
    documents of their own, each with its own component; `kept` tells whether
    the doc_id names the component (keep_one() settles which of several such
    rows stays).  A null doc_id is linked with nothing and kept; its
    component_id is null.
    """
    out = _grouped(docs, percent, width).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """docs with one row of each component: the least doc_id, then the least hash of its text.

    Of rows equal in doc_id and text one stays.  Rows without a doc_id, and
    texts without words, are linked with nothing and stay.
    """
    docs, given = set_aside(docs, ("doc_id", "text"))
    rows = _grouped(docs, percent, width).where("doc_id is not null").select("doc_id", "text_key", "group")
    rows = materialize(rows, "groups")
    document = F.struct("doc_id", "text_key")
    first = rows.where("group is not null").groupBy("group").agg(F.min(document).alias("first"))
    gone = materialize(rows.join(first, "group").where(document != F.col("first")).select("doc_id", "text_key").distinct(), "near-copies")
    twice = materialize(rows.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "repeated-rows")
    drop(rows)
    names = docs.columns
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_key": F.xxhash64(F.col("text").cast("string"))})
    own = ["_id", "_key"]
    kept = keyed.join(gone.toDF(*own), own, "left_anti")
    if not twice.isEmpty():
        twice = twice.toDF(*own)
        once = kept.join(twice, own, "left_anti")
        kept = once.unionByName(kept.join(twice, own, "left_semi").dropDuplicates(own))
    return put_back(kept.select(*names), given)
