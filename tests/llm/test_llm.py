"""Training-data operators against brute force, round trips and awkward inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, cuckoo, decontam, fmindex, gbt, hyperminhash, linededup, neardup, packing, pii, quality, rans, spans, toxicity
from corpusloom.llm.queries import ORACLES, QUERIES
from corpusloom.llm.scratch import bloom, bloom_hits
from corpusloom.llm.tokens import TextEncoder

SF = "/root/testdata/sf0.001"
_LONG_NULL = " ".join(f"Sentence number {k} of a row without id." for k in range(12))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "b c d"), (5, "word " * 30_000), (6, "é ß 日本 😀  two  blanks\n\n"),
    (7, "One text of seven. It ends here. And more."), (7, "Another."), (7, None), (None, _LONG_NULL), (None, _LONG_NULL), (None, None), (None, "Short. Text."),
]
SCHEMA = "doc_id long, text string"


def odd(spark):
    """Null, empty, blank, repeated, very long and non-ASCII texts, one doc_id with several texts, rows without one, columns that operators use themselves."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("ids", "_h", "start", "score", "n_lines", "spans", "kept", "entities", "n_words", "_touched", "_items", "_id", "_key", "_n0", "_spans", "n_dropped", "_given0"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------------- tokens
@pytest.fixture(scope="module")
def enc():
    return TextEncoder()


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


LIBRARY = _library()  # loaded plainly


def plain_ids(enc, text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_special_tokens_are_encoded_as_the_library_does(enc):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n<|endoftext|>y", "a\n<|endoftext|>. b,<|endoftext|>", "<|endoftext| >", "a  <|endoftext|>", "one.<|endoftext|>!"]
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == plain_ids(enc, t), t
    assert plain_ids(enc, texts[0]) == [64, 220, 50256, 275]


def test_encoder_equals_library(enc, spark):
    rng = random.Random(5)
    bits = ["a", "B", "foo", "1", "²", "'s", "'", ".", ",", "!", " ", " ", "\n", "\t", "\x1c", "\x85", "é", "日本", "😀", "<|endoftext|>", "_", "don't", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [t for _, t in ODD if t]
    texts += [r["text"] for r in docs(spark).select("text").collect()]
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == plain_ids(enc, t), repr(t)


# --------------------------------------------------------------- op2: packing
def test_lower_bound_and_best_fit():
    rng = random.Random(1)
    for _ in range(60):
        capacity = 12
        sizes = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 7))), reverse=True)
        best = next(k for k in range(1, 8) if _packs(sizes, [capacity] * k))
        assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= best
        sequence, offset, free = packing.best_fit(np.array(sizes), capacity)
        assert len(free) >= best
        for b in range(len(free)):
            at = 0
            for k in sorted(np.flatnonzero(sequence == b), key=lambda k: offset[k]):
                assert offset[k] == at
                at += sizes[k]
            assert free[b] == capacity - at >= 0


def _packs(sizes, room):
    if not sizes:
        return True
    return any(_packs(sizes[1:], room[:k] + [r - sizes[0]] + room[k + 1 :]) for k, r in enumerate(room) if r >= sizes[0])


def test_pack_pieces(spark, enc):
    rows = packing.pack(packing.pieces(docs(spark)), per_partition=60).collect()
    _check_packing(rows, {r["doc_id"]: plain_ids(enc, r["text"]) + [0] for r in docs(spark).collect()})
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) + 3
    assert all(r["sequences"] >= r["bound"] for r in rows)


def test_partitions_with_gaps_exchange(spark):
    rng = random.Random(16)
    rows = [(k, 0, 0, rng.choice((1500, 700, 530, 410, 300, 1040, 1000, 2048)), k) for k in range(600)]
    cut = spark.createDataFrame(rows, packing.PIECES)
    counts = {}
    for rounds in (0, 4):
        got = packing.pack(cut, per_partition=20, rounds=rounds).collect()
        assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((r[0], r[3]) for r in rows)
        for _, g in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
            at = 0
            for p in g:
                assert p["offset"] == at
                at += p["length"]
            assert at <= 2048
        counts[rounds] = len({r["sequence_id"] for r in got})
    bound = packing.lower_bound(np.bincount([r[3] for r in rows], minlength=2049), 2048)
    assert bound <= counts[4] < counts[0]
    # All partitions with a gap take part, not as many as one task holds.
    assert len({r["sequence_id"] >> 32 for r in got if r["sequence_id"] >> 56}) > 1


def _check_packing(rows, ids):
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, want in ids.items():
        at = 0
        for k, p in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            assert (p["piece"], p["start"]) == (k, at)
            assert k == 0 or p["length"] == 2048
            assert p["ids_crc32"] == zlib.crc32(np.array(want[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(want)
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for p in g:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048


def test_pack_odd(spark):
    rows = packing.pack(packing.pieces(odd(spark))).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(d for d, _ in ODD)
    assert packing.pack(packing.pieces(empty(spark))).count() == 0


def test_sequences_hold_the_ids(spark, enc):
    df = docs(spark).select("doc_id", "text")
    packed = packing.pack(packing.pieces(df))
    got = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in packing.sequences(df, packed).collect()}
    ids = {r["doc_id"]: plain_ids(enc, r["text"]) + [0] for r in df.collect()}
    want: dict = {}
    for r in sorted(packed.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        want.setdefault(r["sequence_id"], []).extend(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    assert got == want


# ------------------------------------------------------------------ op3: rANS
@pytest.mark.parametrize("n", [1, 63, 64, 5_000, 700_000])
def test_rans_block(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 50_000).astype(np.uint32)
    freq = rans.frequency_table(np.bincount(ids))
    assert int(freq.sum()) == 1 << rans.SCALE_BITS
    freq2 = rans.table_from(rans.table_bytes(freq))
    payload = rans.encode_block(ids, freq)
    assert (rans.decode_block(payload, freq2) == ids).all()
    a, b = n // 3, n - n // 5
    assert (rans.decode_block(payload, freq2, a, b) == ids[a:b]).all()
    if n > 100_000:
        entropy = -(np.bincount(ids)[np.bincount(ids) > 0] / n * np.log2(np.bincount(ids)[np.bincount(ids) > 0] / n)).sum()
        assert len(payload) * 8 / n < entropy * 1.03 + 0.3


def test_token_files(spark, enc, tmp_path):
    path = str(tmp_path / "files")
    rans.write_token_files(docs(spark), path)
    got = sorted(rans.read_token_files(spark, path).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r, d in zip(got, sorted(docs(spark).collect(), key=lambda r: r["doc_id"]), strict=True):
        want = plain_ids(enc, d["text"]) + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d["doc_id"], at, len(want))
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want
        at += len(want)


def test_token_files_odd_and_damage(spark, tmp_path):
    path = str(tmp_path / "odd")
    rans.write_token_files(odd(spark), path)
    assert rans.read_token_files(spark, path).count() == len(ODD)
    rans.write_token_files(empty(spark), str(tmp_path / "none"))
    assert rans.read_token_files(spark, str(tmp_path / "none")).count() == 0
    spark.read.parquet(path).withColumn("crc", F.col("crc") + 1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="damaged"):
        rans.read_token_files(spark, str(tmp_path / "bad")).collect()


# -------------------------------------------------------------- op4: toxicity
def test_isotonic_and_trees():
    s, v = gbt.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    assert gbt.calibrated(np.array([0.0, 2.5, 9]), (s, v)).tolist() == [0.0, 0.5, 1.0]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = gbt.fit(x[:1500], y[:1500], trees=60)
    assert ((m.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_toxicity_separates_and_ignores_held_out_labels(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(vocabulary) for _ in range(60)]
        toxic = k % 4 == 0
        if toxic:
            words[5], words[20], words[40] = "you", rng.choice(("zorkish", "zorky", "idiot")), rng.choice(("zorkel", "moron"))
        rows.append((k, " ".join(words)))
        held = zlib.crc32(str(k).encode()) % 5 == 0
        labels.append((k, int(toxic) if not held else 1 - int(toxic)))  # held-out labels are lies
    d = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.5) == (k % 4 == 0) for k in held) / len(held) > 0.95
    scored = toxicity.score(odd(spark), model).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(empty(spark), model).count() == 0


def test_other_labels_are_none_and_samples_are_as_large_as_said(spark):
    d = docs(spark).select("doc_id", "text")
    odd_labels = spark.createDataFrame([(k, k % 5 - 1) for k in range(200)], "doc_id long, toxic int")
    held = toxicity._fit_rows(d, odd_labels, 1000).collect()
    assert {r["toxic"] for r in held} == {0, 1} and len(held) < 80
    assert toxicity.score(odd(spark), toxicity.fit(d, odd_labels)).count() == len(ODD)
    many = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    texts = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    assert 400 < toxicity._fit_rows(texts, many, 500).count() < 600


def test_toxicity_without_labels(spark):
    model = toxicity.fit(docs(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd(spark), model).collect()} <= {0.5}


# ------------------------------------------------------------- op5: line dedup
def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    high, low = rng.integers(-(2**62), 2**62, (2, 20_000))
    f = cuckoo.CuckooFilter.build(high, low)
    assert f.may_have(high, low).all()
    other = rng.integers(-(2**62), 2**62, (2, 20_000))
    assert f.may_have(*other).mean() < 0.01
    f.delete(high[:10_000], low[:10_000])
    assert f.may_have(high[10_000:], low[10_000:]).all()
    assert f.may_have(high[:10_000], low[:10_000]).mean() < 0.01
    again = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    assert again.may_have(high[10_000:], low[10_000:]).all()


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return [(d, "\n".join(x for x in (t or "").split("\n") if not (key(x) and counts[key(x)] >= least))) for d, t in rows]


@pytest.mark.parametrize(("most", "shard_keys"), [(1_000_000, 500_000), (0, 500_000), (1_000_000, 1), (0, 1)])
def test_line_dedup_both_ways(spark, monkeypatch, most, shard_keys):
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard_keys)
    rows = [(k, "\n".join([" HEAD ", f"own {k}", "tail" if k % 2 else "other", "É" if k % 3 else "é"])) for k in range(40)] + [(40, None), (41, ""), (42, "\n\n")]
    df = spark.createDataFrame(rows, SCHEMA)
    index = linededup.LineIndex.of(df, min_docs=10)
    got = {r["doc_id"]: r for r in index.apply(df, broadcast_keys=most).collect()}
    for d, want in brute_lines(rows, 10):
        assert (got[d]["text"] or "") == want
        assert got[d]["n_lines"] == len((dict(rows)[d] or "").split("\n"))
    lines = index.apply(odd(spark), most)
    assert lines.count() == len(ODD) and set(lines.columns) - {"n_dropped"} == set(odd(spark).columns) - {"n_dropped"}
    assert index.apply(empty(spark), most).count() == 0


def test_filters_decide_what_meets_the_exact_keys(spark, monkeypatch):
    """On the large path no line that its shard's filter does not have is joined with the exact keys."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    rows = [(k, "\n".join([f"shared {k % 4}", f"also {k % 3}", f"own {k}"])) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = linededup.LineIndex.of(df, min_docs=10)
    assert index.n_blocked == 7 and index.shards == 3
    held = {r["shard"]: cuckoo.CuckooFilter.from_bytes(r["filter"]) for r in index.filters.collect()}
    keys = [(d, *linededup._hashed(k)) for d, t in rows for k in linededup._keys(t.encode(), 1)]
    monkeypatch.setattr(linededup, "bloom_hits", lambda bitmap, x: np.ones(len(x), dtype=bool))
    got = index._passing(spark.createDataFrame(keys, "h long, high long, low long")).collect()
    want = [(h, a, b) for h, a, b in keys if (f := held.get((a >> 40) % 3)) is not None and f.may_have(np.array([a]), np.array([b]))[0]]
    assert sorted(map(tuple, got)) == sorted(want) and 120 <= len(want) < 130


def test_line_dedup_is_reversible(spark):
    first = spark.createDataFrame([(k, f"common\nown {k}") for k in range(9)], SCHEMA)
    more = spark.createDataFrame([(100 + k, "common\nlate") for k in range(12)], SCHEMA)
    a = linededup.LineIndex.of(first)
    b = a.insert(more)
    c = b.delete(more)
    assert (a.n_blocked, b.n_blocked, c.n_blocked) == (0, 2, 0)
    assert sorted(map(tuple, a.counts.collect())) == sorted(map(tuple, c.counts.collect()))
    assert {r["n_dropped"] for r in b.apply(first).collect()} == {1}
    assert {r["n_dropped"] for r in c.apply(first).collect()} == {0}
    assert [bytes(r["filter"]).count(b"\0") == len(r["filter"]) for r in c.filters.collect()] in ([], [True])
    assert linededup.LineIndex.of(empty(spark)).n_blocked == 0


# ------------------------------------------------------ op6: decontamination
def test_fm_index_finds_all():
    rng = np.random.default_rng(2)
    for sigma in (2, 5, 40):
        text = np.append(rng.integers(1, sigma + 1, 3000), 0)
        text[100:400] = text[1000:1300]  # a long repeat
        sa = fmindex.suffix_array(text)
        assert sa.tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())
        index = fmindex.FMIndex(text)
        for m in (1, 2, 5):
            patterns = np.array([text[k : k + m] for k in rng.integers(0, 2990, 20)] + [rng.integers(1, sigma + 3, m) for _ in range(10)])
            start, end = index.ranges(patterns)
            for p, a, b in zip(patterns, start, end, strict=True):
                want = [k for k in range(len(text) - m + 1) if (text[k : k + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_hits(text, items, n=8):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: pattern.findall((t or "").encode().lower().decode())
    w, hit, found = fold(text), set(), set()
    for i, t in items:
        q = fold(t)
        m = min(n, len(q))
        for k in range(len(q) - m + 1 if q else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == q[k : k + m]:
                    hit |= set(range(p, p + m))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("slice_items", "scan_slices"), [(20_000, 8), (2, 8), (2, 1)])
def test_contamination(spark, monkeypatch, slice_items, scan_slices):
    monkeypatch.setattr(decontam, "SLICE_ITEMS", slice_items)
    monkeypatch.setattr(decontam, "SCAN_SLICES", scan_slices)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    items = [(1, " ".join(words)), (2, "Short item"), (3, " ".join(words[2:])), (4, None), (10, "--"), (5, "ünïcode wörds here")]
    texts = ["x " + " ".join(words).upper() + " y " + " ".join(words[:7]), "a short-item b", " ".join(words[1:9]), None, "", "Ünïcode", "ünïcode wörds here", "alpha " * 50 + " ".join(words[2:]) + " short item short item"]
    rows = list(enumerate(texts))
    d, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(d, b)
    for r in decontam.digest(found).collect():
        n, hit, ids = brute_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(ids))
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r["contaminated"] == (len(ids) >= 2)
    clean = {r["doc_id"]: r["text"] for r in decontam.cut_spans(found).collect()}
    assert clean[0] == "x  y " + " ".join(words[:7]) and clean[3] is None and clean[5] == "Ünïcode"
    assert decontam.contamination(odd(spark), b).count() == len(ODD)
    assert set(odd(spark).columns) - {"spans", "n_words"} < set(decontam.contamination(odd(spark), b).columns)
    assert decontam.contamination(empty(spark), b).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(odd(spark), b.limit(0)).collect()} == {0}


# --------------------------------------------------------- op7: quality rules
def test_binomial_tail(spark):
    from math import comb

    for n, k, p in ((50, 0, 0.05), (400, 3, 0.02), (1000, 9, 0.01), (3, 1, 0.5)):
        want = 1.0 if k >= n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k")).select(F.expr(quality.binomial_tail("n", "k", p)).alias("t")).first()["t"]
        assert abs(got - want) < 1e-9 * max(1, want)


def brute_metrics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    c = Counter(runs)
    inside = {p for k, r in enumerate(runs) if c[r] > 1 for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_metrics(spark):
    rng = random.Random(4)
    texts = [None, "", " \n ", "a b c d e f g h " * 5, "x " * 40, "l1\nl1\n\n l1\nl2", "##a| <b>"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(8, 60))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, None, "x") for k, t in enumerate(texts)], SCHEMA + ", lang string, n_words string")
    for r in quality.measured(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_metrics(texts[r["doc_id"]])
    strange = quality.measured(odd(spark).withColumn("lang", F.lit("en")))
    cutoffs = quality.select_cutoffs(strange, spark.createDataFrame([(7, 1), (None, 1), (4, None)], "doc_id long, quality int"))
    assert quality.judged(strange, cutoffs).count() == len(ODD) and quality.judged(strange.limit(0), cutoffs).count() == 0


def test_judged_equals_sql_where_cutoffs_exist(spark, tmp_path):
    """The SQL side by side on labels that are enough for cutoffs in one stratum and too few in another."""
    import duckdb

    rng = random.Random(17)
    rows, labels = [], []
    for k in range(2600):
        lang, bad = "de" if k % 13 == 0 else "en", k % 6 == 0
        mark = rng.choice(("***", "!", "#")) if bad else rng.choice(("", "", "", "", "", "", "", "!"))
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) + (mark if rng.random() < 0.5 else "") for _ in range(rng.randint(15, 40))]
        rows.append((k, " ".join(words), lang))
        labels.append((k, 0 if bad else 1))
    spark.createDataFrame(rows, SCHEMA + ", lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op7_quality_rules"](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = c.sql(ORACLES["op7_quality_rules"]).df()
    columns = sorted(got.columns)
    rows_of = lambda df: sorted(repr([_value(x) for x in r]) for r in df[columns].astype(object).values.tolist())
    assert columns == sorted(want.columns) and rows_of(got) == rows_of(want)
    by_cutoff = got[~got["base_failed"] & ~got["kept"]]
    assert len(by_cutoff) > 50 and set(by_cutoff["doc_id"] % 13 == 0) == {False}
    extra = spark.createDataFrame([(1, "word " * 30, "en", "a", "b")], SCHEMA + ", lang string, _stratum string, cut_lines string")
    kept = quality.judged(quality.measured(extra), quality.select_cutoffs(quality.measured(extra), spark.createDataFrame(labels, "doc_id long, quality int")))
    assert kept.first()["_stratum"] == "a" and kept.first()["cut_lines"] == "b"


def test_cutoffs_keep_good_documents(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(3000):
        bad = k % 5 == 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) + ("***" if bad else "") for _ in range(30)]
        rows.append((k, " ".join(words), "en"))
        labels.append((k, 0 if bad else 1))
    d = spark.createDataFrame(rows, SCHEMA + ", lang string")
    m = quality.measured(d).drop("text")
    cut = quality.select_cutoffs(m, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(m, cut).collect()}
    assert all(kept[k] == (k % 5 != 0) for k in kept)
    none = quality.select_cutoffs(m, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r["kept"] for r in quality.judged(m, none).collect())


# ------------------------------------------------------------ op8: sentence spans
def brute_sentences(text):
    return [x for x in re.findall(r"(?:[^.!?\n]|[.!?](?![.!?]*[\x20\x09-\x0D]))*(?:[.!?]+(?=[\x20\x09-\x0D])|\n|$)", text or "") if x.strip(" \t\n\x0b\x0c\r")]


def brute_runs(text):
    words = [" ".join(x.encode().lower().decode().split()) for x in brute_sentences(text)]
    return [(k, " ".join(words[k : k + 2])) for k in range(len(words) - 1)]


def brute_spans(rows):
    first: dict = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for a, run in brute_runs(t):
            first.setdefault(run, (d, t, a))
    return {(d, t): len({s for a, run in brute_runs(t) if first[run] != (d, t, a) for s in (a, a + 1)}) for d, t in rows}


def test_span_dedup(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(9)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(6))
    rows = [(k, f"{sentence()} {sentence()} {passage if k % 3 else ''} {sentence()}\n{sentence()}") for k in range(30)] + [(30, None), (31, ""), (32, "no end")]
    got = {r["doc_id"]: r for r in spans.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (d, t), n in brute_spans(rows).items():
        assert got[d]["n_removed"] == n
        assert (got[d]["text"] == t) == (n == 0)
    assert got[1]["n_removed"] == 0 and passage in got[1]["text"]
    assert passage[:60] not in got[2]["text"] and got[2]["n_removed"] == 6
    assert spans.remove_repeats(odd(spark)).count() == len(ODD)
    assert spans.remove_repeats(empty(spark)).count() == 0


def test_span_dedup_tells_rows_of_one_id_apart(spark):
    shared = "Both have this sentence. And this one too."
    one, other = f"Unique alpha here. Unique beta here. {shared} Unique gamma here. Unique delta here.", f"First own words. {shared}"
    rows = [(5, one), (5, other), (5, "Short. Text."), (None, shared + " " + "Long tail of it. " * 3 + "No end"), (None, "Only one."), (None, None), (6, f"Six says so. {shared} Six ends so.")]
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in spans.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    texts = " ".join(t or "" for _, t, _ in got)
    for own in ("alpha", "beta", "gamma", "delta", "First own words.", "Six says so.", "Six ends so.", "Short. Text.", "Only one.", "No end"):
        assert own in texts
    assert texts.count("Both have this sentence") == 1
    assert sorted(n for d, _, n in got if d == 5) == [0, 2, 2] and [n for d, _, n in got if d == 6] == [2]
    same = spans.remove_repeats(spark.createDataFrame([(7, shared), (7, shared)], SCHEMA)).collect()
    assert [r["text"] for r in same] == [shared, shared]


@pytest.mark.parametrize("lengths", [(40, 8, 5), (20, 20, 8, 8), (5, 4)])
def test_span_dedup_takes_whole_passages(spark, lengths):
    rng = random.Random(10)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(n) for n in lengths)
    own = [(sentence(9), sentence(9)) for _ in range(4)]
    rows = [(k, f"{a} {passage} {b}") for k, (a, b) in enumerate(own)]
    got = {r["doc_id"]: r for r in spans.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["n_removed"] == 0
    for k, (a, b) in enumerate(own[1:], 1):
        assert got[k]["text"] == f"{a} {b}" and got[k]["n_removed"] == len(lengths)


# -------------------------------------------------------------- op9: near-dedup
def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("block", [256, 5])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PARTNERS", min(block, 64))
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    rows = []
    for length in (1, 3, 5, 6, 8, 12, 30, 120, 220, 280, 500):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for k in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, length // 30)) if k else 0):
                w[rng.randrange(length)] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 7, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "A b C"), (5004, "a B c")]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, (n, c) in brute_components(rows).items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, c, c == d)


def test_near_duplicates_odd(spark):
    got = neardup.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert all(r["kept"] for r in got)
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in ODD)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    rng = random.Random(13)
    a, b = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in "ab")
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(5, a), (5, b), (9, near), (3, b.rsplit(" ", 1)[0]), (7, a), (7, near), (7, near), (8, ""), (8, ""), (8, "x"), (None, a), (None, a), (6, None)]
    df = spark.createDataFrame([(*r, f"row {k}") for k, r in enumerate(rows)], SCHEMA + ", _key string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in neardup.near_duplicates(df).collect())
    assert got == sorted([(5, 5), (5, 3), (9, 5), (3, 3), (7, 5), (7, 5), (7, 5), (8, 8), (8, 8), (8, 8), (0, 0), (0, 0), (6, 6)])
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())) == sorted([(5, a), (3, b.rsplit(" ", 1)[0]), (8, ""), (8, "x"), (0, a), (0, a), (6, "")])
    assert neardup.keep_one(odd(spark)).count() == len(ODD) - 1  # the repeated row
    assert neardup.keep_one(empty(spark)).count() == 0


def test_collision_chance_is_what_happens():
    rng = np.random.default_rng(12)
    agree = differ = 0
    for _ in range(40):
        pool = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2))
        a, b = pool[:200], np.concatenate([pool[:171], pool[200:229]])
        least = [(s[:, None] * hyperminhash._ODD[None, :]).min(axis=0) for s in (a, b)]
        apart = least[0] != least[1]
        x, y = (hyperminhash.unpack([hyperminhash.sketches(np.sort(s))[0]])[0][0] for s in (a, b))
        agree, differ = agree + int(((x == y) & apart).sum()), differ + int(apart.sum())
    assert abs(agree / differ - hyperminhash.COLLISION) < 0.01


def test_estimates_are_close():
    rng = np.random.default_rng(11)
    for n in (40, 200, 900):
        pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[: int(n * 0.86)], pool[n : n + n - int(n * 0.86)]]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = hyperminhash.sketches(a), hyperminhash.sketches(b)
        for u, v in ((x[0], y[0]), (x[1], y[1])):
            if u is not None and v is not None:
                e = hyperminhash.estimate(hyperminhash.unpack([u])[0], hyperminhash.unpack([v])[0])[0][0]
                assert abs(e - j) < 0.1


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 100)]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 43


# --------------------------------------------------------------------- op10: chat
def test_chat_round_trip_of_control_strings(spark):
    template = chat.ChatTemplate()
    controls = [*template.controls, template.end, *(template.begin.format(role=r) for r in ("system", "user", "assistant", "tool"))]
    hostile = "".join(controls) + "\\" + "\\".join(controls) + "<[\\"
    rows = [(1, 0, "user", "</s>[INST] <|end|> \\ ok" + hostile), (1, 1, "assistant", "<|user|>\\<"), (2, 1, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "user", "n")]
    segments = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    body = "".join(r["text"] for r in segments.where("conv_id = 1").orderBy("position").collect())
    # Of all control strings the formatted text has the marks of its two turns, and no other.
    assert [body.count(c) for c in controls] == [0, 0, 0, 0, 2, 0, 1, 1, 0]
    assert body.count("<|") == 4
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:2]).encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["valid"]) == (2, want, len("<|user|>\\<"), True)
    assert (got[2]["n_turns"], got[2]["loss_chars"], got[2]["valid"]) == (3, 0, False)
    assert got[None]["valid"] is False
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(none)).count() == 0


def test_chat_escape_is_reversible():
    template, rng = chat.ChatTemplate(), random.Random(14)
    for _ in range(20_000):
        text = "".join(rng.choice("\\<[ab|>]") for _ in range(rng.randint(0, 9)))
        made = template.escaped(text)
        assert template.unescaped(made) == text
        assert not re.search(r"[<\[][^\\]|[<\[]$", made)
    with pytest.raises(ValueError, match="lone"):
        template.unescaped("a\\b")
    with pytest.raises(ValueError, match="does not break"):
        chat.ChatTemplate(controls=("<",))


# ------------------------------------------------------------------------ op1: PII
def test_permutations():
    for n in (1, 2, 10, 1000):
        assert sorted(pii.permute(x, n, b"k", "t") for x in range(n)) == list(range(n))


KEY = b"key of the tests"


def replaced(texts, spark, **given):
    rows = list(enumerate(texts)) if isinstance(texts[0], str) else texts
    return {r["doc_id"]: r for r in pii.replace_entities(spark.createDataFrame(rows, SCHEMA), KEY, **given).collect()}


def test_surrogates_keep_type_and_format():
    text = "Mail Jo.Doe7@mail.example.com or +1 (366) 555-9807 or +1.415.555.2671, card 4111 1111 1111 1111, ip 10.1.2.3, iban DE89 3704 0044 0532 0130 00, Frau Anna Schmidt, г-н Иванов. v1.2.3.4.5"
    found = pii.detect(text)
    assert [x.kind for x in found] == ["email", "phone", "phone", "card", "ip", "iban", "name", "name", "name"]
    new = [pii.formatted(text[x.start : x.end], pii.surrogate(x.kind, x.value, b"key", gender=x.gender), x.kind) for x in found]
    assert all(n.lower() != text[x.start : x.end].lower() for n, x in zip(new, found, strict=True))
    assert re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d@[a-z]{12}\.example", new[0])
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) 555-\d{4}", new[1])
    assert re.fullmatch(r"\+1\.[2-9]\d\d\.555\.\d{4}", new[2])
    digits = new[3].replace(" ", "")
    assert re.fullmatch(r"4\d{3}( \d{4}){3}", new[3]) and pii.luhn(digits[:-1]) == int(digits[-1])
    assert int("".join(str(int(c, 36)) for c in new[5].replace(" ", "")[4:] + "DE" + new[5][2:4])) % 97 == 1
    assert new[6].endswith(("na", "ra", "la", "lia")) and re.fullmatch("[А-Я][а-я]+", new[8])


def test_gender_shows_in_every_script():
    assert (found := pii.detect("Monsieur Xavier Dupont"))[0].gender == "m" and found[1].gender == ""
    word = lambda w, g="": pii.surrogate("name", w, KEY, gender=g)
    for w in ("xavier", "robin", "alex"):
        assert word(w, "m").endswith(("no", "ro", "do", "lo", "us")) and word(w, "f").endswith(("na", "ra", "la", "lia"))
    man, woman = word("иванов"), word("иванова")
    assert woman == man + "а" and man.endswith(("в", "н"))
    assert word("παπαδόπουλος").endswith("ος") and word("παπαδοπούλου").endswith("ου")


def brute_emails(text):
    pattern = r"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ._%+-]*[A-Za-z0-9À-ÿ_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
    return [m.span() for m in re.finditer(pattern, text)]


def test_emails_are_found_in_linear_time():
    rng = random.Random(15)
    for _ in range(20_000):
        text = "".join(rng.choice("ab.1-@@_ é") for _ in range(rng.randint(3, 16)))
        got = [(x.start, x.end) for x in pii._first_wins(list(pii._emails(text)))]
        assert got == brute_emails(text) or "@" in text[text.find("@") + 1 :], text
    import time

    began = time.time()
    for text in ("x" * 300_000 + "@", "x" * 100_000 + "@" + "y" * 100_000 + ".com", "a@b." * 50_000, "@" * 100_000, "Mr " + "A" + "b" * 200_000, "James " * 30_000, "1" * 200_000, "+1 " * 50_000):
        pii.detect(text)
    assert time.time() - began < 6


def test_long_local_parts_change_throughout():
    local = "ab" * 3000
    new = pii.surrogate("email", local + "@x.com", KEY)
    got = new.split("@")[0]
    assert len(got) == len(local) and sum(a == b for a, b in zip(got, local, strict=True)) < 0.1 * len(local)


def test_overlaps_are_settled_alike_at_every_length():
    text = "Mr Smith met Mr James John Smith."
    few = pii.detect(text)
    many = pii.detect(text + " Mail a@b.example.com" * 2500)
    assert [x.value for x in few] == ["smith", "james", "john", "smith"]
    assert len(many) == len(few) + 2500 and many[: len(few)] == few


def brute_first_wins(found):
    kept = []
    for x in found:
        if not any(x[0] < y[1] and y[0] < x[1] for y in kept):
            kept.append(x)
    return kept


def test_first_wins():
    rng = random.Random(12)
    for n in (0, 1, 5, 40, 400, 2500):
        found = [(a, a + rng.randint(1, 9), rng.choice("abc"), "") for a in (rng.randrange(3 * n) for _ in range(n))]
        assert pii._first_wins(found) == brute_first_wins(found)


@pytest.mark.parametrize("most", [500_000, 0])
def test_names_keep_persons_apart_and_together(spark, most):
    texts = [
        "Mr Daniel Smith and Mr Robert Smith met Mary Smith.",
        "Dr Alex Petrov spoke. Later Alex Petrov left, and Petrov slept.",
        "Mr Alex Petrov again, Mr Alex, Dr Alex. ALEX?",
        "Ms Robin Stone, or Mr Robin Stone. Ms Xenia Stone.",
        "Dr Xenia Stone. госпожа Иванова, господин Иванов; Κυρία Παπαδοπούλου.",
        "nothing here, Alex.",
    ]
    got = {k: r["text"] for k, r in replaced(texts, spark, broadcast=most).items()}
    first = re.fullmatch(r"Mr (\w+) (\w+) and Mr (\w+) \2 met (\w+) \2\.", got[0])
    assert first and len({"Daniel", "Robert", "Mary", "Smith", *first.groups()}) == 8
    second = re.fullmatch(r"Dr (\w+) (\w+) spoke\. Later \1 \2 left, and \2 slept\.", got[1])
    alex, petrov = second.groups()
    assert got[2].startswith(f"Mr {alex} {petrov} again, Mr {alex}, Dr {alex}. ") and alex.endswith(("no", "ro", "do", "lo", "us"))
    third = re.fullmatch(r"Ms (\w+) (\w+), or Mr \1 \2\. Ms (\w+) \2\.", got[3])
    assert got[4].startswith(f"Dr {third[3]} {third[2]}. ") and third[3].endswith(("na", "ra", "la", "lia"))
    him = re.search(r"господин ([А-Я][а-я]+);", got[4])[1]
    assert f"госпожа {him}а," in got[4] and "Παπαδοπούλου" not in got[4]
    assert got[5] == texts[5]


@pytest.mark.parametrize("most", [500_000, 0])
def test_surrogates_are_distinct_and_consistent(spark, most):
    real = pii.surrogate

    def crowded(kind, value, key, attempt=0, gender=""):  # first surrogates collide, second ones are entities, the third are free
        last = int(value.split(".")[3]) if kind == "ip" else 0
        return (f"10.0.0.{last % 7}", f"20.0.0.{last}", f"30.0.0.{last}")[min(attempt, 2)] if kind == "ip" else real(kind, value, key, attempt, gender)

    rows = [(k, f"see 20.0.0.{k % 40} and again 20.0.0.{k % 40}.\nA b@c.example.com") for k in range(80)] + [(80, None), (81, "")]
    entities = spark.createDataFrame([("ip", f"20.0.0.{k}", "") for k in range(40)], "kind string, value string, gender string")
    attempts = {r["value"]: r["attempt"] for r in pii.exceptions(entities, KEY, crowded).collect()}
    made = [crowded("ip", f"20.0.0.{k}", KEY, attempts.get(f"20.0.0.{k}", 0)) for k in range(40)]
    assert Counter(attempts.values()) == {2: 33} and len(set(made)) == 40 and not set(made) & {f"20.0.0.{k}" for k in range(40)}
    got = replaced(rows, spark, broadcast=most)
    seen = {}
    for d, _ in rows[:80]:
        new = re.findall(r"\d+\.\d+\.\d+\.\d+", got[d]["text"])
        assert len(new) == 2 and new[0] == new[1]
        seen.setdefault(d % 40, set()).add(new[0])
        assert len(got[d]["entities"]) == 3 and "b@c" not in got[d]["text"]
    assert all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == 40
    assert got[80]["text"] is None and got[81]["text"] == ""
    assert pii.replace_entities(odd(spark), KEY, broadcast=most).count() == len(ODD)
    assert set(pii.replace_entities(odd(spark), KEY, broadcast=most).columns) == set(odd(spark).columns)
    assert pii.replace_entities(empty(spark), KEY, broadcast=most).count() == 0
    with pytest.raises(ValueError, match="key"):
        pii.replace_entities(empty(spark), b"")


def test_exceptions_resolve_collisions(spark):
    # 700 of the 1,000 numbers of three digits are entities: not enough are free.
    rows = [("phone", f"{d}", "") for d in range(100, 800)]
    entities = spark.createDataFrame(rows, "kind string, value string, gender string")
    odd_ones = {r["value"]: r["attempt"] for r in pii.exceptions(entities, b"k").collect()}
    new = {v: pii.surrogate("phone", v, b"k", odd_ones.get(v, 0)) for _, v, _ in rows}
    assert len(set(new.values())) == len(rows)
    assert not set(new.values()) & set(new)


def test_given_names_stay_distinct(spark):
    other = [f"{a}{b}" for a in ("xav", "walt", "gord", "bern", "ott", "fel") for b in ("ier", "er", "on", "ard", "is", "ix", "en", "ulf")]
    names = {x.lower() for g in "mf" for x in pii.GIVEN[g]} | set(other) | {"иван", "νίκος"} | {f"name{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"}
    rows = [("name", n, "m" if k % 3 == 0 else "") for k, n in enumerate(sorted(names))]
    taken = {r["value"]: (r["attempt"], r["gender"]) for r in pii.exceptions(spark.createDataFrame(rows, "kind string, value string, gender string"), KEY).collect()}
    new = {v: pii.surrogate("name", v, KEY, *taken.get(v, (0, ""))) for _, v, _ in rows}
    assert len(set(new.values())) == len(rows)
    assert not set(new.values()) & set(new)


def test_surrogates_of_a_table(spark):
    """No original entity is left in its text, the mapping is one to one, and the rest of the text stays."""
    d = docs(spark).select("doc_id", "text").collect()
    got = replaced([(r["doc_id"], r["text"]) for r in d], spark)
    forward, back = {}, {}
    one_word = ("name", "email", "ip", "ssn")
    for r in d:
        at, pattern, spots = 0, "", got[r["doc_id"]]["entities"]
        for e in spots:
            pattern += re.escape(r["text"][at : e["start"]]) + (r"(\S+?)" if e["kind"] in one_word else "(.+?)")
            at = e["end"]
        new = re.fullmatch(pattern + re.escape(r["text"][at:]), got[r["doc_id"]]["text"], re.S)
        assert new, r["doc_id"]
        for e, x in zip(spots, new.groups(), strict=True):
            if e["kind"] in one_word:
                a, b = (e["kind"], r["text"][e["start"] : e["end"]].lower()), (e["kind"], x.lower())
                assert forward.setdefault(a, b) == b and back.setdefault(b, a) == a and a != b
    assert len(forward) >= 8


# ----------------------------------------------------------------------- shared
def test_bloom_has_no_false_negatives(spark):
    df = spark.range(5000).select((F.col("id") * 7919).alias("k"))
    bits = bloom(df, "k", 5000)
    keys = np.arange(5000) * 7919
    assert bloom_hits(bits, keys).all()
    assert bloom_hits(bits, keys + 1).mean() < 0.05


def test_scratch_tables_go(spark):
    from corpusloom.llm import scratch

    before = list(scratch._made)
    with scratch.passing(spark) as keep:
        a, b = (scratch.materialize(spark.range(3), "t") for _ in "ab")
        keep.append(a)
    assert scratch._made == [*before, a.scratch_path] and a.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(b.scratch_path).count()
    scratch.drop(a)
    assert scratch._made == before


def test_no_folder_of_our_own_on_a_cluster():
    from types import SimpleNamespace

    from corpusloom.llm import scratch

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(far)


def _value(x):
    x = x.item() if hasattr(x, "item") else x
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(repr([_value(x) for x in r]) for r in df[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    d, columns = docs(spark), docs(spark).columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == columns, name
        d = spark.createDataFrame(out.collect(), out.schema)
    assert 0 < d.count() < docs(spark).count()
    left = {r["doc_id"] for r in d.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == left
    assert [r["n_hit"] for r in decontam.contamination(d, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()] == [0] * len(left)


def test_pipeline_line_dedup_keeps_every_document(spark):
    import corpus_pipeline

    copied = "one line\nand another"
    rows = [(k, copied, "en", "s", len(copied)) for k in range(12)] + [(12, "a line of its own", "en", "s", 17), (13, None, "en", "s", None)]
    given = spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    got = stages["line dedup"](spark, given, SF).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(14))
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["doc_id"] < 12)
    assert [r["text"] for r in got if r["doc_id"] == 12] == ["a line of its own"]


def test_pipeline_near_dedup_loses_no_text(spark):
    import corpus_pipeline

    rows = [(d, t, "en", "s", len(t or "")) for d, t in ODD]
    given = spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, given, SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(ODD) - Counter([(4, "a")])
    for name, stage in corpus_pipeline.STAGES[1:]:
        if name != "MinHash near-dedup":
            assert {r["doc_id"] for r in stage(spark, given, SF).collect()} == {d for d, _ in ODD}, name
