"""Toxicity: gradient-boosted trees over dense text features, calibrated isotonically.

Features of a whole text: densities of lexicons (a short built-in list of
insults, and words and word beginnings learned from labelled training rows),
second-person pronouns near lexicon hits, capitals, punctuation, obfuscation.
Only training rows (crc32 of the doc_id as text, modulo 5, is not 0) give
labels; label, language, source and doc_id are never inputs of a score.

The model is fitted on at most MAX_FIT_ROWS labelled rows: half of the folds
give the learned lexicon, the other half the trees, and predictions made
across those two folds the calibration.  Scores are for every row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .scratch import put_back, set_aside, small_batches, tidy

MAX_FIT_ROWS = 20_000
MAX_LEXICON = 4_000
MIN_SUPPORT = 4  # toxic training rows that a learned entry is found in
STEMS = (4, 5, 6)  # lengths of word beginnings

# Built-in insults (en, de, fr, es).
INSULTS = frozenset(
    "asshole bastard bitch clown crap damn disgusting dumb fool freak garbage hate idiot idiots jerk kill loser losers moron morons nasty pathetic "
    "pig scum shut stupid sucks trash ugly useless vermin worthless "
    "abschaum arschloch dumm dummkopf hässlich idiotisch miststück schwachkopf trottel verlierer wertlos "
    "abruti connard crétin dégoûtant imbécile minable nul ordure pourri salaud stupide "
    "asqueroso basura cabrón escoria estúpido idiota imbécil inútil mierda patético perdedor tonto".split()
)
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
NEAR = 5  # words between a pronoun and a hit

_WORD = re.compile(r"[^\W\d_]+")
_CHUNK = re.compile(r"\S+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_SPELLED = re.compile(r"(?:\b[^\W\d_][ .\-*_]){3,}[^\W\d_]\b")
FEATURES = (
    "words_log", "insult_rate", "insult_any", "learned_rate", "learned_top", "learned_sum", "learned_kinds", "stem_rate", "stem_top", "stem_sum", "you_rate", "you_near",
    "capital_rate", "capital_words", "exclaim_rate", "question_rate", "punctuation_rate", "symbol_rate", "digit_rate", "leet_rate", "leet_hits", "repeat_rate", "spelled_rate", "word_length",
)


@dataclass
class Lexicon:
    """Log-odds of learned words and word beginnings."""

    words: dict[str, float]
    stems: dict[str, float]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """FEATURES of a text; all 0 for texts without words."""
    text = text or ""
    words = _WORD.findall(text.lower())
    n = len(words)
    chunks = text.split()
    if not n and not chunks:
        return [0.0] * len(FEATURES)
    per = 1 / max(n, 1)
    known, weight = lexicon.words, lexicon.stems
    hits, learned, stems, you = [], [], [], []
    for w, times in Counter(words).items():
        if w in INSULTS:
            hits.append(times)
        if (x := known.get(w)) is not None:
            learned.append((x, times))
        elif len(w) >= STEMS[0]:
            best = max((weight.get(w[:size], 0.0) for size in STEMS), default=0.0)
            if best:
                stems.append((best, times))
        if w in YOU:
            you.append(times)
    near = 0
    if you and (hits or learned):
        at = [k for k, w in enumerate(words) if w in INSULTS or w in known]
        pronouns = np.array([k for k, w in enumerate(words) if w in YOU])
        left = np.searchsorted(pronouns, np.array(at) - NEAR)
        near = int((np.searchsorted(pronouns, np.array(at) + NEAR, side="right") > left).sum())
    odd = [c for c in chunks if not c.isalpha()]
    leet = leet_hits = 0
    for c in odd:
        core = c.strip(".,;:!?\"'()")
        if core and not core.isalpha() and any(x.isalpha() for x in core) and any(x in "013457@$!*" for x in core):
            leet += 1
            plain = core.lower().translate(_LEET)
            leet_hits += plain in INSULTS or plain in known
    letters = sum(map(len, words))
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    punctuation = sum(map(text.count, ".,;:-'\""))
    symbols = sum(map(text.count, "#*$%&|<>@^~"))
    digits = sum(map(text.count, "0123456789"))
    size = max(len(text), 1)
    return [
        math.log1p(n), sum(hits) * per, float(min(sum(hits), 5)), sum(t for _, t in learned) * per, max((x for x, _ in learned), default=0.0), min(sum(x * t for x, t in learned), 60.0),
        float(min(len(learned), 10)), sum(t for _, t in stems) * per, max((x for x, _ in stems), default=0.0), min(sum(x * t for x, t in stems), 60.0), sum(you) * per, near * per,
        capitals / size, sum(c.isupper() and len(c) > 1 for c in chunks) / max(len(chunks), 1), text.count("!") * per, text.count("?") * per, punctuation / size, symbols / size, digits / size,
        leet * per, float(min(leet_hits, 5)), len(_REPEAT.findall(text)) * per, len(_SPELLED.findall(text)) * per, letters * per,
    ]


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@dataclass
class Model:
    lexicon: Lexicon
    trees: gbt.Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return gbt.calibrated(self.trees.margin(x), self.knots)


def _fit_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """fold (1-4), toxic, text of the labelled training rows; a sample by hash of about `most` rows where there are more.

    Labels other than 0 and 1 are none.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    n = train.count()
    if n > most:
        place = F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "doc_id"), 11) / F.lit(float(1 << 53))
        train = train.where(place < most / n)
    return docs.select("doc_id", "text").join(train, "doc_id").select("fold", F.col("toxic").cast("int").alias("toxic"), "text")


def _learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and word beginnings that are far more frequent in toxic rows."""

    def count(batches):
        held: dict[str, list[int]] = {}
        totals = [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                totals[toxic] += 1
                entries = words | {f"{w[:k]}*" for k in STEMS for w in words if len(w) > k}
                for e in entries:
                    held.setdefault(e, [0, 0])[toxic] += 1
        entries = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*entries, ""], pa.string()), pa.array([*(held[e][0] for e in entries), totals[0]], pa.int64()), pa.array([*(held[e][1] for e in entries), totals[1]], pa.int64())],
            names=["entry", "clean", "toxic"],
        )

    counted = rows.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counted.where("entry = ''").collect()
    n0, n1 = (total[0]["clean"], total[0]["toxic"]) if total else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    best = counted.where((F.col("entry") != "") & (F.col("toxic") >= MIN_SUPPORT)).withColumn("odds", odds).where("odds > 1.5")
    top = best.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "entry").limit(MAX_LEXICON).collect()  # bounded by MAX_LEXICON
    words = {r["entry"]: r["odds"] for r in top if not r["entry"].endswith("*")}
    stems = {r["entry"][:-1]: r["odds"] for r in top if r["entry"].endswith("*")}
    return Lexicon(words, stems)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_FIT_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic.  Without labels the score is 0.5 or less everywhere."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _fit_rows(docs, labels, most)
    lexicon = _learn_lexicon(rows.where("fold <= 2"))
    held = spark.sparkContext.broadcast(lexicon)  # at most MAX_LEXICON entries

    def describe(batches):
        for batch in batches:
            x = [features(t, held.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fold").cast(pa.int32()), batch.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["fold", "toxic", "x"])

    got = rows.where("fold > 2").mapInArrow(describe, "fold int, toxic int, x array<double>").collect()  # at most about `most` rows of 24 numbers
    got.sort(key=lambda r: (r["fold"], r["toxic"], r["x"]))
    x = np.array([r["x"] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    y = np.array([r["toxic"] for r in got], dtype=float)
    folds = np.array([r["fold"] for r in got])
    margin = np.zeros(len(got))
    for f in (3, 4):
        margin[folds == f] = gbt.fit(x[folds != f], y[folds != f]).margin(x[folds == f])
    return Model(lexicon, gbt.fit(x, y), gbt.isotonic(margin, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) for every row, null and empty texts too; an input column score is replaced."""
    small_batches(docs.sparkSession)
    docs, given = set_aside(docs, ("doc_id", "text"), ("score",))
    held = docs.sparkSession.sparkContext.broadcast(model)  # trees and lexicon: under 1 MB

    def rate(batches):
        model = held.value
        for batch in batches:
            x = np.array([features(t, model.lexicon) for t in batch.column("text").to_pylist()], dtype=float).reshape(batch.num_rows, len(FEATURES))
            yield batch.append_column("score", pa.array(model.score(x), pa.float64()))

    return put_back(docs.mapInArrow(tidy(rate), docs.limit(0).withColumn("score", F.lit(0.0)).schema), given)
