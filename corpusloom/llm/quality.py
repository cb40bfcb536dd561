"""Quality rules with risk-controlled cutoffs, in DataFrame and SQL functions only.

Base rules are fixed.  Beyond them, each rule (a ratio that is higher for worse
texts) gets a cutoff for each stratum (language) from labelled documents: of a
grid fixed in advance, the lowest cutoff of which the exact binomial test shows
that it rejects less than ALPHA / rules of the good documents.  The level DELTA
is divided by all tests made (strata x rules x cutoffs), so that with
probability 1 - DELTA all chosen cutoffs hold at once, and a stratum loses at
most ALPHA of its good documents to all rules together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import put_back, set_aside

ALPHA = 0.05
DELTA = 0.05
MAX_BROADCAST_ROWS = 10_000  # strata with a cutoff; more are joined

_SPACE = r"\\x20\\x09-\\x0D"
#: Rule -> ratio of metrics, higher for worse texts.  Twelve cutoffs each.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_full_lines, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
}
METRICS = ("word_chars", "n_symbols", "n_capitals", "n_shouts", "n_words", "n_full_lines", "n_dup_lines", "n_repeat_words", "base_failed")
GRID = tuple(round(0.02 * 1.45**k, 4) for k in range(12))


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and binds it to name in body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(width: int = 8) -> str:
    """Words inside runs of `width` words that the text has twice or more, from the array `_w`.

    Runs are compared by hashes of the hashes of their words.  Only texts
    with a repeated run are sorted.
    """
    runs = f"transform(sequence(1, size(h) - {width - 1}), i -> xxhash64(slice(h, i, {width})))"
    same = "filter(sequence(0, size(s) - 1), j -> (j > 0 AND s[greatest(j - 1, 0)].g = s[j].g) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].g = s[j].g))"
    starts = f"array_sort(transform({same}, j -> s[j].i))"
    covered = f"aggregate(sequence(0, size(p) - 1), 0L, (n, k) -> n + CASE WHEN k = size(p) - 1 THEN {width}L ELSE least({width}L, CAST(p[least(k + 1, size(p) - 1)] - p[k] AS BIGINT)) END)"
    found = _let("sort_array(transform(g, (x, i) -> struct(x AS g, i AS i)))", "s", _let(starts, "p", covered))
    counted = _let(runs, "g", f"CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {found} END")
    return f"CASE WHEN size(_w) < {width + 1} THEN 0L ELSE {_let('transform(_w, w -> xxhash64(w))', 'h', counted)} END"


def measured(docs: DataFrame) -> DataFrame:
    """docs with the metrics of every whole text (null: no words, no lines).

    Metric columns of the input, and kept, are replaced; others stay, whatever
    their names.
    """
    text = "coalesce(CAST(text AS STRING), '')"
    plain = {
        "word_chars": f"CAST(length(regexp_replace({text}, '[{_SPACE}]+', '')) AS BIGINT)",
        "n_symbols": f"CAST(length({text}) - length(regexp_replace({text}, '[#*$%&|<>]+', '')) AS BIGINT)",
        "n_capitals": f"CAST(length({text}) - length(regexp_replace({text}, '[A-Z]+', '')) AS BIGINT)",
        "n_shouts": f"CAST(length({text}) - length(replace({text}, '!', '')) AS BIGINT)",
        "_w": f"regexp_extract_all({text}, '[^{_SPACE}]+', 0)",
        "_l": f"filter(split({text}, '\\n'), x -> x RLIKE '[^{_SPACE}]')",
    }
    derived = {
        "n_words": "CAST(size(_w) AS BIGINT)",
        "n_full_lines": "CAST(size(_l) AS BIGINT)",
        "n_dup_lines": "CAST(size(_l) - size(array_distinct(_l)) AS BIGINT)",
        "n_repeat_words": _repeat_words(),
    }
    docs, given = set_aside(docs, ("doc_id", "text", "lang"), (*METRICS, "kept"))
    out = docs.withColumns({k: F.expr(v) for k, v in plain.items()})
    out = out.withColumns({k: F.expr(v) for k, v in derived.items()}).drop("_w", "_l")
    return put_back(out.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")), given)


def _log_factorial(n: str) -> str:
    """ln n! by Stirling's series at n + 9, divided down to n."""
    x = f"(({n}) + 9.0D)"
    down = " * ".join(f"(({n}) + {k}.0D)" for k in range(1, 9))
    return f"(({x} - 0.5D) * ln({x}) - {x} + 0.91893853320467274178D + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}) + 1 / (1260 * {x} * {x} * {x} * {x} * {x}) - ln({down}))"


def binomial_tail(n: str, k: str, p: float) -> str:
    """SQL: the probability of at most k successes in n trials of chance p (1 where k >= n * p).

    Terms more than 50 standard deviations below k are under 1e-300 and left out.
    """
    low = f"greatest(0L, {k} - 100 - 50 * CAST(ceil(sqrt({n} * {p}D)) AS BIGINT))"
    term = f"exp({_log_factorial(n)} - {_log_factorial('i')} - {_log_factorial(f'{n} - i')} + i * ln({p}D) + ({n} - i) * ln(1 - {p}D))"
    return f"CASE WHEN {k} >= {n} * {p}D THEN 1.0D ELSE aggregate(sequence({low}, {k}), 0.0D, (t, i) -> t + {term}) END"


def stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def select_cutoffs(metrics: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, and a column for each rule: its cutoff, or null where none is shown to be safe.

    metrics: measured() rows with doc_id and lang; labels: doc_id and quality
    (1: good; null: not labelled).  Documents that the base rules reject are
    not counted.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    held = metrics.where("NOT base_failed").select("doc_id", stratum().alias("stratum"), *[F.expr(e).alias(r) for r, e in RULES.items()]).join(good, "doc_id", "left_semi")
    # The cutoffs that a document is over: those below its ratio.
    over = {f"{r}_{k}": F.sum(F.when(F.col(r) > c, 1).otherwise(0)) for r in RULES for k, c in enumerate(GRID)}
    counted = held.groupBy("stratum").agg(F.count("*").alias("n"), *[v.cast("long").alias(k) for k, v in over.items()])
    strata = counted.agg(F.count("*").alias("strata"))  # one row
    level = F.lit(delta) / (F.col("strata") * len(RULES) * len(GRID))
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{k}").alias("k")) for r in RULES for k, c in enumerate(GRID)])
    each = counted.join(F.broadcast(strata)).select("stratum", "n", level.alias("level"), F.explode(tests).alias("t")).select("stratum", "n", "level", "t.*")  # one row is broadcast
    safe = each.where(F.expr(binomial_tail("n", "k", alpha / len(RULES))) <= F.col("level"))
    return safe.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judged(metrics: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """metrics with kept: false where the base rules or a cutoff reject the document."""
    n = cutoffs.count()
    metrics, given = set_aside(metrics, ("doc_id", "text", "lang", *METRICS), ("kept",))
    keyed = cutoffs.withColumnRenamed("stratum", "_stratum")
    side = F.broadcast(keyed) if n <= MAX_BROADCAST_ROWS else keyed
    joined = metrics.withColumn("_stratum", stratum()).join(side, "_stratum", "left")
    rejected = F.lit(False)
    for r, e in RULES.items():
        rejected = rejected | F.coalesce(F.expr(e) > F.col(f"cut_{r}"), F.lit(False))
    out = joined.withColumn("kept", ~F.col("base_failed") & ~rejected)
    return put_back(out.select(*metrics.columns, "kept"), given)
