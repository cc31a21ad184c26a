"""Risk-controlled quality rules, in DataFrame functions only.

Per document: counts of words, characters in words, symbols, repeated lines and words in repeated three-word windows.
The fixed base rules come first.  On top, each of four rates has an upper cutoff per stratum.  Candidate cutoffs are
quantiles of the labelled good documents of one half (proposal); each is tested on the other half (holdout), which no
candidate has seen.  Halves are dealt by the hash of the text and a text counts once in its stratum, so exact copies
never stand in both and do not pass for evidence of their own.  The rates share the ``risk`` in equal parts.  The null
hypothesis "this cutoff rejects more than its rate's part of the good texts of the stratum" is tested with the exact
binomial lower tail of the number of false rejections, and all hypotheses of all strata, rates and quantiles share the
error ``delta`` by Bonferroni's correction.  With probability ``1 - delta`` the cutoffs in use together therefore reject
at most ``risk`` of the distinct good texts of any stratum, among those that pass the base rules: what these fixed rules
reject lies outside the promise, and near copies count as different texts.  Of the proven cutoffs of a rate the
strictest is used; without a proven one the rate rejects nothing in that stratum.

Defined results: a null or empty text has no words and fails the base rules; a null stratum is a stratum; a stratum
without labels rejects by the base rules only; labels that are null or refer to no document are ignored; documents
repeated with the same id are judged one by one, and a repeated label or labelled text counts once; an empty table
gives no row; a text of any length is one row of its task; columns of other names are not looked at, clashing ones
included.  Rates of texts that fail the base rules are not used for cutoffs; a value equal to its cutoff is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text_blocks import fresh, stored

RISK = 0.04  # share of good texts that all rates together may reject in a stratum
DELTA = 0.05  # chance that any cutoff breaks that
QUANTILES = [995, 998, 1000]  # of a thousand
# Rate: counts above and below, and steps of the grid it is rounded up to.  The grid bounds the distinct values.
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 1000),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000),
    "repeat_rate": ("n_repeat_words", "n_words", 1000),
    "mean_length": ("word_chars", "n_words", 10),
}
SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]+"
TAIL_WIDTHS = 40  # standard deviations summed below k; what lies further is less than 1e-300 of the sum


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus a struct ``m`` of the counts (steps of their own keep Spark from repeating them).

    Windows are told apart by their 64-bit code.  Sorted by code, equal windows are neighbours.  Each window that has an
    equal one adds the words up to the next such window, three at most.
    """
    names = [fresh(docs, x) for x in ("_words", "_lines", "_windows", "_places")]
    words, lines, windows, places = names
    rest = [c for c in docs.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(
        *rest,
        F.filter(F.split(whole, SPACE), lambda w: w != "").alias(words),
        F.filter(F.split(whole, "\n"), lambda line: line.rlike(NOT_SPACE)).alias(lines),
        (F.char_length(whole) - F.char_length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("_symbols"),
    )
    none = F.expr("cast(array() AS array<struct<c:bigint,i:int>>)")
    coded = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))),
        lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("c"), i.alias("i")),
    )
    step = step.withColumn(windows, F.when(F.size(words) >= 3, F.sort_array(coded)).otherwise(none))

    def code(k: Column) -> Column:
        return F.get(windows, k)["c"]

    twice = F.filter(windows, lambda x, k: F.coalesce(code(k - 1) == x["c"], F.lit(False)) | F.coalesce(
        code(k + 1) == x["c"], F.lit(False)))
    step = step.withColumn(places, F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, g: a + g,
    )
    return step.select(*rest, F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        covered.alias("n_repeat_words"),
    ).alias("m")).select(*rest, "m", base_failed(F.col("m")).alias("base_failed"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def rate(m: Column, name: str) -> Column:
    """One of the four rates in whole steps of its grid, rounded up; 0 where there is nothing to divide by."""
    above, below, steps = RATES[name]
    return F.when(m[below] > 0, F.floor((steps * m[above] + m[below] - 1) / m[below])).otherwise(0).cast("long")


def log_gamma(x: Column) -> Column:
    """log Gamma for x >= 1: Stirling's series ten steps up, then down by the product."""
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = x
    for k in range(1, 10):
        product = product * (x + k)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) at probability p, for k below n * p; else 1, which proves nothing."""
    k, n = k.cast("double"), n.cast("double")
    log_term = (
        log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
        + k * math.log(p) + (n - k) * math.log(1 - p)
    )
    steps = F.least(k, F.ceil(TAIL_WIDTHS * F.sqrt(n)) + 100).cast("int")
    # Terms below k follow from the one above by a ratio under 1.
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: F.struct(
            (a["sum"] + a["term"]).alias("sum"),
            (a["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"),
        ),
        lambda a: a["sum"],
    )
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(log_term) * total)).otherwise(1.0)


def good_documents(measured_docs: DataFrame, labels: DataFrame, ident: str, stratum: str) -> DataFrame:
    """Rates of the distinct labelled good texts that pass the base rules, with stratum and half.

    ``measured_docs`` has the md5 of each text as ``digest``.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("label_id"))
    scored = measured_docs.where("NOT base_failed").select(
        F.col(ident).alias("id"), F.col(stratum).alias("stratum"), "digest", *[rate(F.col("m"), r).alias(r) for r in RATES]
    )
    half = (F.substring("digest", 1, 1) >= "8").cast("int").alias("half")
    known = scored.join(good, F.col("id") == F.col("label_id"))
    return known.select("stratum", "digest", half, *RATES).distinct().drop("digest")


def cutoffs(good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rate, cutoff, k, n, p, proven): all candidates with their test."""
    long = good.unpivot(["stratum", "half"], list(RATES), "rate", "value")
    by_value = long.groupBy("stratum", "half", "rate", "value").agg(F.count("*").alias("n"))
    # Discrete quantiles from the counts of the grid values, which are few in any stratum.
    ordered = Window.partitionBy("stratum", "rate").orderBy("value")
    filled = by_value.where("half = 0").withColumns({
        "below": F.sum("n").over(ordered), "all": F.sum("n").over(Window.partitionBy("stratum", "rate"))
    })
    picks = [F.min(F.when(1000 * F.col("below") >= q * F.col("all"), F.col("value"))) for q in QUANTILES]
    candidates = (
        filled.groupBy("stratum", "rate")
        .agg(F.array(*picks).alias("q"))
        .select("stratum", "rate", F.explode(F.array_distinct("q")).alias("cutoff"))
    )
    holdout = by_value.where("half = 1").withColumnsRenamed({"stratum": "s", "rate": "r"})
    tested = (
        candidates.join(holdout, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rate") == F.col("r")))
        .groupBy("stratum", "rate", "cutoff")
        .agg(F.sum(F.when(F.col("value") > F.col("cutoff"), F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("n"))
        .withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk / len(RATES)))
    )
    hypotheses = candidates.agg(F.count("*").alias("hypotheses")).scalar()
    return tested.withColumn("proven", F.col("p") <= delta / hypotheses)


def thresholds(tested: DataFrame) -> DataFrame:
    """One row per stratum: the strictest proven cutoff of each rate, null where none is proven."""
    return tested.groupBy("stratum").agg(
        *[F.min(F.when((F.col("rate") == r) & F.col("proven"), F.col("cutoff"))).alias(f"max_{r}") for r in RATES]
    )


def judge(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", stratum: str = "lang",
          risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per document: id, stratum, ``m``, base_failed and the verdict kept.

    ``kept`` means: not failed by the base rules and within every proven cutoff of the stratum.  The counts are stored
    once, without texts.
    """
    found = measured(docs.select(
        F.col(ident).alias("id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
    ))
    found = stored(found, "quality-counts")
    limits = thresholds(cutoffs(good_documents(found, labels, "id", "stratum"), risk, delta))
    limits = limits.withColumnRenamed("stratum", "limit_stratum")
    met = found.join(limits, F.col("stratum").eqNullSafe(F.col("limit_stratum")), "left")
    within = F.lit(True)
    for r in RATES:
        within = within & (F.col(f"max_{r}").isNull() | (rate(F.col("m"), r) <= F.col(f"max_{r}")))
    return met.select("id", "stratum", "m", "base_failed", (~F.col("base_failed") & within).alias("kept"))
