"""Label model: from votes to probabilities of RISK.

Spark reduces the table to vote patterns and then to the second moments of the 36 vote indicators
(18 functions x 2 votes).  Only that fixed-size matrix reaches the driver, where the conditional vote
probabilities are fitted by matrix completion (Ratner et al., "Training Complex Models with Multi-Task
Weak Supervision", 2019).  Applying the model is a column expression again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import ABSTAIN, HIGH_CONFIDENCE, LF_NAMES, RISK, SAFE
from plumbline.sources.tables import LF_ACCURACY, union_all

LARGEST_FLOOR = 0.01


def floor(n_rows: int) -> float:
    """Least conditional probability: 1 % for small tables, and below one row's share for larger ones, so that the
    votes of a rare function keep their weight."""
    return min(LARGEST_FLOOR, 10.0 ** -math.ceil(math.log10(max(n_rows, 1))))


def moments(patterns: DataFrame, names: Sequence[str] = LF_NAMES) -> DataFrame:
    """(a, b, value): share of rows in which indicators a and b both hold; a = 2 * function + vote.

    A pattern expands to at most 18 x 18 indicator pairs, whatever the number of its rows.
    """
    active = F.filter(
        F.array(*[F.when(F.col(n) != ABSTAIN, F.lit(2 * j) + F.col(n).cast("int")) for j, n in enumerate(names)]),
        lambda x: x.isNotNull(),
    )
    total = patterns.agg(F.sum("n")).scalar()
    firsts = patterns.select("n", active.alias("_on")).select("n", "_on", F.explode_outer("_on").alias("a"))
    pairs = firsts.filter(F.col("a").isNotNull()).select("n", "a", F.explode_outer("_on").alias("b"))
    return pairs.groupBy("a", "b").agg((F.sum("n") / total).alias("value"))


def fit(moment_rows: DataFrame, n_functions: int = len(LF_NAMES), epochs: int = 500, rate: float = 0.01,
        n_rows: int = 100) -> np.ndarray:
    """mu[indicator, class] = P(vote | class), from at most (2 * n_functions)^2 moment rows over ``n_rows`` rows.

    Deterministic full-batch gradient descent from a fixed start with uniform class balance.
    """
    size = 2 * n_functions
    second = np.zeros((size, size))
    for row in moment_rows.collect():
        second[row["a"], row["b"]] = row["value"]
    owner = np.arange(size) // 2
    across = (owner[:, None] != owner[None, :]).astype(float)
    prior = np.array([0.5, 0.5])
    seen = np.diag(second)
    agrees = (np.arange(size) % 2)[:, None] == np.arange(2)[None, :]
    low = floor(n_rows)
    mu = np.clip(np.where(agrees, 1.4, 0.6) * seen[:, None], low, 1 - low)
    for _ in range(epochs):
        gap = (mu * prior) @ mu.T - second
        marginal = mu @ prior - seen
        slope = 4 * (across * gap) @ (mu * prior) + 2 * np.outer(marginal, prior)
        mu = mu - rate * slope
    return np.clip(mu, low, 1 - low)


def params(mu: np.ndarray, spark, names: Sequence[str] = LF_NAMES) -> DataFrame:
    rows = [
        (names[i // 2], i % 2, float(mu[i, 0]), float(mu[i, 1])) for i in range(mu.shape[0])
    ]
    return spark.createDataFrame(rows, "lf string, vote int, p_given_safe double, p_given_risk double")


def fixed_log_odds(names: Sequence[str] = LF_NAMES) -> dict[str, tuple[float, float]]:
    """Evidence for RISK of a SAFE and of a RISK vote under assumed accuracies."""
    odds = [math.log(a / (1 - a)) for a in LF_ACCURACY]
    return {n: (-o, o) for n, o in zip(names, odds)}


def fitted_log_odds(mu: np.ndarray, names: Sequence[str] = LF_NAMES) -> dict[str, tuple[float, float]]:
    """log P(vote | RISK) - log P(vote | SAFE) for both votes of each function."""
    logs = np.log(mu)
    return {n: tuple(float(logs[2 * j + v, 1] - logs[2 * j + v, 0]) for v in (SAFE, RISK)) for j, n in enumerate(names)}


def _evidence(log_odds: dict[str, tuple[float, float]]) -> Column:
    return sum(
        (F.when(F.col(n) == SAFE, F.lit(s)).when(F.col(n) == RISK, F.lit(r)).otherwise(0.0) for n, (s, r) in log_odds.items()),
        F.lit(0.0),
    )


def soft_labels(votes: DataFrame, log_odds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add P(SAFE) and P(RISK); rows without votes get one half each."""
    risk = 1.0 / (1.0 + F.exp(-_evidence(log_odds or fixed_log_odds())))
    # A one-row generator keeps later filters on the probabilities above the votes.  Pushed below, a
    # filter would repeat every text search of the eighteen functions.
    pair = F.struct((1.0 - risk).alias("risk_prob_safe"), risk.alias("risk_prob_risk"))
    return votes.select("*", F.inline(F.array(pair)))


def hard_labels(soft: DataFrame) -> DataFrame:
    """Binary label, label name and confidence.  Ties go to SAFE, a missing probability counts as one half."""
    safe, risk = (F.coalesce(F.col(f"risk_prob_{k}"), F.lit(0.5)) for k in ("safe", "risk"))
    binary = F.when(F.round(risk, 12) > F.round(safe, 12), RISK).otherwise(SAFE)
    return (
        soft.withColumn("risk_prob_safe", safe)
        .withColumn("risk_prob_risk", risk)
        .withColumn("risk_label_binary", binary)
        .withColumn("risk_label", F.when(binary == RISK, "RISK").otherwise("SAFE"))
        .withColumn("risk_confidence", F.greatest("risk_prob_safe", "risk_prob_risk"))
    )


LABEL_COLUMNS = ["risk_label_binary", "risk_label", "risk_prob_safe", "risk_prob_risk", "risk_confidence"]


def label_rows(cleaned: DataFrame, votes: DataFrame, log_odds=None) -> DataFrame:
    """Cleaned stories with the five label columns.

    ``votes`` must come from ``apply_functions(cleaned, keep=cleaned.columns)``: labels are then one more
    projection over the same rows and nothing is joined.
    """
    return hard_labels(soft_labels(votes, log_odds)).select(*cleaned.columns, *LABEL_COLUMNS)


def label_stats(labeled: DataFrame) -> DataFrame:
    """Label counts, confidence statistics and the number of highly confident rows.

    Confidence takes one value per vote pattern, so counting its distinct values keeps the exact median
    small however many rows there are.
    """
    by_value = labeled.groupBy("risk_label", "risk_confidence").agg(F.count("*").alias("n"))
    c, n = F.col("risk_confidence"), F.col("n")
    return by_value.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("risk_label") == "SAFE", n).otherwise(0)).alias("n_safe"),
        F.sum(F.when(F.col("risk_label") == "RISK", n).otherwise(0)).alias("n_risk"),
        (F.sum(c * n) / F.sum("n")).alias("mean"),
        F.percentile(c, 0.5, n).alias("median"),
        F.min(c).alias("min"), F.max(c).alias("max"),
        F.sum(F.when(c > HIGH_CONFIDENCE, n).otherwise(0)).alias("n_high_confidence"),
    )


def weak_label_metrics(summary: DataFrame, overall: DataFrame, stats: DataFrame) -> DataFrame:
    """Coverage per function, overall votes and label statistics as metric rows."""
    from plumbline.operators.evaluation import metrics_long

    per_function = summary.select(
        F.lit("weak_labels").alias("stage"), F.concat(F.lit("lf_coverage/"), "lf").alias("metric"),
        F.col("coverage").alias("value"),
    )
    return union_all(
        [
            per_function,
            metrics_long(overall, "weak_labels", ["n_rows", "coverage", "mean_votes", "n_conflicting", "pct_conflicting"]),
            metrics_long(stats, "weak_labels", ["n_safe", "n_risk", "mean", "median", "min", "max", "n_high_confidence"]),
        ]
    )
