"""Class decisions from probabilities: argmax, renormalisation, cost matrix, assessment records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import CLASS_LABELS, COST_MATRIX
from plumbline.functions.arrays import argmax, argmin, let, literal_array, pick, total

PROBABILITIES = ("p0", "p1", "p2")


def probability_array(columns: Sequence[str] = PROBABILITIES) -> Column:
    return F.array(*[F.col(c) for c in columns])


def with_argmax(df: DataFrame, columns: Sequence[str] = PROBABILITIES) -> DataFrame:
    """Most likely class; the lower class wins ties."""
    return df.withColumn("y_pred", argmax(probability_array(columns)))


def renormalize(df: DataFrame, columns: Sequence[str] = PROBABILITIES) -> DataFrame:
    """Scale a row to sum 1; a row of zeros stays as it is."""
    row_sum = total(probability_array(columns))
    kept = [c for c in df.columns if c not in columns]
    scaled = let(
        row_sum,
        lambda s: F.struct(*[F.when(s != 0, F.col(c) / s).otherwise(F.col(c)).alias(c) for c in columns]),
    )
    # Unfolded by a generator, so that later steps do not repeat these expressions once per use.
    return df.select(*kept, F.inline(F.array(scaled)))


def oriented(matrix: Sequence[Sequence[float]], orientation: str = "predicted_rows") -> list[list[float]]:
    """A cost matrix with predicted classes as rows, whichever way it was written down."""
    if len(matrix) != 3 or any(len(row) != 3 for row in matrix):
        raise ValueError("a cost matrix is 3 x 3")
    if orientation == "true_rows":
        return [[float(matrix[j][i]) for j in range(3)] for i in range(3)]
    if orientation == "predicted_rows":
        return [[float(x) for x in row] for row in matrix]
    raise ValueError(f"unknown orientation {orientation!r}")


def with_cost_decision(
    df: DataFrame, matrix: Sequence[Sequence[float]] = COST_MATRIX, columns: Sequence[str] = PROBABILITIES
) -> DataFrame:
    """Class of least expected cost, with the expected costs and the cost of the choice."""
    costs = [sum((F.col(c) * float(w) for c, w in zip(columns, row)), F.lit(0.0)) for row in matrix]
    return (
        df.withColumn("expected_costs", F.array(*costs))
        .withColumn("y_pred", argmin(F.col("expected_costs")))
        .withColumn("chosen_cost", F.array_min("expected_costs"))
    )


def realized_cost(df: DataFrame, matrix: Sequence[Sequence[float]] = COST_MATRIX) -> DataFrame:
    """Total and average cost of the decisions, with accuracy."""
    flat = literal_array([x for row in matrix for x in row])
    cost = F.element_at(flat, (F.col("y_pred") * 3 + F.col("y") + 1).cast("int"))
    return df.agg(
        F.count("*").alias("n"), F.sum(cost).alias("total_cost"), F.avg(cost).alias("average_cost"),
        F.avg((F.col("y_pred") == F.col("y")).cast("double")).alias("accuracy"),
    )


def cost_matrix(df: DataFrame, miss_ratio: float = 50.0, label: str = "y") -> DataFrame:
    """The matrix for a given cost of missing a High story, next to the class frequencies it was set for."""
    matrix = [[0.0, 2.0, miss_ratio], [1.0, 0.0, miss_ratio / 5], [3.0, 2.0, 0.0]]
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == k).alias(f"c{k}") for k in range(3)])
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("predicted"), F.lit(j).alias("true"), F.lit(matrix[i][j]).alias("cost"),
                (F.col(f"c{j}") / F.col("n")).alias("true_share"),
            )
            for i in range(3)
            for j in range(3)
        ]
    )
    return counts.select(F.inline(cells))


def risk_decision(df: DataFrame, matrix: Sequence[Sequence[float]] = COST_MATRIX) -> DataFrame:
    """Level by least expected cost and the probability of that level in percent."""
    decided = with_cost_decision(df, matrix)
    return decided.withColumn("risk_level", pick(CLASS_LABELS, F.col("y_pred"))).withColumn(
        "confidence", F.element_at(probability_array(), F.col("y_pred") + 1) * 100
    )


def assessments(scored: DataFrame, requests: DataFrame) -> DataFrame:
    """One record per request; requests without a score fall back to Medium / 50."""
    return requests.select("id").join(scored.select("id", "risk_level", "confidence"), "id", "left").select(
        "id",
        F.coalesce("risk_level", F.lit("Medium")).alias("risk_level"),
        F.round(F.coalesce("confidence", F.lit(50.0)), 1).alias("confidence"),
    )
