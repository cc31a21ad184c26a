"""Metrics of class predictions, calibration and ranking quality.

Frames carry the true class ``y`` (0, 1, 2), the decision ``y_pred`` and the probabilities p0, p1, p2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import ratio
from plumbline.operators.decisions import PROBABILITIES, probability_array, with_argmax
from plumbline.operators.ranking import running_totals

CLASSES = (0, 1, 2)


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """All nine cells, empty ones included, with the share within the true class."""
    cells = [(i, j) for i in CLASSES for j in CLASSES]
    counts = df.agg(*[F.count_if((F.col("y") == i) & (F.col("y_pred") == j)).alias(f"c{i}{j}") for i, j in cells])

    def row_total(i: int) -> Column:
        return F.col(f"c{i}0") + F.col(f"c{i}1") + F.col(f"c{i}2")

    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("y"), F.lit(j).alias("y_pred"), F.col(f"c{i}{j}").alias("n"),
                        ratio(100.0 * F.col(f"c{i}{j}"), row_total(i)).alias("row_pct"),
                    )
                    for i, j in cells
                ]
            )
        )
    )


def class_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; an undefined ratio is 0."""
    aggs = []
    for k in CLASSES:
        hit = (F.col("y") == k) & (F.col("y_pred") == k)
        aggs += [
            F.count_if(hit).alias(f"tp{k}"), F.count_if(F.col("y_pred") == k).alias(f"pp{k}"),
            F.count_if(F.col("y") == k).alias(f"ap{k}"),
        ]
    counts = df.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("class"), F.col(f"tp{k}").alias("tp"), F.col(f"pp{k}").alias("pp"),
                F.col(f"ap{k}").alias("support"),
            )
            for k in CLASSES
        ]
    )
    long = counts.select(*by, F.inline(rows))
    tp = F.col("tp")
    return long.select(
        *by, "class",
        ratio(tp, F.col("pp")).alias("precision"), ratio(tp, F.col("support")).alias("recall"),
        ratio(2.0 * tp, F.col("pp") + F.col("support")).alias("f1"), "support",
    )


def f1_summary(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted averages of a class report."""
    aggs = []
    for m in ("precision", "recall", "f1"):
        aggs.append(F.avg(m).alias(f"macro_{m}"))
        aggs.append((F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}"))
    return report.groupBy(*by).agg(*aggs)


def expected_calibration_error(df: DataFrame, n_bins: int = 10, include_one: bool = False) -> DataFrame:
    """ECE over bins closed on the left.  A confidence of exactly 1 is in no bin unless asked for."""
    scored = with_argmax(df).select(
        F.array_max(probability_array()).alias("conf"), (F.col("y_pred") == F.col("y")).cast("double").alias("hit")
    )
    conf = F.col("conf")
    step = 1.0 / n_bins
    number = sum((conf >= F.lit(i * step)).cast("int") for i in range(1, n_bins))
    binned = scored.withColumn("bin", number)
    totals = binned.groupBy("bin").agg(
        F.count("*").alias("_all"), F.count_if(conf < 1.0).alias("_below"),
        F.sum(F.when(conf < 1.0, conf)).alias("_conf"), F.sum(F.when(conf < 1.0, F.col("hit"))).alias("_hit"),
        F.sum(conf).alias("_conf_all"), F.sum("hit").alias("_hit_all"),
    )
    used, c, h = ("_all", "_conf_all", "_hit_all") if include_one else ("_below", "_conf", "_hit")
    gap = F.when(F.col(used) > 0, F.abs(F.col(h) - F.col(c))).otherwise(0.0)
    return totals.agg(F.sum("_all").alias("n"), (F.sum(gap) / F.sum("_all")).alias("ece"))


def per_class(df: DataFrame) -> DataFrame:
    """One row per story and class: (class, score, positive)."""
    rows = [
        F.struct(F.lit(k).alias("class"), F.col(p).alias("score"), (F.col("y") == k).cast("int").alias("positive"))
        for k, p in zip(CLASSES, PROBABILITIES)
    ]
    return df.select(F.inline(F.array(*rows)))


def calibration_curve(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Observed and predicted share per class and bin; bins are closed on the right."""
    step = 1.0 / n_bins
    number = sum((F.col("score") > F.lit(i * step)).cast("int") for i in range(1, n_bins))
    return per_class(df).withColumn("bin", number).groupBy("class", "bin").agg(
        F.count("*").alias("n"), F.avg("positive").alias("fraction_positive"), F.avg("score").alias("mean_predicted")
    )


def calibration_gap(curve: DataFrame) -> DataFrame:
    """Mean distance of a class's curve from the diagonal, every bin alike."""
    return curve.groupBy("class").agg(F.avg(F.abs(F.col("fraction_positive") - F.col("mean_predicted"))).alias("gap"))


def threshold_curve(df: DataFrame) -> DataFrame:
    """Cumulative positives and negatives per class, from the highest score down.

    Equal scores collapse first, so a score shared by a third of all rows is one row; the running sums
    go through range-partitioned slices instead of one task per class.
    """
    collapsed = per_class(df).groupBy("class", "score").agg(
        F.sum("positive").alias("pos"), (F.count("*") - F.sum("positive")).alias("neg")
    )
    curve = running_totals(
        collapsed, ["class"], [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}
    )
    sizes = collapsed.groupBy("class").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return curve.join(F.broadcast(sizes), "class")  # one row per class


def roc_points(curve: DataFrame) -> DataFrame:
    return curve.select(
        "class", F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid rule; a step adds its negatives times the mean height before and after it."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    pairs = F.max("n_pos").cast("double") * F.max("n_neg").cast("double")
    return curve.groupBy("class").agg(F.when(pairs > 0, area / pairs).alias("auc"))


def pr_points(curve: DataFrame) -> DataFrame:
    return curve.select(
        "class", F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
    )


def average_precision(curve: DataFrame) -> DataFrame:
    step = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return curve.groupBy("class").agg(
        F.when(F.max("n_pos") > 0, step / F.max("n_pos")).alias("average_precision")
    )


def best_round(losses: DataFrame) -> DataFrame:
    """Per run: the round with the lowest validation loss, earliest on ties, and how far training went."""
    key = F.when(F.col("split") == "val", F.struct("loss", "round"))
    return losses.groupBy("run").agg(
        F.min(key).alias("_b"), F.max("round").alias("last_round"), F.count_if(F.col("split") == "train").alias("n_train")
    ).select("run", F.col("_b.round").alias("best_round"), F.col("_b.loss").alias("best_loss"), "last_round", "n_train")


def early_stopping_rounds(rounds: int) -> int | None:
    return min(50, rounds // 10) if rounds > 10 else None


def metrics_long(df: DataFrame, stage: str, names: Sequence[str] | None = None) -> DataFrame:
    """A one-row report as (stage, metric, value) rows for the metric log."""
    names = list(names or df.columns)
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(stage).alias("stage"), F.inline(rows))
