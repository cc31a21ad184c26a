"""Model fitting on Spark ML: boosted trees, logistic regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import CLASS_LABELS, SEED
from plumbline.operators.decisions import PROBABILITIES, renormalize
from plumbline.operators.evaluation import early_stopping_rounds
from plumbline.session import cut, shuffle_width, side_by_side, without_summary


# Stopping tolerance of the regressions (fixed value).
TOLERANCE = 1e-4
# Most rounds of a whole training (fixed value), and rounds that are tried before all of them.
ROUNDS = 500
FIRST_ROUNDS = 100
# Training rows of a partition below which more partitions only add scheduling, and partitions that are always allowed.
PARTITION_ROWS = 2048
LEAST_WIDTH = 8
# Rows of a partition of a regression on many rows: every partition sends its state to the driver in every iteration.
REGRESSION_ROWS = 16384


def fit_partitions(spark: SparkSession, n: int) -> int:
    """Partitions for n training rows: by their number, up to the width of the session's shuffles."""
    return max(1, min(-(-n // PARTITION_ROWS), max(LEAST_WIDTH, shuffle_width(spark))))


def regression_partitions(spark: SparkSession, n: int) -> int:
    """Partitions for n rows of a regression: up to ``LEAST_WIDTH`` small ones, then larger ones."""
    return max(min(fit_partitions(spark, n), LEAST_WIDTH), min(-(-n // REGRESSION_ROWS), shuffle_width(spark)))


def spread_by_id(df: DataFrame, partitions: int) -> DataFrame:
    """Training rows by the hash of their id, in its order.

    Trees draw rows by partition and place, so a fitted model must not depend on how the data was read.  Keep
    ``partitions`` to get the same model again.
    """
    return df.repartition(partitions, "id").sortWithinPartitions("id")


@dataclass
class BoostingSettings:
    """Defaults are fixed values; ``rounds`` is the usual knob.  Without ``partitions`` the number of rows decides."""

    rounds: int = 10
    depth: int = 5
    min_rows: int = 7
    bins: int = 64
    row_share: float = 0.7
    column_share: float = 0.4
    step: float = 0.05
    seed: int = SEED
    partitions: int | None = None


@dataclass
class BoostedModel:
    """One-vs-rest boosted trees; probabilities are the normalised one-vs-rest probabilities."""

    models: list[GBTClassificationModel]
    settings: BoostingSettings = field(default_factory=BoostingSettings)

    def transform(self, df: DataFrame) -> DataFrame:
        """(id, p0, p1, p2) plus the columns of ``df``; expects ``features`` as a vector."""
        out = df
        for k, model in enumerate(self.models):
            scored = model.setProbabilityCol("_prob").setRawPredictionCol("_raw").setPredictionCol("_pred").transform(out)
            out = scored.withColumn(PROBABILITIES[k], vector_to_array("_prob")[1]).drop("_prob", "_raw", "_pred")
        return renormalize(out)

    def importances(self, spark, names: Sequence[str], symbolic: Sequence[str]) -> DataFrame:
        """Mean gain share per feature; features without a split have 0.  Repeated symbolic columns, which
        follow the named ones, count for their original."""
        width, block = len(names), max(1, len(symbolic))
        totals = [0.0] * width
        for model in self.models:
            for i, value in enumerate(model.featureImportances.toArray()):
                totals[i if i < width else (i - width) % block] += float(value) / len(self.models)
        kind = ["symbolic" if n in symbolic else "embedding" for n in names]
        return spark.createDataFrame(list(zip(names, kind, totals)), "feature string, kind string, importance double")

    def save(self, path: str) -> None:
        for k, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/{CLASS_LABELS[k].lower()}")

    @staticmethod
    def load(path: str) -> BoostedModel:
        return BoostedModel([GBTClassificationModel.load(f"{path}/{c.lower()}") for c in CLASS_LABELS])


def as_vector(df: DataFrame, column: str = "features") -> DataFrame:
    return df.withColumn(column, array_to_vector(F.col(column)))


def fit_boosting(df: DataFrame, settings: BoostingSettings | None = None) -> BoostedModel:
    """Expects features (vector), y, weight and is_val.  Validation rows only decide where to stop.

    The loss on the validation rows is measured after every round; if it has not improved for ``early_stopping_rounds``
    rounds, the trees up to the best round are kept.  Ten rounds or fewer are never cut short.  Trees are grown one after
    the other from the same seed, so fewer rounds give the same first trees: ``FIRST_ROUNDS`` are tried before all rounds.
    """
    s = settings or BoostingSettings()
    df = spread_by_id(df, s.partitions or fit_partitions(df.sparkSession, df.count())).persist()
    patience = early_stopping_rounds(s.rounds)
    watched = patience is not None and bool(df.filter("is_val").head(1))

    def fit_class(k: int) -> GBTClassificationModel:
        labelled = df.withColumn("_label", (F.col("y") == k).cast("double"))
        train = labelled.filter(~F.col("is_val"))

        def of_rounds(rounds: int) -> GBTClassificationModel:
            return GBTClassifier(
                featuresCol="features", labelCol="_label", weightCol="weight", maxIter=rounds, maxDepth=s.depth,
                minInstancesPerNode=s.min_rows, maxBins=s.bins, subsamplingRate=s.row_share,
                featureSubsetStrategy=str(s.column_share), stepSize=s.step, seed=s.seed,
            ).fit(train)

        if not watched:
            return of_rounds(s.rounds)
        for rounds in sorted({min(FIRST_ROUNDS, s.rounds), s.rounds}):
            model = of_rounds(rounds)
            kept = rounds_to_keep(model.evaluateEachIteration(labelled.filter("is_val")), patience)
            if kept < rounds:
                return of_rounds(kept)
        return model

    models = side_by_side(fit_class, range(3))
    df.unpersist()
    return BoostedModel(models, s)


def rounds_to_keep(losses: Sequence[float], patience: int) -> int:
    """The best round once ``patience`` rounds brought nothing better; all rounds if that never happens."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1
    return len(losses)


def learning_curve(model: BoostedModel, df: DataFrame) -> DataFrame:
    """(run, round, split, loss): loss of each one-vs-rest model after every round (rounds x classes rows)."""
    rows = []
    for k, fitted in enumerate(model.models):
        labelled = df.select("features", "weight", "is_val", (F.col("y") == k).cast("double").alias("_label"))
        for split, part in (("train", labelled.filter(~F.col("is_val"))), ("val", labelled.filter("is_val"))):
            rows += [(CLASS_LABELS[k], i, split, float(x)) for i, x in enumerate(fitted.evaluateEachIteration(part))]
    return df.sparkSession.createDataFrame(rows, "run string, round int, split string, loss double")


def fit_logistic(df: DataFrame, max_iter: int = 100, label: str = "y", partitions: int | None = None) -> LogisticRegressionModel:
    """Multinomial regression; the penalty matches an L2 weight of one against the summed loss.

    No row is sampled, so the number of partitions only moves the last digits; without it the number of rows decides.
    ``df`` is counted before it is dealt, so store it first if it is costly.
    """
    n = df.count()
    rows = df.withColumn(label, F.col(label).cast("double"))
    rows = spread_by_id(rows, partitions or regression_partitions(df.sparkSession, n)).persist()
    model = LogisticRegression(
        featuresCol="features", labelCol=label, family="multinomial", maxIter=max_iter,
        regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, tol=TOLERANCE,
    ).fit(rows)
    rows.unpersist()
    return without_summary(model)


def class_probabilities(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """p0, p1, p2; a class the training data never showed has probability 0."""
    p = vector_to_array("probability")
    known = model.numClasses
    scored = model.transform(df)
    return scored.select(
        *df.columns, *[(p[k] if k < known else F.lit(0.0)).alias(PROBABILITIES[k]) for k in range(3)]
    )


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool adjacent violators over rows in the order of class and score; counts are whole numbers, so ties are exact."""
    last, pools = None, []

    def passed_on() -> pd.DataFrame:
        return pd.DataFrame([(last, *p) for p in pools], columns=["class", "low", "high", "hits", "n"])

    for pdf in batches:
        for k, *pool in pdf[["class", "low", "high", "hits", "n"]].itertuples(index=False, name=None):
            if k != last and pools:
                yield passed_on()
                pools = []
            last = k
            while pools and pools[-1][2] * pool[3] >= pool[2] * pools[-1][3]:
                low, _, hits, n = pools.pop()
                pool = [low, pool[1], hits + pool[2], n + pool[3]]
            pools.append(pool)
    if pools:
        yield passed_on()


def isotonic_pools(df: DataFrame, slices: int | None = None, fan_in: int = 16) -> DataFrame:
    """(class, low, high, hits, n): the level stretches of each class's non-decreasing fit of hits to scores.

    The scores are cut into ranges that are pooled on their own; then the pools of ``fan_in`` neighbouring ranges are
    pooled in one task, and so on until one range is left.  Pooling pools gives the same fit as pooling points.  Levels
    rise from pool to pool and are shares of whole numbers, so a range of n rows keeps at most about n^(2/3) pools and
    usually far fewer, whatever its number of points.
    """
    each = F.array(*[
        F.struct(F.lit(k).alias("class"), F.col(p).cast("double").alias("low"), (F.col("y") == k).cast("long").alias("hit"))
        for k, p in enumerate(PROBABILITIES)
    ])
    long = df.filter(F.col("y").isNotNull()).select(F.inline(each)).filter(F.col("low").isNotNull())
    pools = cut(long.groupBy("class", "low").agg(F.sum("hit").alias("hits"), F.count("*").alias("n")).withColumn("high", F.col("low")))
    slices = slices or shuffle_width(df.sparkSession)
    while True:
        ranged = pools.repartitionByRange(slices, "class", "low") if slices > 1 else pools.repartition(len(PROBABILITIES), "class")
        merged = ranged.sortWithinPartitions("class", "low").mapInPandas(_merged, "class int, low double, high double, hits bigint, n bigint")
        if slices == 1:
            return merged
        pools, slices = cut(merged), max(1, slices // fan_in)


def fit_calibration(df: DataFrame) -> list[IsotonicRegressionModel]:
    """One isotonic regression per class.  The model is made from the ends of its pools; no point reaches the driver."""
    pools = cut(isotonic_pools(df))
    ends = pools.select(
        "class", F.explode(F.array_distinct(F.array("low", "high"))).alias("score"), (F.col("hits") / F.col("n")).alias("share"),
        F.col("n").cast("double").alias("weight"),
    )
    fit = IsotonicRegression(featuresCol="score", labelCol="share", weightCol="weight", predictionCol="_cal").fit
    return side_by_side(lambda k: fit(ends.filter(F.col("class") == k)), range(len(PROBABILITIES)))


def calibrate(df: DataFrame, models: Sequence[IsotonicRegressionModel]) -> DataFrame:
    """Calibrated probabilities, scaled to sum 1 (a row of zeros keeps its raw values)."""
    out = df
    for p, model in zip(PROBABILITIES, models):
        out = model.setFeaturesCol(p).setPredictionCol(f"_{p}").transform(out)
    zero = sum((F.col(f"_{p}") for p in PROBABILITIES), F.lit(0.0)) == 0
    kept = out.select(
        *[c for c in df.columns if c not in PROBABILITIES],
        *[F.when(zero, F.col(p)).otherwise(F.col(f"_{p}")).alias(p) for p in PROBABILITIES],
    )
    return renormalize(kept)


def calibration_table(pools: DataFrame) -> DataFrame:
    """(class, boundary, value) of the fitted step functions: both ends of every level stretch."""
    ends = F.explode(F.array_distinct(F.array("low", "high")))
    return pools.select("class", ends.alias("boundary"), (F.col("hits") / F.col("n")).alias("value"))
