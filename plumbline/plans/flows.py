"""End-to-end flows: labeling, noise pruning, training, scoring, ablation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plumbline.config import ABLATION_SEEDS, CLASS_LABELS, COST_MATRIX, CLASS_THRESHOLD, FEATURE_NAMES, HIGH_CONFIDENCE, SEED, TRAIN_CONFIDENCE
from plumbline.operators import (
    cleaning, decisions, evaluation, explain, label_model, labeling, matrix, noise, similarity, splits, tfidf, training,
)
from plumbline.operators.features import symbolic_features
from plumbline.plans.bundle import Bundle
from plumbline.session import cut, forget, side_by_side
from plumbline.sources import files
from plumbline.sources.tables import union_all

# Training rows of the regressions that are fitted side by side.
ROWS_AT_ONCE = 2_000_000


def weak_labels(raw: DataFrame, epochs: int = 500, watched: dict[str, Observation] | None = None) -> DataFrame:
    """Clean, vote, fit the label model, label.  ``watched`` gets the rows of raw, cleaned and labeled, counted while the
    votes are stored.

    The votes are stored with their stories: searching the texts again for the second pass would cost more
    than reading them back.  The full text is not stored, it is put together again from title and description.
    """
    cleaned = cleaning.preprocess(raw)
    seen = counted(cleaning.preprocess(counted(raw, "raw", watched)), "cleaned", watched)
    votes = cut(counted(labeling.apply_functions(seen, keep=cleaned.columns).drop("full_text"), "labeled", watched))
    votes = votes.withColumn("full_text", cleaning.full_text())
    mu = fit_label_model(labeling.vote_patterns(votes), epochs)
    return label_model.label_rows(cleaned, votes, label_model.fitted_log_odds(mu))


def counted(df: DataFrame, stage: str, watched: dict[str, Observation] | None) -> DataFrame:
    """``df``, whose rows are counted by the job that reads it first."""
    if watched is None:
        return df
    watched[stage] = Observation()
    return df.observe(watched[stage], F.count(F.lit(1)).alias("n"))


def fit_label_model(patterns: DataFrame, epochs: int = 500):
    """Conditional vote probabilities from vote patterns, which are stored once."""
    patterns = cut(patterns)
    n_rows = patterns.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return label_model.fit(label_model.moments(patterns), epochs=epochs, n_rows=n_rows)


def labeled_by_assumption(raw: DataFrame) -> DataFrame:
    """Clean, vote and label with the assumed accuracies: one projection, nothing fitted."""
    cleaned = cleaning.preprocess(raw)
    return label_model.label_rows(cleaned, labeling.apply_functions(cleaned, keep=cleaned.columns))


def cross_validated(labeled: DataFrame, k: int = 5) -> DataFrame:
    """(id, given, pb0, pb1) held-out probabilities of a TF-IDF logistic regression."""
    texts = tfidf.with_terms(labeled.select("id", "full_text", "risk_label_binary"))
    model = tfidf.fit(texts, size=1000, max_df=0.8, min_df=2)
    vectors = model.transform(texts).select("id", "risk_label_binary", "features")
    folds = splits.contiguous_folds(labeled, "risk_label_binary", k)
    return noise.out_of_fold(vectors, folds, "risk_label_binary", k)


@dataclass
class Augmented:
    """Frames after each stage of the augmentation, and the rows that its jobs counted on the way."""

    raw: DataFrame
    cleaned: DataFrame
    labeled: DataFrame
    flagged: DataFrame
    pruned: DataFrame
    high_confidence: DataFrame
    classes: DataFrame
    watched: dict[str, Observation]


def augment(raw: DataFrame, epochs: int = 500, threshold: float = CLASS_THRESHOLD) -> Augmented:
    """Load, clean, label, prune, high-confidence subset, three classes."""
    watched: dict[str, Observation] = {}
    labeled = weak_labels(raw, epochs, watched)
    flagged = cut(noise.flag_issues(cut(cross_validated(labeled))))
    pruned = noise.prune(labeled, flagged)
    return Augmented(
        raw, cleaning.preprocess(raw), labeled, flagged, pruned, cleaning.confident(pruned, HIGH_CONFIDENCE),
        cleaning.map_to_classes(pruned, threshold), watched,
    )


def save_augmented(stages: Augmented, path: str, run_id: str) -> None:
    """Write the pruned set (its high-confidence part is a partition of it), the three classes, and rows per stage.

    The rows were counted by the jobs that stored them, so no stage is read for its count.
    """
    sure = Observation()
    watched = stages.watched | {"high_confidence": sure}
    pruned = counted(stages.pruned, "pruned", watched).observe(sure, F.count_if(F.col("risk_confidence") > HIGH_CONFIDENCE).alias("n"))
    files.write_high_confidence(pruned, f"{path}/labeled", HIGH_CONFIDENCE)
    stages.classes.write.mode("overwrite").parquet(f"{path}/classes")
    names = ("raw", "cleaned", "labeled", "pruned", "high_confidence")
    rows = [(i, name, watched[name].get["n"]) for i, name in enumerate(names)]
    losses = _losses(stages.pruned.sparkSession.createDataFrame(rows, "stage_no int, stage string, n bigint"))
    long = losses.select("stage", F.col("stage_no").alias("step"), "n", "lost", "kept_pct").unpivot(
        ["stage", "step"], [F.col(c).cast("double").alias(c) for c in ("n", "lost", "kept_pct")], "metric", "value"
    )
    files.append_metrics(long, f"{path}/metrics", run_id)


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(stage_no, stage, n, lost, kept_pct): rows per stage and the loss since the stage before.

    The window spans the stage rows only, a list as long as ``stages``.
    """
    counts = union_all(
        [
            df.agg(F.count("*").alias("n")).select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "n")
            for i, (name, df) in enumerate(stages)
        ]
    )
    return _losses(counts)


def funnel_of(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """The same report for stages that are conditions on the rows of one frame: one pass over it."""
    counts = df.agg(*[F.count_if(condition).alias(f"_{i}") for i, (_, condition) in enumerate(stages)])
    rows = [
        F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"_{i}").alias("n"))
        for i, (name, _) in enumerate(stages)
    ]
    return _losses(counts.select(F.inline(F.array(*rows))))


def _losses(counts: DataFrame) -> DataFrame:
    before = F.lag("n").over(Window.orderBy("stage_no"))
    return counts.select(
        "stage_no", "stage", "n", F.coalesce(before - F.col("n"), F.lit(0)).alias("lost"),
        F.coalesce(F.when(before > 0, 100.0 * F.col("n") / before), F.lit(100.0)).alias("kept_pct"),
    )


def feature_rows(labeled: DataFrame, keep: Sequence[str] = ("idproject",)) -> DataFrame:
    """(id, y, fifteen features, embedding) plus ``keep``: every text is read once, only numbers remain."""
    encoded = cleaning.encode_labels(labeled).select("id", *keep, "full_text", F.col("risk_class").alias("y"))
    return matrix.embed_texts(symbolic_features(encoded), "full_text").drop("full_text")


def feature_vectors(rows: DataFrame, scaling: dict[str, tuple[float, float]], keep: Sequence[str], symbolic_weight: int = 1) -> DataFrame:
    """``keep`` and ``features``: scaled symbolic values, then the embedding.

    A ``symbolic_weight`` of 2 repeats the symbolic columns, so that column sampling draws them twice as often.
    """
    symbolic = F.array(*FEATURE_NAMES)
    features = F.concat(symbolic, F.col("embedding"), *[symbolic] * (symbolic_weight - 1))
    return training.as_vector(matrix.scale_by(rows, scaling).select(*keep, features.alias("features")))


@dataclass
class Trained:
    """A fitted bundle with the rows it was fitted on and the scored test rows."""

    bundle: Bundle
    frame: DataFrame
    test: DataFrame

    @property
    def model(self) -> training.BoostedModel:
        return self.bundle.model

    @property
    def names(self) -> list[str]:
        return self.bundle.names


def train(
    classes: DataFrame, settings: training.BoostingSettings | None = None, stratum: str = "idproject", symbolic_weight: int = 1
) -> Trained:
    """Filter, split, features, boosting with validation, calibration on the validation rows, test scores."""
    # Stored once, as numbers only: splitting, scaling, fitting and scoring all read it.
    rows = cut(feature_rows(cleaning.confident(classes, TRAIN_CONFIDENCE), (stratum,)))
    joined = cut(rows.join(splits.stratified_split(rows, stratum).select("id", "split"), "id"))
    scaling = matrix.scaling_values(joined.filter(F.col("split") == "train"), FEATURE_NAMES)
    frame = cut(feature_vectors(joined, scaling, ("id", "y", "split"), symbolic_weight))
    weights = explaining_weights(joined.filter(F.col("split") != "test"), scaling)
    weighted = splits.sample_weights(frame.filter(F.col("split") != "test"), "y").withColumn("is_val", F.col("split") == "val")
    model = training.fit_boosting(weighted, settings)
    calibration = training.fit_calibration(cut(model.transform(frame.filter(F.col("split") == "val")).select("y", "p0", "p1", "p2")))
    test = model.transform(frame.filter(F.col("split") == "test"))
    bundle = Bundle(
        model, calibration, matrix.fused_names(FEATURE_NAMES), scaling, weights, [list(map(float, r)) for r in COST_MATRIX],
        symbolic_weight,
    )
    return Trained(bundle, weighted, test)


def explaining_weights(rows: DataFrame, scaling: dict[str, tuple[float, float]]) -> list[list[float]]:
    """Weights per class of a linear model on the symbolic features, in units of the raw values."""
    numbers = matrix.scale_by(rows, scaling).select("id", "y", F.array(*FEATURE_NAMES).alias("features"))
    coefficients = training.fit_logistic(training.as_vector(numbers)).coefficientMatrix.toArray()
    deviations = [scaling[f][1] for f in FEATURE_NAMES]
    found = [[float(w / s) for w, s in zip(row, deviations)] for row in coefficients]
    return found + [[0.0] * len(FEATURE_NAMES)] * (len(CLASS_LABELS) - len(found))


def score(frame: DataFrame, bundle: Bundle, keep: Sequence[str] = ("id", "y")) -> DataFrame:
    """``keep``, p0..p2, y_pred, risk_level, confidence by calibrated cost-sensitive decision."""
    raw = cut(bundle.model.transform(frame).select(*keep, "p0", "p1", "p2"))
    return decisions.risk_decision(training.calibrate(raw, bundle.calibration), bundle.costs).drop("expected_costs")


def assess(
    stories: DataFrame, bundle: Bundle, corpus: DataFrame | None = None, similar: int = 3, with_features: bool = False
) -> DataFrame:
    """One record per story: level, confidence, p0..p2, explanation, similar ids; the fifteen features on request.

    Stories without title, description or points get the fallback record (Medium, 50) with neither explanation nor
    neighbours.  ``corpus`` (id, embedding) holds the stories to search; without it there are no similar ids.  Texts
    are read once; only numbers are stored and joined.
    """
    cleaned = cleaning.preprocess(stories).select("id", "full_text")
    rows = cut(matrix.embed_texts(symbolic_features(cleaned), "full_text").drop("full_text"))
    scored = score(feature_vectors(rows, bundle.scaling, ("id",), bundle.symbolic_weight), bundle, ("id",))
    means = {f: m for f, (m, _) in bundle.scaling.items()}
    reasons = explain.with_attributions(rows, FEATURE_NAMES, bundle.weights, means=means)
    told = explain.explanations(reasons.drop("predicted").join(scored, "id"), decided="y_pred").select("id", "explanation")
    out = decisions.assessments(scored, stories).join(scored.select("id", "p0", "p1", "p2"), "id", "left").join(told, "id", "left")
    if with_features:
        out = out.join(rows.select("id", F.struct(*FEATURE_NAMES).alias("features")), "id", "left")
    if corpus is None:
        return out.withColumn("similar_ids", F.lit(None).cast("array<bigint>"))
    near = similarity.search(rows.select("id", "embedding"), corpus, similar, others_only=True)
    found = similarity.similar_ids(near, count=similar).select(F.col("query_id").alias("id"), F.col("ids").alias("similar_ids"))
    return out.join(found, "id", "left")


def embedded_corpus(stories: DataFrame) -> DataFrame:
    """(id, embedding) of complete stories: the table to store once and search with ``assess``."""
    return matrix.embed_texts(cleaning.preprocess(stories).select("id", "full_text"), "full_text").select("id", "embedding")


def training_report(trained: Trained) -> DataFrame:
    """Accuracy and class metrics on the test rows as metric rows."""
    scored = cut(decisions.with_argmax(trained.test.select("id", "y", "p0", "p1", "p2")))
    report = evaluation.class_report(scored)
    flat = report.select(
        F.lit("evaluation").alias("stage"),
        F.inline(
            F.array(
                *[
                    F.struct(F.concat(F.lit(f"{m}_"), F.col("class").cast("string")).alias("metric"), F.col(m).alias("value"))
                    for m in ("precision", "recall", "f1")
                ]
            )
        ),
    )
    return union_all(
        [
            flat,
            evaluation.metrics_long(evaluation.accuracy(scored), "evaluation", ["accuracy", "n"]),
            evaluation.metrics_long(evaluation.f1_summary(report), "evaluation", ["macro_f1"]),
        ]
    )


def ablation(
    raw: DataFrame, seeds: Sequence[int] = tuple(ABLATION_SEEDS), epochs: int = 500, max_iter: int = 1000
) -> DataFrame:
    """(config, seed, macro_f1) for unpruned three-class labels, two-class labels and pruned labels."""
    stages = augment(raw, epochs)
    arms = {
        "unpruned": cleaning.map_to_classes(stages.labeled),
        "two_class": cleaning.map_without_medium(stages.labeled),
        "pruned": stages.classes,
    }
    return compare_arms(stages.labeled, arms, seeds, max_iter)


def compare_arms(texts: DataFrame, arms: dict[str, DataFrame], seeds: Sequence[int], max_iter: int = 1000) -> DataFrame:
    """(config, seed, macro_f1): TF-IDF of words and pairs with logistic regression, per arm (id, risk_label) and seed.

    A run is an arm with a seed; the runs of a row are the bits of two numbers, at most 62 runs.  All runs are split
    in one pass, the words of each text are stored once, and the vocabularies of all runs come from one aggregate over
    them; then the texts are counted once by the terms of all runs.  Only the regressions are fitted run by run, side by
    side as long as their rows together are at most ``ROWS_AT_ONCE``: each holds a copy of its rows.
    """
    runs = [(config, seed) for config in arms for seed in seeds]
    if len(runs) > 62:
        raise ValueError("at most 62 runs are compared together")
    labelled = union_all([
        cleaning.encode_labels(df.select("id", "risk_label")).select(F.lit(config).alias("config"), "id", F.col("risk_class").alias("y"))
        for config, df in arms.items()
    ])
    seeded = cut(labelled).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    split = splits.label_splits(seeded, ["config", "seed"], "y", "seed")

    def bits(part: str):
        held = [F.when((F.col("config") == c) & (F.col("seed") == s) & (F.col("split") == part), F.lit(1 << r).cast("long"))
                for r, (c, s) in enumerate(runs)]
        return F.coalesce(F.sum(F.coalesce(*held)), F.lit(0).cast("long")).alias(part)

    member = split.groupBy("id").agg(bits("train"), bits("test"), *[F.max(F.when(F.col("config") == c, F.col("y"))).alias(f"y_{c}") for c in arms])
    rows = tfidf.with_pairs(cut(tfidf.with_terms(texts.select("id", "full_text").join(member, "id")).drop("full_text")))

    sizes = rows.agg(*[F.count_if(F.col("train").bitwiseAND(F.lit(1 << r).cast("long")) != 0) for r in range(len(runs))]).first()
    models = tfidf.fit_runs(tfidf.frequent_counts(rows, len(runs)), list(sizes))
    # Every run reads numbers: the terms are vectorised once, by the terms of all runs together.
    counted, vocabulary = tfidf.count_together(rows, models)
    counted = cut(counted)

    def of(part: str, r: int) -> DataFrame:
        member = counted.filter(F.col(part).bitwiseAND(F.lit(1 << r).cast("long")) != 0)
        return models[r].transform_counts(member.select("id", "counts", F.col(f"y_{runs[r][0]}").alias("y")), vocabulary)

    def scored(r: int) -> DataFrame:
        config, seed = runs[r]
        model = training.fit_logistic(of("train", r).select("id", "y", "features"), max_iter)
        forget(texts.sparkSession)
        found = training.class_probabilities(model, of("test", r).select("id", "y", "features"))
        return found.select(F.lit(config).alias("config"), F.lit(seed).alias("seed"), "y", "p0", "p1", "p2")

    at_once = max(1, ROWS_AT_ONCE // max(1, *sizes))
    decided = decisions.with_argmax(union_all(side_by_side(scored, range(len(runs)), at_once)))
    report = evaluation.class_report(decided, ["config", "seed"])
    return evaluation.f1_summary(report, ["config", "seed"]).select("config", "seed", "macro_f1")


def ablation_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("config").agg(
        F.count("*").alias("n_runs"), F.avg("macro_f1").alias("mean_f1"), F.stddev_pop("macro_f1").alias("std_f1")
    )


def decision_runs(preds: DataFrame, seeds: Sequence[int] = tuple(ABLATION_SEEDS)) -> DataFrame:
    """(config, seed, macro_f1) of three decision rules on the held-out rows of each seed.

    All seeds are split in one pass: the seed is part of the stratum and of the hash.
    """
    per_seed = preds.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    test = splits.label_splits(per_seed, ["seed"], "y", "seed").filter(F.col("split") == "test").drop("split")
    by_cost = decisions.with_cost_decision(test).withColumnRenamed("y_pred", "_cost")
    both = decisions.with_argmax(by_cost)
    rules = F.array(
        F.struct(F.lit("argmax").alias("config"), F.col("y_pred").alias("_p")),
        F.struct(F.lit("cost").alias("config"), F.col("_cost").alias("_p")),
        F.struct(F.lit("always_low").alias("config"), F.lit(0).alias("_p")),
    )
    long = both.select("seed", "y", F.inline(rules)).withColumnRenamed("_p", "y_pred")
    report = evaluation.class_report(long, ["config", "seed"])
    return evaluation.f1_summary(report, ["config", "seed"]).select("config", "seed", "macro_f1")


__all__ = [
    "SEED", "Augmented", "Bundle", "Trained", "ablation", "ablation_summary", "assess", "augment", "compare_arms", "cross_validated",
    "decision_runs", "embedded_corpus", "feature_rows", "feature_vectors", "funnel", "labeled_by_assumption", "score", "train", "training_report", "weak_labels",
]
