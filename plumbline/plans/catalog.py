"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads whole given tables.  ``finish`` only fixes types for comparison: integers become long,
doubles are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.config import FEATURE_NAMES, SEED
from plumbline.functions.arrays import l2_normalize
from plumbline.operators import (
    cleaning, clusters, decisions, evaluation, explain, features, health, label_model, labeling, matrix, noise, scope,
    similarity, splits, tfidf, training, validation,
)
from plumbline.plans import flows
from plumbline.sources import files, tables, vectors
from plumbline.streaming import requests, scoring

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def finish(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
    return fn


def joined(df: DataFrame, column: str = "recommendations") -> DataFrame:
    """Arrays as one text, for value comparison."""
    return df.withColumn(column, F.array_join(column, " | "))


# --- shared frames ------------------------------------------------------------------------------------


def _cleaned(spark, sf_dir):
    return cleaning.preprocess(tables.stories(spark, sf_dir))


def _votes(spark, sf_dir):
    return labeling.apply_functions(_cleaned(spark, sf_dir))


def _patterns(spark, sf_dir):
    return labeling.vote_patterns(_votes(spark, sf_dir))


def _labeled(spark, sf_dir):
    return flows.labeled_by_assumption(tables.stories(spark, sf_dir))


def _classes(spark, sf_dir):
    return cleaning.map_to_classes(_labeled(spark, sf_dir))


def _scored(spark, sf_dir):
    return decisions.with_argmax(tables.predictions(spark, sf_dir))


def _curve(spark, sf_dir):
    return evaluation.threshold_curve(tables.predictions(spark, sf_dir))


def _flagged(spark, sf_dir):
    return noise.flag_issues(tables.predictions(spark, sf_dir).select("id", "given", "pb0", "pb1"))


def _symbolic(spark, sf_dir):
    return features.story_features(_cleaned(spark, sf_dir), ("id", "idproject"))


def _scaled(spark, sf_dir):
    symbolic = _symbolic(spark, sf_dir)
    split = splits.stratified_split(_cleaned(spark, sf_dir), "idproject")
    # Stored as numbers: the training statistics and the scaled rows share one reading of the texts.
    rows = session.cut(symbolic.join(split.select("id", "split"), "id").drop("idproject"))
    return matrix.scale(rows, rows.filter(F.col("split") == "train"), FEATURE_NAMES)


def _factors(spark, sf_dir):
    symbolic = session.cut(_symbolic(spark, sf_dir).select("id", *tables.FACTOR_FEATURES))
    return explain.with_attributions(symbolic, tables.FACTOR_FEATURES, tables.FACTOR_WEIGHTS)


def _health_rows(spark, sf_dir):
    return tables.stories(spark, sf_dir).withColumnRenamed("storypoints", "estimated_points")


def _trained(spark, sf_dir, settings=None):
    return flows.train(_classes(spark, sf_dir), settings)


def _trained_whole(spark, sf_dir):
    """Boosted until the validation rows stop it."""
    return _trained(spark, sf_dir, training.BoostingSettings(rounds=training.ROUNDS))


# --- sources ------------------------------------------------------------------------------------------


@register
def scan_stories(spark, sf_dir):
    return tables.stories(spark, sf_dir).withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@register
def csv_roundtrip(spark, sf_dir):
    rows = tables.stories(spark, sf_dir).select("id", "idproject", "title", "description", "storypoints")
    path = session.scratch_path(spark, "stories-csv")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@register
def high_confidence(spark, sf_dir):
    path = session.scratch_path(spark, "labeled")
    rows = _labeled(spark, sf_dir).select("id", "risk_label", "risk_confidence")
    files.write_high_confidence(rows, path, 0.75)
    return files.read_labeled(spark, path, high_conf_only=True)


@register
def stage_metrics(spark, sf_dir):
    path = session.scratch_path(spark, "metrics")
    files.append_metrics(tables.metric_rows(spark, sf_dir), path, "run-1")
    return spark.read.parquet(path).select("run_id", "key", "step", "value")


@register
def story_json(spark, sf_dir):
    records = cleaning.to_story(_labeled(spark, sf_dir))
    return cleaning.story_from_json(cleaning.story_to_json(records))


# --- validation and profiling -------------------------------------------------------------------------


@register
def validate_labels(spark, sf_dir):
    return validation.validate_labels(_labeled(spark, sf_dir))


@register
def label_vocab(spark, sf_dir):
    # Labels are stored once, without texts; both vocabularies read them.
    labels = session.cut(_labeled(spark, sf_dir).select("id", "risk_label", "risk_confidence"))
    frames = {"weak": labels, "mapped": cleaning.map_to_classes(labels)}
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("risk_label"))
    frames["orders"] = orders
    return tables.union_all([validation.label_vocabulary(df).withColumn("source", F.lit(n)) for n, df in frames.items()])


@register
def missing_classes(spark, sf_dir):
    return validation.missing_classes(cleaning.map_without_medium(_labeled(spark, sf_dir)))


@register
def verify_report(spark, sf_dir):
    base = ["full_text", "story_points", "risk_label", "risk_confidence"]
    labeled = _labeled(spark, sf_dir)
    # Stored once, without texts; all four stages read it.  What a stage has beside the two columns is known from its plan.
    labels = session.cut(labeled.select("risk_label", "risk_confidence"))

    def stages_of(rows):
        return {"weak_labels": rows, "pruned": cleaning.confident(rows), "mapped": cleaning.map_to_classes(rows), "unmapped": rows}

    wanted = {
        "weak_labels": (base + ["word_count", "title", "description", *label_model.LABEL_COLUMNS], ["SAFE", "RISK"]),
        "pruned": (base, ["SAFE", "RISK"]),
        "mapped": (base, ["Low", "Medium", "High"]),
        "unmapped": (base + ["risk_class"], ["Low", "Medium", "High"]),
    }
    return validation.verify_stages(
        {stage: (rows, *wanted[stage]) for stage, rows in stages_of(labels).items()},
        {stage: rows.columns for stage, rows in stages_of(labeled).items()},
    )


@register
def null_profile(spark, sf_dir):
    return validation.null_profile(tables.stories(spark, sf_dir))


@register
def dataset_profile(spark, sf_dir):
    return validation.dataset_profile(tables.stories(spark, sf_dir))


@register
def value_counts(spark, sf_dir):
    return validation.value_counts(_labeled(spark, sf_dir), "risk_label")


@register
def points_hist(spark, sf_dir):
    return validation.value_counts(tables.stories(spark, sf_dir), "storypoints").orderBy("value")


@register
def text_stats(spark, sf_dir):
    return validation.text_stats(_cleaned(spark, sf_dir))


@register
def imbalance(spark, sf_dir):
    return validation.imbalance(tables.predictions(spark, sf_dir), "y")


@register
def request_validation(spark, sf_dir):
    checked = validation.validate_requests(tables.story_requests(spark, sf_dir))
    return joined(checked.select("id", "accepted", "reasons"), "reasons")


# --- cleaning and mapping -----------------------------------------------------------------------------

CLEAN_COLUMNS = [
    "id", "idproject", "title", "description", "story_points", "full_text", "word_count", "title_word_count",
    "char_count", "has_list", "list_item_count", "has_code_block",
]


@register
def preprocess(spark, sf_dir):
    return _cleaned(spark, sf_dir).select(*CLEAN_COLUMNS)


@register
def dropna_funnel(spark, sf_dir):
    return cleaning.dropna_funnel(tables.stories(spark, sf_dir))


@register
def confidence_filter(spark, sf_dir):
    return cleaning.confident(_labeled(spark, sf_dir), 0.5).select("id", "risk_label", "risk_confidence")


@register
def map_3class(spark, sf_dir):
    return _classes(spark, sf_dir).select("id", "risk_label", "risk_confidence")


@register
def map_simple(spark, sf_dir):
    return cleaning.map_without_medium(_labeled(spark, sf_dir)).select("id", "risk_label")


@register
def label_encode(spark, sf_dir):
    return cleaning.encode_labels(_classes(spark, sf_dir)).select("id", "risk_label", "risk_class")


@register
def sample_n(spark, sf_dir):
    return cleaning.sample_rows(_labeled(spark, sf_dir).select("id", "risk_label"), 500, SEED)


@register
def stories_by_risk(spark, sf_dir):
    labeled = session.cut(_labeled(spark, sf_dir).select("id", "risk_label"))
    frames = [cleaning.by_risk_level(labeled, level).select("id", F.lit(level).alias("level")) for level in ("Low", "Medium", "high")]
    return tables.union_all(frames)


@register
def story_lookup(spark, sf_dir):
    wanted = tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return tables.stories(spark, sf_dir).join(wanted, "id").select("id", "idproject", "title", "description", "storypoints")


@register
def story_count(spark, sf_dir):
    return tables.stories(spark, sf_dir).agg(F.count("*").alias("n"))


@register
def to_story(spark, sf_dir):
    return cleaning.to_story(_labeled(spark, sf_dir))


@register
def estimation_flags(spark, sf_dir):
    flagged = cleaning.estimation_flags(tables.stories(spark, sf_dir))
    return flagged.select("id", "storypoints", "actual_points", "was_underestimated", "estimation_accuracy")


@register
def symbolic_features(spark, sf_dir):
    return _symbolic(spark, sf_dir).drop("idproject")


# --- labeling functions and label model ---------------------------------------------------------------


@register
def lf_votes(spark, sf_dir):
    return _votes(spark, sf_dir)


@register
def list_items_numbered(spark, sf_dir):
    return cleaning.numbered_items(tables.stories(spark, sf_dir)).select("id", "list_items")


@register
def custom_lf(spark, sf_dir):
    """User-defined functions next to the built-in ones."""

    @labeling.labeling_function(vote=1)
    def lf_long_title():
        return F.col("title_word_count") >= 4

    @labeling.labeling_function(vote=0, name="lf_listed")
    def listed():
        return F.col("has_list") & (F.col("word_count") < 100)

    return labeling.apply_functions(_cleaned(spark, sf_dir), [lf_long_title, listed])


@register
def vote_distribution(spark, sf_dir):
    return labeling.vote_distribution(_patterns(spark, sf_dir))


@register
def lf_summary(spark, sf_dir):
    return labeling.lf_summary(_patterns(spark, sf_dir))


@register
def lf_overall(spark, sf_dir):
    return labeling.lf_overall(_patterns(spark, sf_dir))


@register
def lf_correlation(spark, sf_dir):
    return labeling.lf_correlation(_patterns(spark, sf_dir))


@register
def lf_correlation_mean(spark, sf_dir):
    return labeling.lf_correlation(_patterns(spark, sf_dir)).agg(F.avg("r").alias("mean_r"), F.count("r").alias("n_pairs"))


@register
def label_model_moments(spark, sf_dir):
    return label_model.moments(_patterns(spark, sf_dir))


@register
def label_model_params(spark, sf_dir):
    return label_model.params(flows.fit_label_model(_patterns(spark, sf_dir)), spark)


@register
def soft_labels(spark, sf_dir):
    return label_model.soft_labels(_votes(spark, sf_dir)).select("id", "risk_prob_safe", "risk_prob_risk")


@register
def probabilistic_labels(spark, sf_dir):
    return _labeled(spark, sf_dir).select("id", *label_model.LABEL_COLUMNS)


@register
def label_stats(spark, sf_dir):
    return label_model.label_stats(_labeled(spark, sf_dir))


@register
def weak_label_metrics(spark, sf_dir):
    patterns = session.cut(_patterns(spark, sf_dir))
    return label_model.weak_label_metrics(
        labeling.lf_summary(patterns), labeling.lf_overall(patterns), label_model.label_stats(_labeled(spark, sf_dir))
    )


@register
def weak_labels(spark, sf_dir):
    return flows.weak_labels(tables.stories(spark, sf_dir)).select("id", *label_model.LABEL_COLUMNS)


# --- noise --------------------------------------------------------------------------------------------


def _tfidf(spark, sf_dir):
    texts = tfidf.with_terms(_cleaned(spark, sf_dir).select("id", "full_text"))
    model = tfidf.fit(texts, size=1000, max_df=0.8, min_df=2)
    return model.transform(texts), model


@register
def tfidf_vectors(spark, sf_dir):
    return tfidf.long_form(*_tfidf(spark, sf_dir))


@register
def tfidf_stats(spark, sf_dir):
    return tfidf.stats(*_tfidf(spark, sf_dir))


@register
def folds(spark, sf_dir):
    return splits.contiguous_folds(tables.predictions(spark, sf_dir), "given")


@register
def oob_probs(spark, sf_dir):
    return flows.cross_validated(session.cut(_labeled(spark, sf_dir).select("id", "full_text", "risk_label_binary")))


@register
def prob_stats(spark, sf_dir):
    return noise.probability_stats(tables.predictions(spark, sf_dir), ["pb0", "pb1"])


@register
def cl_thresholds(spark, sf_dir):
    return noise.thresholds(tables.predictions(spark, sf_dir))


@register
def confident_joint(spark, sf_dir):
    return noise.confident_joint(tables.predictions(spark, sf_dir))


@register
def label_issues(spark, sf_dir):
    return _flagged(spark, sf_dir).select("id", "given", "is_issue")


@register
def issue_breakdown(spark, sf_dir):
    return noise.issue_breakdown(_flagged(spark, sf_dir))


@register
def label_health(spark, sf_dir):
    return noise.label_health(tables.predictions(spark, sf_dir))


@register
def pruned(spark, sf_dir):
    preds = tables.predictions(spark, sf_dir)
    return noise.prune(preds.select("id", "y", "given"), _flagged(spark, sf_dir))


@register
def prune_report(spark, sf_dir):
    return noise.prune_report(_flagged(spark, sf_dir))


@register
def noise_metrics(spark, sf_dir):
    return noise.noise_metrics(_flagged(spark, sf_dir), noise.label_health(tables.predictions(spark, sf_dir)))


# --- splits and features ------------------------------------------------------------------------------


@register
def stratified_split(spark, sf_dir):
    return splits.stratified_split(_cleaned(spark, sf_dir), "idproject")


@register
def group_split(spark, sf_dir):
    return splits.group_split(_cleaned(spark, sf_dir), "idproject")


@register
def label_split(spark, sf_dir):
    return splits.label_split(tables.predictions(spark, sf_dir), "y")


@register
def split_distribution(spark, sf_dir):
    preds = tables.predictions(spark, sf_dir)
    return splits.split_distribution(splits.label_split(preds, "y"), preds, "y")


@register
def sample_weights(spark, sf_dir):
    return splits.sample_weights(tables.predictions(spark, sf_dir).select("id", "y"), "y")


@register
def scaled_features(spark, sf_dir):
    return _scaled(spark, sf_dir)


@register
def fused_features(spark, sf_dir):
    """All stories; those without a given embedding have zeros there."""
    embedded = tables.embeddings(spark, sf_dir)
    fused = matrix.fuse(_scaled(spark, sf_dir), embedded, FEATURE_NAMES)
    return fused.select("id", F.posexplode_outer("features").alias("position", "value"))


@register
def tfidf_bigram(spark, sf_dir):
    """Fitted on the labelled training stories, applied to all stories."""
    preds = tables.predictions(spark, sf_dir)
    split = splits.label_split(preds, "y").select("id", "split")
    terms = tfidf.with_terms(_cleaned(spark, sf_dir).select("id", "full_text"), bigrams=True)
    texts = session.cut(terms.drop("full_text").join(split, "id", "left"))
    model = tfidf.fit(texts.filter(F.col("split") == "train"))
    return tfidf.long_form(model.transform(texts), model)


@register
def embed_text(spark, sf_dir):
    return matrix.embed_texts(_cleaned(spark, sf_dir).select("id", "full_text"), "full_text").select("id", "embedding")


@register
def l2_normalized(spark, sf_dir):
    unit = tables.embeddings(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 3))
    return unit.select("id", F.posexplode_outer(l2_normalize(F.col("embedding"))).alias("position", "value"))


@register
def dedup_score(spark, sf_dir):
    docs = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    scored = matrix.score_distinct(docs, "text", lambda d: features.symbolic_features(d, "text"))
    return scored.select("id", "flesch_reading_ease", "word_count", "sentence_count")


# --- models and decisions -----------------------------------------------------------------------------


@register
def train_risk(spark, sf_dir):
    trained = _trained_whole(spark, sf_dir)
    return trained.test.select("id", "y", "p0", "p1", "p2")


@register
def learning_curve(spark, sf_dir):
    trained = _trained(spark, sf_dir)
    return training.learning_curve(trained.model, trained.frame)


@register
def best_round(spark, sf_dir):
    return evaluation.best_round(tables.loss_rows(spark, sf_dir))


@register
def argmax_class(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "y_pred")


@register
def train_logreg(spark, sf_dir):
    encoded = cleaning.encode_labels(_classes(spark, sf_dir)).select("id", "full_text", F.col("risk_class").alias("y"))
    texts = tfidf.with_terms(session.cut(encoded))
    vectors = tfidf.fit(texts, max_df=0.8, min_df=2).transform(texts).select("id", "y", "features")
    model = training.fit_logistic(vectors)
    return training.class_probabilities(model, vectors).select("id", "y", "p0", "p1", "p2")


@register
def feature_importance(spark, sf_dir):
    trained = _trained(spark, sf_dir)
    return trained.model.importances(spark, trained.names, FEATURE_NAMES).orderBy(F.desc("importance"), "feature").limit(20)


@register
def isotonic_fit(spark, sf_dir):
    return training.calibration_table(training.isotonic_pools(tables.predictions(spark, sf_dir)))


@register
def renormalize(spark, sf_dir):
    preds = tables.predictions(spark, sf_dir)
    sharpened = preds.select("id", *[(F.greatest(F.col(p) - 0.3, F.lit(0.0))).alias(p) for p in ("p0", "p1", "p2")])
    return decisions.renormalize(sharpened)


@register
def calibrated(spark, sf_dir):
    preds = tables.predictions(spark, sf_dir)
    return training.calibrate(preds.select("id", "y", "p0", "p1", "p2"), training.fit_calibration(preds))


@register
def ece(spark, sf_dir):
    return evaluation.expected_calibration_error(tables.predictions(spark, sf_dir))


@register
def calibration_curve(spark, sf_dir):
    return evaluation.calibration_curve(tables.predictions(spark, sf_dir))


@register
def calibration_gap(spark, sf_dir):
    return evaluation.calibration_gap(evaluation.calibration_curve(tables.predictions(spark, sf_dir)))


@register
def cost_decision(spark, sf_dir):
    return decisions.with_cost_decision(tables.predictions(spark, sf_dir)).select("id", "y_pred", "chosen_cost")


@register
def realized_cost(spark, sf_dir):
    return decisions.realized_cost(decisions.with_cost_decision(tables.predictions(spark, sf_dir)))


@register
def cost_matrix(spark, sf_dir):
    return decisions.cost_matrix(tables.predictions(spark, sf_dir), 100.0)


@register
def risk_decision(spark, sf_dir):
    return decisions.risk_decision(tables.predictions(spark, sf_dir)).select("id", "risk_level", "confidence")


@register
def assessment_fallback(spark, sf_dir):
    scored = decisions.risk_decision(tables.predictions(spark, sf_dir))
    return decisions.assessments(scored, tables.stories(spark, sf_dir))


@register
def score_stories(spark, sf_dir):
    """Every story, by a bundle that was saved and loaded again."""
    path = session.scratch_path(spark, "bundle")
    _trained(spark, sf_dir).bundle.save(spark, path)
    stories = tables.stories(spark, sf_dir)
    corpus = session.cut(flows.embedded_corpus(stories))
    found = flows.assess(stories, flows.Bundle.load(spark, path), corpus)
    return joined(found.withColumn("similar_ids", F.transform("similar_ids", lambda x: x.cast("string"))), "similar_ids")


# --- evaluation ---------------------------------------------------------------------------------------


@register
def accuracy(spark, sf_dir):
    return evaluation.accuracy(_scored(spark, sf_dir))


@register
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(_scored(spark, sf_dir))


@register
def class_report(spark, sf_dir):
    return evaluation.class_report(_scored(spark, sf_dir))


@register
def f1_summary(spark, sf_dir):
    return evaluation.f1_summary(evaluation.class_report(_scored(spark, sf_dir)))


@register
def roc_points(spark, sf_dir):
    return evaluation.roc_points(_curve(spark, sf_dir))


@register
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(_curve(spark, sf_dir))


@register
def pr_points(spark, sf_dir):
    return evaluation.pr_points(_curve(spark, sf_dir))


@register
def average_precision(spark, sf_dir):
    return evaluation.average_precision(_curve(spark, sf_dir))


@register
def ablation_summary(spark, sf_dir):
    return flows.ablation_summary(flows.decision_runs(tables.predictions(spark, sf_dir)))


@register
def ablation_run(spark, sf_dir):
    return flows.ablation_summary(flows.ablation(tables.stories(spark, sf_dir)))


# --- explanation --------------------------------------------------------------------------------------


@register
def attributions(spark, sf_dir):
    return explain.attributions(_factors(spark, sf_dir))


@register
def top_factors(spark, sf_dir):
    return explain.top_factors(_factors(spark, sf_dir))


@register
def factor_text(spark, sf_dir):
    symbolic = _symbolic(spark, sf_dir)
    long = symbolic.unpivot(["id"], FEATURE_NAMES, "feature", "value")
    said = explain.factor_sentence(F.col("feature"), F.col("value"))
    return long.select("id", "feature", said.alias("sentence")).filter(F.col("sentence").isNotNull())


@register
def explanations(spark, sf_dir):
    """All stories; those without probabilities get their factors alone."""
    probabilities = tables.predictions(spark, sf_dir).select("id", "p0", "p1", "p2")
    return explain.explanations(_factors(spark, sf_dir).join(probabilities, "id", "left"))


@register
def global_importance(spark, sf_dir):
    return explain.global_importance(explain.attributions(_factors(spark, sf_dir)))


@register
def beeswarm_data(spark, sf_dir):
    long = explain.attributions(_factors(spark, sf_dir))
    return explain.beeswarm(long, explain.global_importance(long), 3)


@register
def waterfall_data(spark, sf_dir):
    return explain.waterfall(_factors(spark, sf_dir), 3)


@register
def dependence_data(spark, sf_dir):
    return explain.dependence(_factors(spark, sf_dir), "word_count", tables.FACTOR_FEATURES)


@register
def example_high(spark, sf_dir):
    return explain.first_example(tables.predictions(spark, sf_dir))


# --- similarity ---------------------------------------------------------------------------------------


@register
def similar_topk(spark, sf_dir):
    return similarity.top_k(tables.embeddings(spark, sf_dir), k=5, min_similarity=0.0)


@register
def similar_by_vec(spark, sf_dir):
    """Queries of any length: vectors are doubled first and brought back to unit length."""
    doubled = tables.embeddings(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 2))
    unit = doubled.withColumn("embedding", similarity.unit_unless_close(F.col("embedding")))
    return similarity.top_k(unit, k=5, min_similarity=-1.0)


@register
def similar_ids(spark, sf_dir):
    near = similarity.top_k(tables.embeddings(spark, sf_dir), k=5)
    return similarity.similar_ids(near).select("query_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@register
def similar_detail(spark, sf_dir):
    near = similarity.top_k(tables.embeddings(spark, sf_dir), k=3)
    return similarity.with_details(near, _classes(spark, sf_dir))


@register
def similar_blocked(spark, sf_dir):
    """The same answer from many small bands of queries and corpus."""
    return similarity.top_k(tables.embeddings(spark, sf_dir), k=5, min_similarity=0.0, block=150)


@register
def similar_queries(spark, sf_dir):
    """Every row whose id is divisible by 100, against all rows."""
    corpus = tables.embeddings(spark, sf_dir)
    return similarity.search(corpus.filter(F.col("id") % 100 == 0), corpus, k=5, others_only=True)


def _story_vectors(spark, sf_dir):
    return session.cut(flows.embedded_corpus(tables.stories(spark, sf_dir)))


@register
def similar_approx(spark, sf_dir):
    """Close neighbours of every hundredth story among all stories, by random planes."""
    corpus = _story_vectors(spark, sf_dir)
    return similarity.approximate(corpus.filter(F.col("id") % 100 == 0), corpus, k=5, min_similarity=0.9, others_only=True)


@register
def similar_recall(spark, sf_dir):
    """Share of the exact close neighbours of all stories that the approximate search finds."""
    corpus = _story_vectors(spark, sf_dir)
    exact = similarity.top_k(corpus, k=5, min_similarity=0.9)
    return similarity.recall(similarity.approximate(corpus, corpus, k=5, min_similarity=0.9, others_only=True), exact)


@register
def embedding_store(spark, sf_dir):
    """Texts encoded by a first and a second run over the same stories."""
    path, stories = session.scratch_path(spark, "vectors"), _cleaned(spark, sf_dir).select("id", "full_text")
    encoded = [vectors.add_texts(stories, "full_text", path) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(encoded, 1)), "run int, encoded bigint")
    found = vectors.embedded(stories, "full_text", path)
    return rows.withColumn("embedded", found.agg(F.count("embedding")).scalar())


@register
def cluster_outliers(spark, sf_dir):
    """Vote for stories in small clusters or far from every centre."""
    rows = session.cut(flows.embedded_corpus(tables.stories(spark, sf_dir)))
    return clusters.outlier_votes(rows, clusters.fit(rows))


@register
def embedding_pca(spark, sf_dir):
    rows = training.as_vector(
        tables.embeddings(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), "embedding"
    )
    model = PCA(k=2, inputCol="embedding", outputCol="_xy").fit(rows)
    xy = vector_to_array("_xy")
    return model.transform(rows).select("id", "label", xy[0].alias("x"), xy[1].alias("y"))


# --- health and scope ---------------------------------------------------------------------------------


@register
def health_scores(spark, sf_dir):
    return health.health_scores(_health_rows(spark, sf_dir))


@register
def health_report(spark, sf_dir):
    return joined(health.health_report(_health_rows(spark, sf_dir)))


@register
def health_by_project(spark, sf_dir):
    return joined(health.health_report(_health_rows(spark, sf_dir), ["idproject"]))


@register
def days_needed(spark, sf_dir):
    rows = tables.sprints(spark, sf_dir)
    return rows.select("id", scope.days_needed(F.col("new_points"), F.col("velocity")).alias("days"))


@register
def business_days(spark, sf_dir):
    rows = tables.sprints(spark, sf_dir)
    end = scope.add_business_days(F.col("end_date"), F.col("new_points"))
    return rows.select("id", F.date_format(end, "yyyy-MM-dd").alias("new_end_date"))


@register
def scope_impact(spark, sf_dir):
    return joined(scope.scope_impact(tables.sprints(spark, sf_dir)))


@register
def team_velocity(spark, sf_dir):
    return scope.team_velocity(tables.sprints(spark, sf_dir), "team", "new_points", "end_date")


# --- flows --------------------------------------------------------------------------------------------


@register
def stage_funnel(spark, sf_dir):
    required = ["storypoints", "description", "title"]
    stories = tables.stories(spark, sf_dir)
    complete = sum((F.col(c).isNull().cast("int") for c in required), F.lit(0)) == 0
    filled = stories.withColumn("_complete", complete).fillna({"storypoints": 0.0, "description": "", "title": ""})
    labeled = flows.labeled_by_assumption(filled)
    kept = F.col("_complete")
    return flows.funnel_of(
        labeled,
        [
            ("raw", F.lit(True)),
            ("weak_labels", kept),
            ("confident", kept & (F.col("risk_confidence") > 0.5)),
            ("high_confidence", kept & (F.col("risk_confidence") > 0.75)),
        ],
    )


@register
def risk_points_correlation(spark, sf_dir):
    return _labeled(spark, sf_dir).agg(F.corr("risk_prob_risk", "story_points").alias("r"))


@register
def augment_stories(spark, sf_dir):
    return flows.augment(tables.stories(spark, sf_dir)).classes.select("id", "risk_label", "risk_confidence")


@register
def train_report(spark, sf_dir):
    return flows.training_report(_trained_whole(spark, sf_dir))


@register
def stream_score(spark, sf_dir):
    output, checkpoint = session.scratch_path(spark, "scored"), session.scratch_path(spark, "scored-state")
    documents = scoring.open_stream(spark, sf_dir, "documents.parquet")
    scoring.start_scoring(documents, output, checkpoint).awaitTermination()
    return spark.read.parquet(output)


def _requests(documents):
    """documents -> requests: stories as they arrive, complete or not."""
    return tables.stories_from(documents).select("id", "title", "description")


@register
def stream_assess(spark, sf_dir):
    """Every document as an arriving request, assessed by a bundle that was saved and loaded again."""
    folder = session.scratch_path(spark, "assessed")
    _trained(spark, sf_dir).bundle.save(spark, f"{folder}/bundle")
    corpus = session.cut(flows.embedded_corpus(tables.stories(spark, sf_dir)))
    arriving = _requests(scoring.open_stream(spark, sf_dir, "documents.parquet"))
    requests.start(
        arriving, lambda: flows.Bundle.load(spark, f"{folder}/bundle"), f"{folder}/answers", f"{folder}/state", corpus
    ).awaitTermination()
    found = requests.answers(spark, f"{folder}/answers")
    shown = found.withColumn("similar_ids", F.transform("similar_ids", lambda x: x.cast("string")))
    return joined(joined(shown.drop("features", "batch_id"), "similar_ids"), "reasons")
