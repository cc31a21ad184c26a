"""All runs of the ablation in one pass equal the runs one by one; partitions of fits follow the rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cleaning, decisions, evaluation, splits, tfidf, training
from plumbline.plans import flows
from plumbline.sources import tables

DATA = "/root/testdata/sf0.001"


def one_run(df, seed, max_iter):
    encoded = cleaning.encode_labels(df).select("id", "full_text", F.col("risk_class").alias("y"))
    split = splits.label_split(encoded, "y", seed)
    texts = tfidf.with_terms(encoded, bigrams=True).join(split.select("id", "split"), "id")
    train, test = (texts.filter(F.col("split") == part) for part in ("train", "test"))
    vectorizer = tfidf.fit(train)
    model = training.fit_logistic(vectorizer.transform(train).select("id", "y", "features"), max_iter)
    scored = training.class_probabilities(model, vectorizer.transform(test).select("id", "y", "features"))
    return vectorizer, evaluation.f1_summary(evaluation.class_report(decisions.with_argmax(scored))).first()["macro_f1"]


def test_runs_together_equal_runs_alone(spark):
    labeled = flows.labeled_by_assumption(tables.stories(spark, DATA)).cache()
    arms = {"all": cleaning.map_to_classes(labeled), "sure": cleaning.map_without_medium(labeled).filter(F.col("risk_confidence") > 0.6)}
    found = {(r["config"], r["seed"]): r["macro_f1"] for r in flows.compare_arms(labeled, arms, (42, 7), 15).collect()}
    wanted = {(c, s): one_run(df, s, 15)[1] for c, df in arms.items() for s in (42, 7)}
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)
    with pytest.raises(ValueError, match="62"):
        flows.compare_arms(labeled, arms, range(40))


def test_vocabularies_of_all_runs_from_one_aggregate(spark):
    rows = [(1, "b a a", 3), (2, "a c", 1), (3, "c c b", 2), (4, "d", 0), (5, "", 3)]
    df = spark.createDataFrame(rows, "id int, full_text string, train long")
    terms = tfidf.with_terms(df.withColumn("full_text", F.regexp_replace("full_text", r"(\w)", "$1$1")))
    together = tfidf.fit_runs(tfidf.run_counts(terms, 2), [3, 3], size=2)
    for r, model in enumerate(together):
        alone = tfidf.fit(terms.filter(F.col("train").bitwiseAND(1 << r) != 0), size=2)
        assert (model.terms, model.idf) == (alone.terms, alone.idf)


def test_partitions_of_a_fit_follow_its_rows(spark):
    assert [training.fit_partitions(spark, n) for n in (0, 1, 2048, 2049, 10**9)] == [1, 1, 1, 2, 8]
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        assert training.fit_partitions(spark, 10**9) == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
