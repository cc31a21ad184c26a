"""Fitted steps, similarity, files and streams: invariants and brute-force comparisons."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from plumbline import session
from plumbline.config import COST_MATRIX, FEATURE_NAMES, LF_NAMES
from plumbline.functions.arrays import l2_normalize
from plumbline.operators import cleaning, label_model, labeling, matrix, noise, similarity, tfidf, training
from plumbline.plans import flows
from plumbline.sources import files, tables
from plumbline.streaming import scoring

DATA = "/root/testdata/sf0.001"


def brute_force(ids, vectors, k):
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(v @ v.T, 12)
    out = {}
    for i, own in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], -ids[j]))[:k]
        out[own] = [ids[j] for j in order]
    return out


def neighbours(df, **kw):
    out = {}
    for r in similarity.top_k(df, min_similarity=-1.0, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("shape", [{}, {"block": 20}])
def test_neighbours_with_hot_copies_equal_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    vectors = centres[rng.integers(0, 6, 240)] + 0.1 * rng.normal(size=(240, 8))
    vectors[:80] = vectors[0]  # a third of all rows are copies of one vector
    ids = [int(i) for i in rng.permutation(1000)[:240]]
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    assert neighbours(df, k=4, **shape) == brute_force(ids, vectors, 4)


def test_threshold_applies_after_the_cut(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "id bigint, embedding array<double>")
    rows = similarity.top_k(df, k=1, min_similarity=0.5).collect()
    assert {(r["query_id"], r["id"]) for r in rows} == {(1, 3), (3, 1)}


def test_vector_lengths(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.005, 0.0],)], "v array<double>")
    unit = [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()]
    assert unit == [[0.6, 0.8], [0.0, 0.0], [1.0, 0.0]]
    assert [r[0] for r in df.select(similarity.unit_unless_close(F.col("v"))).collect()][2] == [1.005, 0.0]


def test_label_model_trusts_the_better_functions(spark):
    """Votes drawn from known accuracies: the fitted conditional probabilities are close to the truth."""
    rng = np.random.default_rng(1)
    n, accuracy = 6000, [0.9, 0.8, 0.7, 0.6]
    truth = rng.integers(0, 2, n)
    names = [f"f{j}" for j in range(4)]
    columns = {name: np.where(rng.random(n) < a, truth, 1 - truth) for name, a in zip(names, accuracy)}
    votes = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), **columns}))
    mu = label_model.fit(label_model.moments(labeling.vote_patterns(votes, names), names), 4, epochs=4000, rate=0.02)
    assert np.allclose([mu[2 * j + 1, 1] for j in range(4)], accuracy, atol=0.06)
    soft = label_model.hard_labels(label_model.soft_labels(votes, label_model.fitted_log_odds(mu, names)))
    got = soft.orderBy("id").select("risk_label_binary").toPandas()["risk_label_binary"].to_numpy()
    assert (got == truth).mean() > 0.88


def test_ties_and_missing_votes_are_safe(spark):
    votes = spark.createDataFrame([(1, *[-1] * 18)], "id int, " + ", ".join(f"{n} int" for n in LF_NAMES))
    row = label_model.hard_labels(label_model.soft_labels(votes)).collect()[0]
    assert (row["risk_label"], row["risk_prob_risk"], row["risk_confidence"]) == ("SAFE", 0.5, 0.5)


def test_weak_labels_are_probabilities(spark):
    rows = flows.weak_labels(tables.stories(spark, DATA), epochs=50)
    bad = rows.filter((F.abs(F.col("risk_prob_safe") + F.col("risk_prob_risk") - 1) > 1e-9) | (F.col("risk_confidence") < 0.5))
    assert rows.count() == cleaning.preprocess(tables.stories(spark, DATA)).count() and bad.count() == 0


def test_held_out_probabilities_cover_every_row_once(spark):
    n = 120
    rows = [(i, f"alpha beta word{i % 5}" if i % 2 else f"gamma delta word{i % 5}", i % 2) for i in range(n)]
    labeled = spark.createDataFrame(rows, "id bigint, full_text string, risk_label_binary int")
    held_out = flows.cross_validated(labeled)
    assert held_out.select("id").distinct().count() == n == held_out.count()
    assert held_out.filter((F.col("pb1") > 0.5) != (F.col("given") == 1)).count() == 0
    assert noise.flag_issues(held_out).filter("is_issue").count() == 0


def test_tfidf_weights(spark):
    df = tfidf.with_terms(spark.createDataFrame([(1, "Apple apple pear x"), (2, "pear plum")], "id int, full_text string"))
    model = tfidf.fit(df)
    got = {(r["id"], r["term"]): r["tfidf"] for r in tfidf.long_form(model.transform(df), model).collect()}
    idf = np.log(3 / 2) + 1
    norm = np.hypot(2 * idf, 1)
    assert got[(1, "apple")] == pytest.approx(2 * idf / norm) and got[(1, "pear")] == pytest.approx(1 / norm)
    assert set(got) == {(1, "apple"), (1, "pear"), (2, "pear"), (2, "plum")}
    pairs = tfidf.with_terms(spark.createDataFrame([(1, "one"), (2, "aa bb cc")], "id int, full_text string"), bigrams=True)
    assert [r["terms"] for r in pairs.orderBy("id").collect()] == [["one"], ["aa", "bb", "cc", "aa bb", "bb cc"]]


def test_equal_texts_are_encoded_once(spark, tmp_path):
    log = str(tmp_path)

    def encoder():
        import uuid

        def encode(texts):
            with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(len(texts)))
            return np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)

        return encode

    df = spark.createDataFrame([(i, "same" if i % 3 else f"text {i}") for i in range(30)], "id int, t string")
    rows = matrix.embed_texts(df, "t", encoder=encoder).collect()
    assert len(rows) == 30 and all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 for r in rows)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 11


def test_hashed_embeddings_are_unit_or_zero(spark):
    df = spark.createDataFrame([(1, "some words here"), (2, ""), (3, "some words here")], "id int, t string")
    a, b, c = (np.array(r["embedding"]) for r in matrix.embed_texts(df, "t").orderBy("id").collect())
    assert np.linalg.norm(a) == pytest.approx(1) and not b.any() and (a == c).all()


def test_training_scores_and_artifacts(spark, tmp_path):
    rows = [(i, i % 4, [float(i % 3), float(i % 7)], i % 3) for i in range(180)]
    df = training.as_vector(spark.createDataFrame(rows, "id int, idproject int, features array<double>, y int"))
    df = df.withColumn("weight", F.lit(1.0)).withColumn("is_val", F.col("id") % 5 == 0)
    model = training.fit_boosting(df, training.BoostingSettings(rounds=3, step=0.3))
    scored = model.transform(df)
    assert scored.filter(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count() == 0
    best = scored.select("y", F.array("p0", "p1", "p2").alias("p")).filter(F.expr("array_position(p, array_max(p)) - 1 = y"))
    assert best.count() > 160
    model.save(str(tmp_path / "trees"))
    again = training.BoostedModel.load(str(tmp_path / "trees")).transform(df)
    assert again.select("id", "p0").exceptAll(scored.select("id", "p0")).count() == 0
    curve = training.learning_curve(model, df)
    assert curve.groupBy("run", "split").count().count() == 6
    names = model.importances(spark, ["a", "b"], ["a"]).collect()
    assert {r["kind"] for r in names} == {"symbolic", "embedding"}
    calibrated = training.calibrate(scored.select("id", "y", "p0", "p1", "p2"), training.fit_calibration(scored))
    assert calibrated.filter(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count() == 0


def test_model_pipeline_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1)], "t string, id int")
    from pyspark.ml.feature import RegexTokenizer

    model = PipelineModel(stages=[RegexTokenizer(inputCol="t", outputCol="w")])
    files.save_model(model, str(tmp_path / "m"))
    assert files.load_model(str(tmp_path / "m")).transform(df).first()["w"] == ["a", "b"]


def test_training_flow(spark):
    classes = cleaning.map_to_classes(flows.labeled_by_assumption(tables.stories(spark, DATA)), 0.85)
    trained = flows.train(classes, training.BoostingSettings(rounds=2), symbolic_weight=2)
    assert trained.frame.first()["features"].size == 15 + 64 + 15
    assert trained.model.importances(spark, trained.names, FEATURE_NAMES).count() == 79
    report = {r["metric"]: r["value"] for r in flows.training_report(trained).collect()}
    assert 0 <= report["accuracy"] <= 1 and report["n"] > 0
    scored = flows.score(trained.frame, trained.bundle)
    assert scored.filter(~F.col("risk_level").isin("Low", "Medium", "High")).count() == 0


def test_augmentation_flow(spark):
    stages = flows.augment(tables.stories(spark, DATA), epochs=50)
    flagged = stages.flagged.filter("is_issue").count()
    assert stages.labeled.count() - stages.pruned.count() == flagged
    assert stages.classes.filter(~F.col("risk_label").isin("Low", "Medium", "High")).count() == 0


def test_csv_keeps_awkward_texts(spark, tmp_path):
    rows = [(1, ' a "quoted", text\nwith breaks \\ '), (2, ""), (3, None), (4, "\\N?")]
    df = spark.createDataFrame(rows, "id bigint, description string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == rows


def test_split_fallback_and_missing_path(spark, tmp_path):
    raw = spark.createDataFrame([(1, 2, "x", "t", "d", 3.0)], files.RAW_SCHEMA)
    with pytest.raises(FileNotFoundError):
        files.load_split(spark, str(tmp_path))
    raw.write.parquet(str(tmp_path / "issues"))
    assert files.load_split(spark, str(tmp_path)).count() == 1
    raw.union(raw).write.parquet(str(tmp_path / "train"))
    assert files.load_split(spark, str(tmp_path)).count() == 2
    with pytest.raises(FileNotFoundError, match="run the labeling"):
        files.read_or_explain(spark, str(tmp_path / "none"), "run the labeling first")


def test_settings_and_metric_log(spark, tmp_path):
    settings = {"cost_matrix": COST_MATRIX, "names": ["ä", "b"], "stage_counts": {"raw": 3}}
    files.save_settings(spark, str(tmp_path / "s"), settings)
    assert files.load_settings(spark, str(tmp_path / "s")) == settings
    metrics = spark.createDataFrame([("noise", "health", 0.5)], "stage string, metric string, value double")
    for run in ("a", "b"):
        files.append_metrics(metrics, str(tmp_path / "m"), run)
    assert {(r["run_id"], r["key"], r["step"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {
        ("a", "noise/health", None), ("b", "noise/health", None)
    }


def test_high_confidence_rows_come_from_one_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.75), (2, 0.8)], "id int, risk_confidence double")
    files.write_high_confidence(df, str(tmp_path / "h"), 0.75)
    high = files.read_labeled(spark, str(tmp_path / "h"), high_conf_only=True)
    assert [r["id"] for r in high.collect()] == [2]
    assert "PartitionFilters: [isnotnull(high_conf" in high._jdf.queryExecution().toString()


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    source = tmp_path / "in"
    docs.filter("doc_id < 120").coalesce(1).write.parquet(str(source / "a"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        scoring.start_scoring(scoring.open_stream(spark, f"{source}/*"), out, state).awaitTermination()

    run()
    docs.filter("doc_id >= 120").coalesce(1).write.parquet(str(source / "b"))
    run()
    run()
    streamed, batch = spark.read.parquet(out), scoring.score_rows(docs)
    assert streamed.count() == docs.count()
    assert streamed.exceptAll(batch.select(streamed.columns)).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
