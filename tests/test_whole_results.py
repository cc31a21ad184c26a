"""No row, factor or group is lost, and each report reads its input once."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import explain, label_model, ranking, scope, similarity, splits, training
from plumbline.plans import flows
from plumbline.plans.catalog import REGISTRY
from plumbline.sources import files, tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.range(100).select("id", F.when(F.col("id") % 4 > 0, (F.col("id") % 3).cast("string")).alias("g"))


def test_null_groups_are_kept(grouped):
    for out in (splits.stratified_split(grouped, "g"), splits.label_split(grouped, "g"), splits.contiguous_folds(grouped, "g"),
                splits.sample_weights(grouped, "g")):
        assert out.count() == 100 and out.filter("g IS NULL").count() == 25
    medians = ranking.exact_median(grouped.withColumn("v", F.col("id").cast("double")), ["g"], "v")
    assert {r["g"]: r["median"] for r in medians.collect()}[None] == 48.0
    weight = {r["g"]: r["weight"] for r in splits.sample_weights(grouped, "g").distinct().collect()}
    assert weight[None] == pytest.approx(100 / (4 * 25))


def test_waterfall_adds_up_for_any_number_of_factors(spark):
    names = [f"f{k}" for k in range(1100)]
    row = spark.range(1).select("id", F.lit(0).alias("predicted"), F.array(F.transform(
        F.array(*[F.lit(n) for n in names]), lambda n: F.struct(n.alias("feature"), F.lit(2.0).alias("value"), F.lit(1.0).alias("phi")))).alias("phis"))
    steps = explain.waterfall(row, 3).orderBy("step").collect()
    assert [s["running"] for s in steps] == [1.0, 2.0, 3.0, 1100.0]


def test_explanation_is_about_the_decided_class(spark):
    rows = spark.range(1).select("id", F.lit(2.0).alias("a"))
    factors = explain.with_attributions(rows, ["a"], [[1.0], [0.0], [-1.0]], means={"a": 1.0})
    decided = factors.select("*", F.lit(2).alias("y_pred"), *[F.lit(1 / 3).alias(p) for p in ("p0", "p1", "p2")])
    assert explain.explanations(decided, decided="y_pred").first()["risk_level"] == "High"


def test_rare_functions_keep_their_weight():
    assert label_model.floor(50) == 0.01 and label_model.floor(18_849) == pytest.approx(1e-5)
    assert label_model.floor(0) == 0.01


def test_scope_quarantine_completes_the_answers(spark):
    day = datetime.date(2025, 11, 17)
    rows = [(k, day, 20, p, v) for k, (p, v) in enumerate([(4, 2.0), (4, 0.0), (4, -1.0), (4, None), (None, 1.0)])]
    df = spark.createDataFrame(rows, "id long, end_date date, current_points int, new_points int, velocity double")
    held = scope.scope_quarantine(df)
    assert {r["id"]: r["reason"] for r in held.collect()} == {
        1: "velocity is not positive", 2: "velocity is not positive", 3: "velocity is missing", 4: "points are missing"}
    assert scope.scope_impact(df).count() + held.count() == 5


def test_queries_against_a_corpus(spark):
    rng = np.random.default_rng(8)
    corpus, asked = rng.normal(size=(300, 6)), rng.normal(size=(40, 6))
    frames = [spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rows)], f"{name} long, embedding array<double>")
              for name, rows in (("id", corpus), ("question", asked))]
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (asked, corpus)]
    sims = np.round(unit[0] @ unit[1].T, 12)
    wanted = {(q, r + 1, int(c)) for q in range(40) for r, c in enumerate(np.lexsort((-np.arange(300), -sims[q]))[:4])}
    for block in (7, 4096):
        found = similarity.search(frames[1], frames[0], k=4, min_similarity=-1.0, query_id="question", block=block)
        assert {(r["query_id"], r["rank"], r["id"]) for r in found.collect()} == wanted
    assert similarity.search(frames[1].limit(0), frames[0], query_id="question").count() == 0


def test_neighbours_without_a_story_stay(spark):
    near = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 0.4)], "query_id long, rank int, id long, similarity double")
    stories = spark.createDataFrame([(5, "t", "d", "High", 3.0)], "id long, title string, description string, risk_label string, story_points double")
    assert {(r["id"], r["title"]) for r in similarity.with_details(near, stories).collect()} == {(5, "t"), (6, None)}


def test_saved_bundle_scores_every_story_alike(spark, tmp_path):
    stories = tables.stories(spark, DATA)
    trained = flows.train(_classes(spark))
    corpus = session.cut(flows.embedded_corpus(stories))
    trained.bundle.save(spark, str(tmp_path))
    loaded = flows.Bundle.load(spark, str(tmp_path))
    columns = ["id", "risk_level", "confidence", "p0", "p1", "p2", "explanation", "similar_ids"]
    first, second = ({r["id"]: r for r in flows.assess(stories, b, corpus).select(*columns).collect()} for b in (trained.bundle, loaded))
    assert first == second and len(first) == stories.count()
    complete = stories.filter("title IS NOT NULL AND description IS NOT NULL AND storypoints IS NOT NULL").count()
    assert sum(r["p0"] is not None for r in first.values()) == complete < len(first)
    for r in first.values():
        if r["p0"] is None:
            assert (r["risk_level"], r["confidence"], r["explanation"]) == ("Medium", 50.0, None)
        else:
            assert f"**{r['risk_level']} Risk**" in r["explanation"] and math.isclose(r["p0"] + r["p1"] + r["p2"], 1.0)
            assert r["id"] not in r["similar_ids"]


def _classes(spark):
    from plumbline.operators import cleaning

    return cleaning.map_to_classes(flows.labeled_by_assumption(tables.stories(spark, DATA)))


@pytest.mark.parametrize("name", ["stage_funnel", "value_counts"])
def test_one_scan_of_the_documents(spark, name):
    df = REGISTRY[name](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") - plan.count("ReusedExchange") <= 1


def test_stored_copies_are_pruned_and_released(spark):
    kept = session.cut(spark.range(10).select("id", F.lit("long text").alias("text")))
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and kept.count() == 10
    assert session.release(spark) >= 1
    assert session.release(spark) == 0


def test_rounds_to_keep():
    falling = [1.0 - 0.01 * k for k in range(30)]
    assert training.rounds_to_keep(falling, 3) == 30
    assert training.rounds_to_keep([3.0, 2.0, 1.0, 1.5, 1.4, 1.3, 0.5], 3) == 3
    assert training.rounds_to_keep([3.0, 2.0, 2.5, 1.0, 1.1, 1.2], 3) == 6


def test_boosting_stops_only_beyond_ten_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=3)], int(rng.integers(0, 3)), 1.0, k % 3 == 0) for k in range(240)]
    df = training.as_vector(spark.createDataFrame(rows, "id long, features array<double>, y int, weight double, is_val boolean"))
    for rounds in (4, 20):
        settings = training.BoostingSettings(rounds=rounds, step=0.9, depth=2, partitions=2)
        model = training.fit_boosting(df, settings)
        kept = [m.getNumTrees for m in model.models]
        assert kept == [4] * 3 if rounds == 4 else min(kept) < 20  # random labels: the validation loss rises at once
        again = training.fit_boosting(df.repartition(7), settings)  # however the rows arrive, the model is the same
        assert [m.toDebugString.split("\n")[1:] for m in again.models] == [m.toDebugString.split("\n")[1:] for m in model.models]


def test_augmented_sets_and_funnel_are_written(spark, tmp_path):
    stages = flows.augment(tables.stories(spark, DATA), epochs=30)
    flows.save_augmented(stages, str(tmp_path), "run")
    rows = {(r["stage"], r["metric"]): r["value"] for r in spark.read.parquet(f"{tmp_path}/metrics").collect()}
    assert files.read_labeled(spark, f"{tmp_path}/labeled").count() == rows["pruned", "n"]
    assert files.read_labeled(spark, f"{tmp_path}/labeled", True).count() == rows["high_confidence", "n"]
    order = ("raw", "cleaned", "labeled", "pruned", "high_confidence")
    for a, b in zip(order, order[1:], strict=False):
        assert rows[a, "n"] - rows[b, "n"] == rows[b, "lost"]
    assert spark.read.parquet(f"{tmp_path}/classes").count() == rows["pruned", "n"]
