"""Hand-computed facts about single operators."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.config import FEATURE_NAMES, LF_NAMES
from plumbline.operators import cleaning, decisions, evaluation, health, labeling, noise, scope, splits, validation
from plumbline.operators.features import symbolic_features
from plumbline.operators.ranking import exact_median, global_rank, hashed_rank

STORY = "id bigint, title string, description string, storypoints double"


def stories(spark, *rows):
    return spark.createDataFrame(list(rows), STORY)


def one(df):
    return df.collect()[0].asDict()


def test_preprocess_counts_words_bullets_and_code(spark):
    row = one(cleaning.preprocess(stories(spark, (1, "Fix it", "a  b c\n- one\n• two ```x```", 3.0))))
    assert (row["word_count"], row["title_word_count"], row["list_item_count"]) == (8, 2, 2)
    assert row["has_list"] and row["has_code_block"] and row["story_points"] == 3.0
    assert row["full_text"] == "Fix it " + row["description"]


def test_preprocess_reads_the_older_points_name_and_drops_incomplete_rows(spark):
    df = stories(spark, (1, "t", "d", 1.0), (2, None, "d", 1.0), (3, "t", None, 1.0), (4, "t", "d", None))
    assert [r["id"] for r in cleaning.preprocess(df.withColumnRenamed("storypoints", "weight")).collect()] == [1]
    assert [(r["remaining"], r["removed"]) for r in cleaning.dropna_funnel(df).orderBy("step").collect()] == [
        (4, 0), (3, 1), (2, 1), (1, 1)
    ]


def features_of(spark, text):
    return one(symbolic_features(spark.createDataFrame([(1, text)], "id int, full_text string")))


def test_blank_text_has_zero_features(spark):
    for text in ("", "  \n", None):
        row = features_of(spark, text)
        assert [row[n] for n in FEATURE_NAMES] == [0.0] * 15


def test_features_of_a_small_text(spark):
    row = features_of(spark, "It might work. It was quickly written by Bob! Should we? ```a``` - x\n")
    assert row["weak_modal_density"] == pytest.approx(2 / 4)
    assert row["passive_voice_ratio"] == pytest.approx(1 / 4)
    assert row["question_count"] == 1 and row["code_block_count"] == 1 and row["list_item_count"] == 1
    assert row["has_vague_quantifiers"] == 0.0


def test_lexicons_count_overlapping_terms_separately(spark):
    row = features_of(spark, "OAuth token, quick fix, legacy API")
    assert row["security_count"] == 3  # oauth, the auth inside it, token
    assert row["satd_count"] == 1 and row["complexity_count"] == 2


def test_whole_words_respect_letters_of_other_languages(spark):
    assert features_of(spark, "mayö may_ may.")["weak_modal_density"] == pytest.approx(1.0)


def test_votes_of_a_story(spark):
    df = cleaning.preprocess(stories(spark, (1, "Fix bug", "Handle etc... via OAuth", 8.0), (2, "x", "acceptance criteria", 2.0)))
    a, b = labeling.apply_functions(df).orderBy("id").collect()
    risky = {"lf_ambiguity_loophole", "lf_weak_action_verbs", "lf_high_complexity", "lf_missing_acceptance_criteria",
             "lf_very_short_description", "lf_integration_keywords"}
    assert {n for n in LF_NAMES if a[n] == 1} == risky
    assert {n for n in LF_NAMES if a[n] == 0} == {"lf_bug_fix"}
    assert b["lf_missing_acceptance_criteria"] == -1 and b["lf_low_complexity_safe"] == 0


def test_unusual_points_are_an_anomaly(spark):
    rows = [(i, "t", "d", float(p)) for i, p in enumerate([0, 0.5, 1, 20, 21, 40])]
    votes = labeling.apply_functions(cleaning.preprocess(stories(spark, *rows))).orderBy("id").collect()
    assert [v["lf_fibonacci_anomaly"] for v in votes] == [1, 1, -1, -1, 1, -1]


def test_labels_map_to_classes(spark):
    df = spark.createDataFrame([(1, "SAFE", 1.0), (2, "RISK", 0.99), (3, "RISK", 0.995)], "id int, risk_label string, risk_confidence double")
    assert [r["risk_label"] for r in cleaning.map_to_classes(df).orderBy("id").collect()] == ["Low", "Medium", "High"]
    assert [r["risk_label"] for r in cleaning.map_to_classes(df, 0.85).orderBy("id").collect()] == ["Low", "High", "High"]
    with pytest.raises(ValueError, match="RISK|SAFE"):
        cleaning.encode_labels(df, strict=True)


def test_medium_query_on_both_vocabularies(spark):
    binary = spark.createDataFrame([(1, "SAFE"), (2, "RISK")], "id int, risk_label string")
    assert [r["id"] for r in cleaning.by_risk_level(binary, "Medium").collect()] == [2]
    three = spark.createDataFrame([(1, "Low"), (2, "Medium"), (3, "High")], "id int, risk_label string")
    assert [r["id"] for r in cleaning.by_risk_level(three, "medium").collect()] == [2]


def test_estimation_ratios_are_null_without_an_estimate(spark):
    df = spark.createDataFrame([(2.0, 4.0), (0.0, 4.0), (None, 4.0), (2.0, None)], "storypoints double, actual_points double")
    rows = cleaning.estimation_flags(df).collect()
    assert [r["was_underestimated"] for r in rows] == [True, None, None, None]
    assert [r["estimation_accuracy"] for r in rows] == [2.0, None, None, None]


def health_rows(spark, n, days=2):
    rows = [(i, f"Test story {i} with sufficient detail", 3.0, 3.0, days) for i in range(n)]
    return spark.createDataFrame(rows, "id int, description string, estimated_points double, actual_points double, days_to_complete int")


def test_health_volume_and_completeness(spark):
    assert one(health.health_scores(health_rows(spark, 120)))["volume_score"] == 100
    half = one(health.health_scores(health_rows(spark, 50)))
    assert half["volume_score"] == 50 and half["completeness_score"] == 100
    assert one(health.health_scores(health_rows(spark, 50, None)))["completeness_score"] == 0
    empty = one(health.health_report(health_rows(spark, 50).limit(0)))
    assert empty["overall_grade"] == "F" and empty["overall_score"] == 0
    assert len(empty["recommendations"]) == 4


def test_scope_facts(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2025, 12, 15), 20, 4, 2.0), (2, dt.date(2025, 11, 17), 0, 5, 2.0), (3, dt.date(2025, 11, 17), 1, 1, 0.0)],
        "id int, end_date date, current_points int, new_points int, velocity double",
    )
    first, second = scope.scope_impact(df).orderBy("id").collect()
    assert (first["days_added"], first["new_points"], first["new_end_date"]) == (2, 24, "2025-12-17")
    assert "(20.0% increase)" in first["impact_summary"]
    assert (second["days_added"], second["new_end_date"]) == (3, "2025-11-20")
    assert len(first["recommendations"]) == 1


def test_team_velocity(spark):
    df = spark.createDataFrame([("a", 5, dt.date(2025, 1, 1)), ("a", 5, dt.date(2025, 1, 4)), ("a", 10, dt.date(2025, 1, 10))], "team string, p int, d date")
    assert one(scope.team_velocity(df, "team", "p", "d"))["velocity"] == 2.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.dates(dt.date(1990, 1, 1), dt.date(2050, 1, 1)), st.integers(0, 300)), min_size=1, max_size=60))
def test_business_days_equal_the_calendar(spark, cases):
    def step(day, n):
        while n:
            day += dt.timedelta(days=1)
            n -= day.weekday() < 5
        return day

    df = spark.createDataFrame([(i, d, n) for i, (d, n) in enumerate(cases)], "i int, d date, n int")
    got = {r["i"]: r["e"] for r in df.select("i", scope.add_business_days(F.col("d"), F.col("n")).alias("e")).collect()}
    assert got == {i: step(d, n) for i, (d, n) in enumerate(cases)}


PROBS = "id int, y int, p0 double, p1 double, p2 double"


def test_cost_decisions(spark):
    df = spark.createDataFrame([(1, 0, 0.6, 0.25, 0.15)], PROBS)
    row = one(decisions.with_cost_decision(df))
    assert row["expected_costs"] == pytest.approx([8.0, 2.1, 2.3]) and row["y_pred"] == 1
    custom = [[0, 1, 100], [1, 0, 50], [2, 2, 0]]
    row = one(decisions.with_cost_decision(spark.createDataFrame([(1, 0, 0.6, 0.3, 0.1)], PROBS), custom))
    assert row["expected_costs"] == pytest.approx([10.3, 5.6, 1.8]) and row["y_pred"] == 2


def test_cost_matrix_orientation():
    assert decisions.oriented([[0, 1, 2], [1.5, 0, 1], [3, 1.5, 0]], "true_rows") == [[0, 1.5, 3], [1, 0, 1.5], [2, 1, 0]]
    with pytest.raises(ValueError):
        decisions.oriented([[0, 1]])


def test_renormalize_keeps_a_zero_row(spark):
    rows = decisions.renormalize(spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.5, 0.5, 1.0)], PROBS)).orderBy("id").collect()
    assert [rows[0][p] for p in ("p0", "p1", "p2")] == [0, 0, 0]
    assert [rows[1][p] for p in ("p0", "p1", "p2")] == [0.25, 0.25, 0.5]


def test_certainty_is_in_no_calibration_bin(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0), (2, 0, 0.75, 0.25, 0.0)], PROBS)
    assert one(evaluation.expected_calibration_error(df))["ece"] == pytest.approx(0.125)
    assert one(evaluation.expected_calibration_error(df, include_one=True))["ece"] == pytest.approx(0.625)


def test_absent_class_scores_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "y int, y_pred int")
    report = {r["class"]: r for r in evaluation.class_report(df).collect()}
    assert report[2]["precision"] == report[2]["recall"] == report[2]["f1"] == 0.0
    assert report[0]["recall"] == 0.5 and report[1]["precision"] == 0.0


def test_early_stopping_rule():
    assert [evaluation.early_stopping_rounds(n) for n in (10, 100, 3000)] == [None, 10, 50]


def test_requests_are_quarantined_with_reasons(spark):
    df = spark.createDataFrame(
        [(1, "good text", "0", "1", None), (2, " \t", "x", "0", "0"), (3, None, "-1", "1", "fast"), (4, " ab ", "1", "1", "1")],
        "id int, description string, current_points string, new_points string, velocity string",
    )
    got = {r["id"]: (r["accepted"], set(r["reasons"])) for r in validation.validate_requests(df).collect()}
    assert got[1] == (True, set())
    assert got[2] == (False, {"description_empty", "points_not_integer", "points_out_of_range", "velocity_not_positive"})
    assert got[3] == (False, {"description_missing", "points_out_of_range", "velocity_not_number"})
    assert got[4] == (False, {"description_short"})


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError, match="title"):
        validation.require_columns(df, ["id", "title"])


def hot(spark, n=3000):
    """A third of all rows in one group, and few distinct values."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 11).alias("v"), F.md5(F.col("id").cast("string")).alias("h"),
    )


def test_sliced_ranks_equal_a_window(spark):
    from pyspark.sql import Window

    df = hot(spark)
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).select("id", "want")
    got = global_rank(df, ["g"], [F.col("v"), F.col("id")])
    assert got.join(want, "id").filter("rank = want").count() == 3000
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("h", "id"))).select("id", "want")
    assert hashed_rank(df, ["g"], "h", "id", digits=1).join(want, "id").filter("rank = want").count() == 3000


def test_exact_median_equals_the_builtin(spark):
    df = hot(spark).filter("id < 2999")
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()} == want
    assert one(exact_median(df, [], "v"))["median"] == one(df.agg(F.median("v").alias("m")))["m"]


def test_splits_keep_shares_and_groups(spark):
    df = hot(spark)
    shares = {r["split"]: r["count"] for r in splits.stratified_split(df, "g").filter("g = 'hot'").groupBy("split").count().collect()}
    assert shares == {"train": 600, "val": 200, "test": 200}
    assert splits.group_split(df, "g").groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    sizes = sorted(r["count"] for r in splits.contiguous_folds(df.limit(13).withColumn("g", F.lit("x")), "g").groupBy("fold").count().collect())
    assert sizes == [2, 2, 3, 3, 3]


NOISE = "id int, given int, pb0 double, pb1 double"


def test_contradicted_labels_are_flagged(spark):
    rows = [(i, 0, 0.9, 0.1) for i in range(40)] + [(100 + i, 1, 0.1, 0.9) for i in range(40)] + [(200 + i, 0, 0.05, 0.95) for i in range(5)]
    flagged = noise.flag_issues(spark.createDataFrame(rows, NOISE))
    assert {r["id"] for r in flagged.filter("is_issue").collect()} == {200 + i for i in range(5)}
    report = {r["given"]: r for r in noise.prune_report(flagged).collect()}
    assert report[0]["n_removed"] == 5 and report[1]["n_removed"] == 0
    health_row = one(noise.label_health(spark.createDataFrame(rows, NOISE)))
    assert health_row["health"] == pytest.approx(80 / 85) and health_row["band"] == "excellent"


def test_clean_labels_flag_nothing(spark):
    rows = [(i, i % 2, 0.9 - 0.8 * (i % 2), 0.1 + 0.8 * (i % 2)) for i in range(20)]
    assert noise.flag_issues(spark.createDataFrame(rows, NOISE)).filter("is_issue").count() == 0
