"""Data health report: one aggregate over the stories, overall or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import (
    HEALTH_GENERIC, HEALTH_GRADES, HEALTH_IDEAL_WORDS, HEALTH_MESSAGES, HEALTH_MIN_STORIES, HEALTH_MIN_WORDS,
    HEALTH_SCALE,
)
from plumbline.functions.text import WORD_RUN, contains_any, word_count


def health_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Volume, completeness, quality and consistency, 0 to 100.

    Expects id, description, estimated_points, actual_points, days_to_complete.  Missing numbers make a
    story incomplete.  Distinct estimates come from partial aggregates; a missing estimate counts as one
    more distinct value.
    """
    est, act = F.col("estimated_points"), F.col("actual_points")
    text = F.coalesce("description", F.lit(""))
    row = df.select(
        *by,
        est,
        (F.col("description").rlike(WORD_RUN) & (est > 0) & (act > 0) & (F.col("days_to_complete") > 0)).alias("_full"),
        word_count(text).alias("_words"),
        contains_any(F.lower(text), HEALTH_GENERIC).alias("_generic"),
        F.when(est > 0, (act / est).between(0.5, 2.0)).alias("_fair"),
    )
    words = F.col("_words")
    length = F.when(words >= HEALTH_IDEAL_WORDS, 2).when(words >= HEALTH_MIN_WORDS, 1).otherwise(0)
    specific = F.when(~F.col("_generic") | (words > 5), 1).otherwise(0)
    grouped = row.groupBy(*by) if by else row.groupBy()
    n = F.col("story_count")
    agg = grouped.agg(
        F.count("*").alias("story_count"),
        F.count_if("_full").alias("_full"),
        F.sum(length + specific).alias("_quality"),
        F.count_if(est.isin([float(p) for p in HEALTH_SCALE])).alias("_scale"),
        (F.count_distinct(est) + F.when(F.count_if(est.isNull()) > 0, 1).otherwise(0)).alias("_distinct"),
        F.count_if(est > 0).alias("_rated"),
        F.count_if("_fair").alias("_fair"),
    )

    def per_story(c):
        return F.when(n > 0, c / n).otherwise(0.0)

    fair = F.when(F.col("_rated") > 0, F.col("_fair") / F.col("_rated")).otherwise(0.0)
    consistency = 0.3 * per_story(F.col("_scale")) + 0.3 * F.least(F.col("_distinct") / 5, F.lit(1.0)) + 0.4 * fair
    return agg.select(
        *by,
        "story_count",
        (F.least(n / HEALTH_MIN_STORIES, F.lit(1.0)) * 100).alias("volume_score"),
        (per_story(F.col("_full")) * 100).alias("completeness_score"),
        (per_story(F.col("_quality")) / 3 * 100).alias("quality_score"),
        F.when(n > 0, consistency * 100).otherwise(0.0).alias("consistency_score"),
    )


def health_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores, weighted overall score, grade and recommendations."""
    s = health_scores(df, by)
    v, c, q, k = (F.col(f"{name}_score") for name in ("volume", "completeness", "quality", "consistency"))
    scored = s.withColumn("overall_score", v * 0.30 + c * 0.25 + q * 0.25 + k * 0.20)
    grade = F.when(F.lit(False), "")
    for limit, letter in HEALTH_GRADES:
        grade = grade.when(F.col("overall_score") >= limit, letter)
    volume = F.concat(
        F.lit(HEALTH_MESSAGES["volume"].split("{n}")[0]), F.col("story_count").cast("string"),
        F.lit(HEALTH_MESSAGES["volume"].split("{n}")[1]),
    )
    advice = F.filter(
        F.array(
            F.when(v < 70, volume),
            F.when(c < 80, HEALTH_MESSAGES["completeness"]),
            F.when(q < 70, HEALTH_MESSAGES["quality"]),
            F.when(k < 70, HEALTH_MESSAGES["consistency"]),
        ),
        lambda x: x.isNotNull(),
    )
    return scored.select(
        *by,
        grade.otherwise("F").alias("overall_grade"),
        *[
            F.round(f"{name}_score", 1).alias(f"{name}_score")
            for name in ("overall", "volume", "completeness", "quality", "consistency")
        ],
        "story_count",
        F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(HEALTH_MESSAGES["fine"]))).alias("recommendations"),
    )
