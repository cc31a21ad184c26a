"""Impact of adding points to a sprint, for a table of sprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import SCOPE_MESSAGES


def days_needed(points: Column, velocity: Column) -> Column:
    """At least one day; null where the velocity is not positive or the points are missing (such rows belong in quarantine)."""
    return F.when((velocity > 0) & points.isNotNull(), F.greatest(F.lit(1), F.ceil(points / velocity))).cast("int")


def add_business_days(start: Column, days: Column) -> Column:
    """Closed form of stepping over weekends.

    A weekend start counts from the Friday before it; every five working days then cost a weekend.
    Adding no days leaves even a weekend start where it is.
    """
    weekday = F.weekday(start)
    friday = F.date_sub(start, F.greatest(weekday - 4, F.lit(0)))
    from_day = F.least(weekday, F.lit(4))
    shifted = F.date_add(friday, (days + 2 * F.floor((from_day + days) / 5)).cast("int"))
    return F.when(days > 0, shifted).otherwise(start)


def scope_quarantine(df: DataFrame) -> DataFrame:
    """The rows that ``scope_impact`` cannot answer, unchanged, with the reason."""
    reason = F.when(F.col("velocity").isNull(), "velocity is missing").when(
        F.col("velocity") <= 0, "velocity is not positive"
    ).when(F.col("new_points").isNull(), "points are missing")
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def scope_impact(df: DataFrame) -> DataFrame:
    """Answers for rows with a positive velocity; see ``scope_quarantine`` for the others.

    (id, end_date, current_points, new_points, velocity) -> dates, totals, summary, recommendations."""
    cur, new, days = F.col("current_points"), F.col("new_points"), F.col("days_added")
    pct = F.when(cur > 0, new / cur * 100).otherwise(0.0)
    based = df.withColumn("days_added", days_needed(new, F.col("velocity"))).filter(days.isNotNull())
    summary = F.format_string(
        "Adding %d story points to the current %d points (%.1f%% increase) will require approximately "
        "%d additional business day%s at your team's velocity of %.1f points/day.",
        new, cur, F.bround(pct, 1), days, F.when(days != 1, "s").otherwise(""), F.col("velocity"),
    )
    scope = F.format_string(SCOPE_MESSAGES["scope"].replace("%", "%%").replace("{pct}%%", "%.0f%%"), F.bround(pct, 0))
    advice = F.array(
        F.when(days > 5, SCOPE_MESSAGES["major"]).when(days > 2, SCOPE_MESSAGES["delay"]),
        F.when((cur > 0) & (pct > 30), scope),
        F.when(new >= 8, SCOPE_MESSAGES["large"]),
        F.lit(SCOPE_MESSAGES["document"]),
    )
    return based.select(
        "id",
        F.date_format("end_date", "yyyy-MM-dd").alias("original_end_date"),
        F.date_format(add_business_days(F.col("end_date"), days), "yyyy-MM-dd").alias("new_end_date"),
        "days_added",
        cur.alias("original_points"),
        (cur + new).alias("new_points"),
        new.alias("points_added"),
        pct.alias("pct_increase"),
        summary.alias("impact_summary"),
        F.filter(advice, lambda x: x.isNotNull()).alias("recommendations"),
    )


def team_velocity(df: DataFrame, team: str, points: str, day: str) -> DataFrame:
    """Points per elapsed day and team; teams without elapsed days get no velocity."""
    days = F.datediff(F.max(day), F.min(day)) + 1
    return df.groupBy(team).agg(F.sum(points).cast("double").alias("points"), days.cast("long").alias("days")).select(
        team, "points", "days", F.when(F.col("days") > 0, F.col("points") / F.col("days")).alias("velocity")
    )
