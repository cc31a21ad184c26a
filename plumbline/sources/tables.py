"""Adapters from the given tables to the frames the operators work on.

Every column is a pure function of a whole input table, so the work grows with the data.  The corpus
contains almost no backlog vocabulary, so a short backlog phrase is appended to every (whole) text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import LF_NAMES, SEED
from plumbline.functions.arrays import pick

# Fixed values of the test adapter.
TITLES = [
    "Fix login bug", "Add report page", "Broken export", "Update docs page", "New billing flow",
    "Search screen", "Hotfix error page",
]
PHRASES = [
    "Make the dashboard fast and user-friendly for new users.",
    "Export to csv, pdf, etc and so on.",
    "Show several charts and multiple filters.",
    "Handle errors and support retries.",
    "Ideally the page loads instantly.",
    "Acceptance criteria: - one\n- two\n- three",
    "This is blocked by #42 and depends on billing.",
    "Add OAuth login via third-party webhook.",
    "Refactor legacy module and reduce technical debt. TODO remove hack.",
    "Run a security audit for the encryption layer.",
    "Improve performance and remove the latency bottleneck.",
    "Update the README and write a tutorial.",
    "It might work but could be slow and should be checked.",
    "Is this role allowed to edit? Which permission applies?",
    "See ```select 1``` and ```select 2``` for the query.",
    "The report was generated by the system and is reviewed by the team.",
    "1. open page 2. click save 3. close page",
    "Migration of the database to a new api wrapper.",
    "* alpha\n* beta\n• gamma",
    "Change the label colour.",
    "",
    "Plain wording with no signal.",
    "Store the token secret in the credential vault.",
    "A few temporary workarounds are hardcoded...",
]
POINTS = [1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 0.5, 21.0]
ACTUAL_FACTOR = [1.0, 1.0, 2.0, 0.5]
VELOCITIES = [0.5, 1.0, 2.0, 2.5]
MIN_TEXT = 20
# Assumed accuracy of each labeling function while no label model has been fitted.
LF_ACCURACY = [round(0.6 + 0.02 * (j % 10), 2) for j in range(len(LF_NAMES))]
# Fixed linear model for explanations: one row per class over FACTOR_FEATURES.
FACTOR_FEATURES = ["word_count", "weak_modal_density", "satd_count", "security_count", "list_item_count"]
FACTOR_WEIGHTS = [[-0.01, -0.5, -0.4, -0.3, 0.1], [0.0, 0.1, 0.1, 0.1, 0.0], [0.01, 0.4, 0.3, 0.2, -0.1]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    Text work is heavy per byte.  A table that reads as a handful of splits is at most a handful of blocks,
    so the extra exchange is small; a table with enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories_from(documents(spark, sf_dir))


def stories_from(docs: DataFrame) -> DataFrame:
    """documents -> stories, for batches and streams alike.

    Missing values follow the content: texts shorter than 20 characters give no description, texts
    with a license line no title, texts with a percent sign no estimate.
    """
    i = F.col("doc_id")
    points = pick(POINTS, (i + F.floor(i / 24)) % 8)
    return docs.select(
        i.alias("id"),
        F.substring("source", 4, 9).cast("long").alias("idproject"),
        i.alias("issuekey"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id AS int))").alias("created"),
        F.when(~F.lower("text").contains("license"), pick(TITLES, i % 7)).alias("title"),
        F.when(
            F.char_length("text") >= MIN_TEXT, F.concat("text", F.lit(" "), pick(PHRASES, i % 24))
        ).alias("description"),
        F.when(~F.col("text").contains("%"), points).alias("storypoints"),
        (1 + i % 9).alias("_days"),
        pick(ACTUAL_FACTOR, i % 4).alias("_factor"),
    ).select(
        "id", "idproject", "issuekey", "created", "title", "description", "storypoints",
        (F.col("storypoints") * F.col("_factor")).alias("actual_points"),
        F.when(F.col("title").isNotNull(), F.col("_days")).alias("days_to_complete"),
        (F.col("_factor") > 1.5).alias("caused_spillover"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels -> deterministic three-class and noisy binary model output."""
    i = F.col("id")
    base = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("y"),
    )

    def boost(cls: int) -> Column:
        return F.when((F.col("y") == cls) & (i % 5 != 0), 12).otherwise(0)

    w = base.select(
        "id",
        "y",
        (1 + (i * 7) % 11 + boost(0)).cast("double").alias("w0"),
        (1 + (i * 9) % 11 + boost(1)).cast("double").alias("w1"),
        (1 + (i * 11 + F.floor(i / 11) * 3) % 11 + boost(2)).cast("double").alias("w2"),
    )
    total = F.col("w0") + F.col("w1") + F.col("w2")
    truth = (F.col("y") > 0).cast("int")
    return w.select(
        "id",
        "y",
        *[(F.col(f"w{k}") / total).alias(f"p{k}") for k in range(3)],
        F.when(i % 9 == 0, 1 - truth).otherwise(truth).alias("given"),
        (F.col("w0") / total).alias("pb0"),
        ((F.col("w1") + F.col("w2")) / total).alias("pb1"),
    )


def sprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> scope change requests."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("end_date"),
        (F.col("o_custkey") % 40).cast("int").alias("current_points"),
        (1 + F.col("o_orderkey") % 13).cast("int").alias("new_points"),
        pick(VELOCITIES, F.col("o_orderkey") % 4).alias("velocity"),
        F.col("o_orderpriority").alias("team"),
    )


def story_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> raw scoring requests, untouched texts with text-typed numbers as they arrive."""
    docs = documents(spark, sf_dir)
    i = F.col("doc_id")
    return docs.select(
        i.alias("id"),
        F.when(F.col("lang") != "es", F.col("text")).alias("description"),
        F.when(F.col("lang") == "fr", F.lit("many")).otherwise((i % 40 - 1).cast("string")).alias("current_points"),
        (i % 13).cast("string").alias("new_points"),
        F.when(F.col("lang") != "de", pick([0.0, 0.5, 1.0, 2.0], i % 4).cast("string")).alias("velocity"),
    )


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (stage, step, metric, value): the event type is the stage, the day is the step."""
    daily = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("stage"), F.dayofyear("ts").alias("step"))
        .agg(F.count("*").cast("double").alias("count"), F.avg("value").alias("mean_value"))
    )
    return daily.unpivot(["stage", "step"], ["count", "mean_value"], "metric", "value")


def loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> learning curves: one run per event type, day = round, even users train, odd users validate."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("run"),
            F.dayofyear("ts").alias("round"),
            F.when(F.col("user_id") % 2 == 0, "train").otherwise("val").alias("split"),
        )
        .agg(F.avg("value").alias("loss"))
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def seeded_order(seed: int = SEED, id_col: str = "id") -> Column:
    """A pseudo-random but reproducible sort key."""
    return F.md5(F.concat(F.lit(f"{seed}"), F.lit("-"), F.col(id_col).cast("string")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
