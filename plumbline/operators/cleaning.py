"""Cleaning, derived columns and label mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import CLASS_LABELS, CLASS_THRESHOLD, HIGH_CONFIDENCE, NUMBERED_PATTERN
from plumbline.functions.measures import word_counts
from plumbline.functions.text import bullet_count, matches, word_count
from plumbline.sources.tables import seeded_order

STORY_SCHEMA = (
    "id bigint, description string, estimated_points int, actual_points int, days_to_complete int, "
    "caused_spillover boolean, risk_level string, epic string, reporter string"
)


def points_column(df: DataFrame) -> str:
    """The estimate is called ``storypoints`` or, in older data, ``weight``."""
    for name in ("storypoints", "weight", "story_points"):
        if name in df.columns:
            return name
    raise ValueError(f"no story point column among {df.columns}")


def full_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))


def preprocess(df: DataFrame) -> DataFrame:
    """Keep complete stories and add the text columns."""
    points = points_column(df)
    valid = df.filter(F.col(points).isNotNull() & F.col("description").isNotNull() & F.col("title").isNotNull())
    bullets = bullet_count(F.col("description"))
    return (
        valid.withColumnRenamed(points, "story_points")
        .withColumn("full_text", full_text())
        .withColumn("word_count", word_counts(F.col("description")))
        .withColumn("title_word_count", word_count(F.col("title")))
        .withColumn("char_count", F.char_length("description"))
        .withColumn("list_item_count", bullets)
        .withColumn("has_list", F.col("list_item_count") > 0)
        .withColumn("has_code_block", F.col("description").contains("```"))
    )


def dropna_funnel(df: DataFrame) -> DataFrame:
    """Rows lost at each not-null filter, in filter order, from one pass."""
    points = F.col(points_column(df))
    no_points = points.isNull()
    no_description = points.isNotNull() & F.col("description").isNull()
    no_title = points.isNotNull() & F.col("description").isNotNull() & F.col("title").isNull()
    counts = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(c).alias(f"r{i}") for i, c in enumerate((no_points, no_description, no_title))],
    )
    left = [F.col("n"), F.col("n") - F.col("r0")]
    left += [left[1] - F.col("r1")]
    left += [left[2] - F.col("r2")]
    removed = [F.lit(0).cast("long"), F.col("r0"), F.col("r1"), F.col("r2")]
    steps = ["raw", "story_points", "description", "title"]
    rows = [
        F.struct(F.lit(i).alias("step"), F.lit(s).alias("filter"), left[i].alias("remaining"), removed[i].alias("removed"))
        for i, s in enumerate(steps)
    ]
    return counts.select(F.inline(F.array(*rows)))


def confident(df: DataFrame, threshold: float = HIGH_CONFIDENCE) -> DataFrame:
    return df.filter(F.col("risk_confidence") > threshold)


def map_to_classes(df: DataFrame, threshold: float = CLASS_THRESHOLD) -> DataFrame:
    """SAFE -> Low; RISK -> High above the confidence threshold, else Medium."""
    risky = (F.col("risk_label") == "RISK") & (F.col("risk_confidence") > threshold)
    label = F.when(F.col("risk_label") == "SAFE", "Low").when(risky, "High").otherwise("Medium")
    return df.withColumn("risk_label", label)


def map_without_medium(df: DataFrame) -> DataFrame:
    """SAFE -> Low, RISK -> High, anything else is dropped."""
    mapping = F.create_map(*[F.lit(x) for x in ("SAFE", "Low", "RISK", "High")])
    return df.withColumn("risk_label", mapping[F.col("risk_label")]).dropna(subset=["risk_label"])


def encode_labels(df: DataFrame, strict: bool = False) -> DataFrame:
    """Low/Medium/High -> 0/1/2.  ``strict`` raises with the first labels that have no class."""
    mapping = F.create_map(*[F.lit(x) for i, name in enumerate(CLASS_LABELS) for x in (name, i)])
    out = df.withColumn("risk_class", mapping[F.col("risk_label")])
    if strict:
        unmapped = out.filter(F.col("risk_class").isNull()).select("risk_label").distinct().limit(10).collect()
        if unmapped:
            raise ValueError(f"labels without a class: {[r[0] for r in unmapped]}")
    return out


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """An exact, reproducible sample: the n smallest seeded hashes (a distributed top-n, no full sort)."""
    return df.orderBy(seeded_order(seed), "id").limit(n)


def by_risk_level(df: DataFrame, level: str, limit: int | None = None) -> DataFrame:
    """Low/safe selects SAFE, everything else RISK; on three-class labels the level selects itself."""
    wanted = level.lower()
    binary = "SAFE" if wanted in ("low", "safe") else "RISK"
    out = df.filter((F.col("risk_label") == binary) | (F.lower("risk_label") == wanted))
    return out.orderBy("id").limit(limit) if limit else out


def to_story(df: DataFrame) -> DataFrame:
    """Labeled rows -> story records; without history the actual points equal the estimate."""
    label = F.col("risk_label") if "risk_label" in df.columns else F.lit(None).cast("string")
    points = F.col("story_points").cast("int")
    return df.select(
        F.col("id").cast("long"),
        F.coalesce("description", F.lit("")).alias("description"),
        points.alias("estimated_points"),
        points.alias("actual_points"),
        F.lit(None).cast("int").alias("days_to_complete"),
        F.lit(None).cast("boolean").alias("caused_spillover"),
        F.coalesce(label, F.lit("Unknown")).alias("risk_level"),
        F.lit(None).cast("string").alias("epic"),
        F.lit(None).cast("string").alias("reporter"),
    )


def story_to_json(df: DataFrame) -> DataFrame:
    record = F.struct(*[c.split()[0] for c in STORY_SCHEMA.split(", ")])
    return df.select("id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def story_from_json(df: DataFrame) -> DataFrame:
    return df.select(F.from_json("json", STORY_SCHEMA).alias("s")).select("s.*")


def estimation_flags(df: DataFrame, estimate: str = "storypoints", actual: str = "actual_points") -> DataFrame:
    """Underestimation flag and accuracy ratio; null where either number is missing or the estimate is 0."""
    est, act = F.col(estimate), F.col(actual)
    usable = est.isNotNull() & act.isNotNull() & (est != 0)
    return df.withColumn("was_underestimated", F.when(usable, act > est * 1.5)).withColumn(
        "estimation_accuracy", F.when(usable, act / est)
    )


def numbered_items(df: DataFrame) -> DataFrame:
    """Bullets plus numbered list markers."""
    return df.withColumn("list_items", F.coalesce(matches(F.col("description"), NUMBERED_PATTERN), F.lit(0)))
