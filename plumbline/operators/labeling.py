"""Labeling functions as column expressions, and the reports over their votes.

A labeling function is a boolean Column plus the vote it casts; everything else abstains.  The votes of a
story are eighteen tinyint columns of one projection, so applying them moves no data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import ABSTAIN, DEPENDENCY_TERMS, LF_NAMES, LF_TERMS, POINT_SCALE, RISK, SAFE
from plumbline.functions.arrays import pick
from plumbline.functions.measures import lexicon_hits
from plumbline.functions.text import contains_any


@dataclass(frozen=True)
class LabelingFunction:
    """``predicate`` builds a boolean Column over the cleaned frame; true casts ``vote``."""

    name: str
    predicate: Callable[[], Column]
    vote: int

    def column(self) -> Column:
        hit = F.coalesce(self.predicate(), F.lit(False))
        return F.when(hit, F.lit(self.vote)).otherwise(F.lit(ABSTAIN)).cast("tinyint").alias(self.name)


def labeling_function(vote: int, name: str | None = None):
    """Decorator for user-defined labeling functions: a zero-argument function returning a Column."""

    def wrap(fn: Callable[[], Column]) -> LabelingFunction:
        return LabelingFunction(name or fn.__name__, fn, vote)

    return wrap


# Lexicons that are looked for in the full text, all in one reading.
TEXT_LEXICONS = {n: terms for n, terms in LF_TERMS.items() if n != "lf_bug_fix"} | {"lf_dependency_link": DEPENDENCY_TERMS}


def _terms(name: str, vote: int) -> LabelingFunction:
    return LabelingFunction(name, lambda: F.col(f"_hits.{name}"), vote)


def default_functions() -> list[LabelingFunction]:
    points = F.col("story_points")
    rules: dict[str, tuple[Callable[[], Column], int]] = {
        "lf_high_complexity": (lambda: points >= 8, RISK),
        "lf_low_complexity_safe": (lambda: points <= 2, SAFE),
        "lf_fibonacci_anomaly": (lambda: ~points.isin([float(p) for p in POINT_SCALE]), RISK),
        "lf_missing_acceptance_criteria": (
            lambda: ~F.lower("description").contains("acceptance criteria") & (F.col("list_item_count") < 3),
            RISK,
        ),
        "lf_very_short_description": (lambda: F.col("word_count") < 15, RISK),
        "lf_very_long_description": (lambda: F.col("word_count") > 200, RISK),
        "lf_bug_fix": (lambda: contains_any(F.lower("title"), LF_TERMS["lf_bug_fix"]), SAFE),
    }
    out = []
    for name in LF_NAMES:
        if name in rules:
            out.append(LabelingFunction(name, *rules[name]))
        else:
            out.append(_terms(name, SAFE if name == "lf_documentation_story" else RISK))
    return out


def apply_functions(
    df: DataFrame, functions: Sequence[LabelingFunction] | None = None, keep: Sequence[str] = ("id",)
) -> DataFrame:
    """Votes -1/0/1, one column per function."""
    functions = functions or default_functions()
    lowered = df.withColumn("_text", F.lower("full_text"))
    return lowered.withColumn("_hits", lexicon_hits(F.col("_text"), TEXT_LEXICONS)).select(*keep, *[f.column() for f in functions])


def _votes_of(names: Sequence[str], vote: int) -> Column:
    return reduce(add, [(F.col(n) == vote).cast("int") for n in names])


def with_vote_counts(votes: DataFrame, names: Sequence[str] = LF_NAMES) -> DataFrame:
    return votes.withColumn("n_safe", _votes_of(names, SAFE)).withColumn("n_risk", _votes_of(names, RISK))


def vote_patterns(votes: DataFrame, names: Sequence[str] = LF_NAMES) -> DataFrame:
    """Distinct vote combinations with their row counts.

    Every report below depends on the votes only, so it reads this small table: the rows are reduced
    before the shuffle and a combination shared by a third of all rows is still one row.
    """
    return with_vote_counts(votes.groupBy(*names).agg(F.count("*").alias("n")), names)


def vote_distribution(patterns: DataFrame, names: Sequence[str] = LF_NAMES) -> DataFrame:
    m = len(names)
    totals = patterns.agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * F.col("n_safe")).alias("safe"),
        F.sum(F.col("n") * F.col("n_risk")).alias("risk"),
    ).withColumn("all", F.col("rows") * m)
    counts = {ABSTAIN: F.col("all") - F.col("safe") - F.col("risk"), SAFE: F.col("safe"), RISK: F.col("risk")}
    rows = [
        F.struct(F.lit(v).alias("vote"), c.alias("n"), (100.0 * c / F.col("all")).alias("pct"))
        for v, c in counts.items()
    ]
    return totals.select(F.inline(F.array(*rows)))


def lf_summary(patterns: DataFrame, names: Sequence[str] = LF_NAMES) -> DataFrame:
    """Coverage, overlap, conflict and polarity per labeling function, from one aggregate."""
    n = F.col("n")
    entries = []
    for j, name in enumerate(names):
        v = F.col(name)
        active = v != ABSTAIN
        entries.append(
            F.struct(
                F.lit(j).alias("j"),
                F.lit(name).alias("lf"),
                n.alias("n"),
                F.when(v == SAFE, n).otherwise(0).alias("safe"),
                F.when(v == RISK, n).otherwise(0).alias("risk"),
                F.when(active & (F.col("n_safe") + F.col("n_risk") >= 2), n).otherwise(0).alias("overlap"),
                F.when(
                    ((v == SAFE) & (F.col("n_risk") > 0)) | ((v == RISK) & (F.col("n_safe") > 0)), n
                ).otherwise(0).alias("conflict"),
            )
        )
    long = patterns.select(F.inline(F.array(*entries)))
    agg = long.groupBy("j", "lf").agg(*[F.sum(c).alias(c) for c in ("n", "safe", "risk", "overlap", "conflict")])
    polarity = F.concat_ws(
        ",", F.when(F.col("safe") > 0, F.lit(str(SAFE))), F.when(F.col("risk") > 0, F.lit(str(RISK)))
    )
    return agg.select(
        "j", "lf", polarity.alias("polarity"),
        ((F.col("safe") + F.col("risk")) / F.col("n")).alias("coverage"),
        (F.col("overlap") / F.col("n")).alias("overlaps"),
        (F.col("conflict") / F.col("n")).alias("conflicts"),
        (F.col("safe") + F.col("risk")).alias("n_votes"),
    )


def lf_overall(patterns: DataFrame) -> DataFrame:
    votes = F.col("n_safe") + F.col("n_risk")
    n = F.col("n")

    def rows_where(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))

    both = (F.col("n_safe") > 0) & (F.col("n_risk") > 0)
    return patterns.agg(
        F.sum("n").alias("n_rows"),
        (rows_where(votes > 0) / F.sum("n")).alias("coverage"),
        rows_where(votes == 0).alias("n_no_vote"),
        (F.sum(n * votes) / F.sum("n")).alias("mean_votes"),
        F.min(votes).alias("min_votes"),
        F.max(votes).alias("max_votes"),
        rows_where(both).alias("n_conflicting"),
        (100.0 * rows_where(both) / F.sum("n")).alias("pct_conflicting"),
    )


def lf_correlation(patterns: DataFrame, names: Sequence[str] = LF_NAMES) -> DataFrame:
    """Pearson correlation of every pair of functions; null where one of them is constant.

    First and second moments are sums of small integers over the pattern table.  The pair list has a
    fixed length (153 for eighteen functions).
    """
    m = len(names)
    votes = F.array(*[F.col(name).cast("long") for name in names])
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(m - 2)),
            lambda i: F.transform(
                F.sequence(i + 1, F.lit(m - 1)),
                lambda j: F.struct(
                    i.alias("a"), j.alias("b"), F.get("_v", i).alias("x"), F.get("_v", j).alias("y")
                ),
            ),
        )
    )
    long = patterns.select("n", votes.alias("_v")).select("n", F.inline_outer(pairs))
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    s = long.groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"),
        F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"), F.sum(n * x * y).alias("sxy"),
    )
    # Products of two row totals pass the range of a long on large tables.
    d = {c: F.col(c).cast("decimal(19,0)") for c in ("n", "sx", "sy", "sxx", "syy", "sxy")}
    vx = d["n"] * d["sxx"] - d["sx"] * d["sx"]
    vy = d["n"] * d["syy"] - d["sy"] * d["sy"]
    cov = d["n"] * d["sxy"] - d["sx"] * d["sy"]
    spread = F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double"))
    r = F.when((vx > 0) & (vy > 0), cov.cast("double") / spread)
    return s.select(pick(names, F.col("a")).alias("lf_a"), pick(names, F.col("b")).alias("lf_b"), r.alias("r"))
