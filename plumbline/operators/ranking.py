"""Ranks, running totals and exact medians that never sort a whole group in one task.

A window partitioned by a label or a project puts every row of a hot group into one task.  Here the rows
are range partitioned by the full order instead; each slice is scanned on its own and shifted by the
totals of the slices before it.  The per-slice totals are one row per slice and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut, shuffle_width


def by_group(rows: DataFrame, totals: DataFrame, group: Sequence[str], small: bool = False) -> DataFrame:
    """Join totals of groups to their rows; a null group is a group like any other.

    ``small`` is for tables with one row per class or stratum, whose number the caller knows to be bounded: they are
    broadcast, so no row moves to its class.
    """
    named = totals.withColumnsRenamed({g: f"_g_{g}" for g in group})
    matched = F.lit(True)
    for g in group:
        matched = matched & rows[g].eqNullSafe(named[f"_g_{g}"])
    return rows.join(F.broadcast(named) if small else named, matched).drop(*[f"_g_{g}" for g in group])


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, Column], slices: int | None = None
) -> DataFrame:
    """Add inclusive running sums per group in the given order.

    The order must be total within a group (end it with an id, or aggregate ties first); then no slice
    can be hot, because range partitioning cuts through a large group.
    """
    slices = slices or shuffle_width(df.sparkSession)
    named = df.select("*", *[c.alias(f"_v_{k}") for k, c in sums.items()])
    ranged = named.repartitionByRange(slices, *[F.col(g) for g in group], *order)
    # Stored once: slice numbers must be the same for the totals and for the rows.
    fixed = cut(ranged.withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy(*group, "_slice")
        .agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
        .select(*group, "_slice", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = fixed.select("*", *[F.sum(f"_v_{k}").over(inside).alias(f"_r_{k}") for k in sums])
    return by_group(scanned, offsets, [*group, "_slice"]).select(
        *df.columns, *[(F.col(f"_r_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums]
    )


def global_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``row_number`` within large groups."""
    return running_totals(df, group, order, {name: F.lit(1).cast("long")})


def hashed_rank(df: DataFrame, group: Sequence[str], digest: str, tie: str, name: str = "rank", digits: int = 3) -> DataFrame:
    """``row_number`` in the order of a hex digest column.

    The leading digits of a digest are uniform and follow its order, so they make even slices without
    sampling: 16**digits slices per group, each ranked on its own and shifted by the slices before it.
    """
    sliced = df.withColumn("_slice", F.substring(digest, 1, digits))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group, "_slice")
        .agg(F.count("*").alias("_c"))
        .select(*group, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(digest, tie)
    ranked = sliced.select("*", F.row_number().over(inside).cast("long").alias("_r"))
    return by_group(ranked, offsets, [*group, "_slice"]).select(*df.columns, (F.col("_r") + F.col("_o")).alias(name))


def exact_median(df: DataFrame, group: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group for a column with arbitrarily many distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    ranked = running_totals(counts, group, [F.col(value)], {"_upto": F.col("_c")})
    sizes = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    first = F.col("_upto") - F.col("_c")
    at = [(F.col(value), (first < p) & (F.col("_upto") >= p)) for p in (low, high)]
    joined = by_group(ranked, sizes, list(group)) if group else ranked.withColumn("_n", sizes.scalar())
    return joined.groupBy(*group).agg(
        ((F.max(F.when(at[0][1], at[0][0])) + F.max(F.when(at[1][1], at[1][0]))) / 2).alias(name)
    )
