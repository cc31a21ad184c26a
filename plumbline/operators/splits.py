"""Reproducible splits, folds and sample weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import SEED
from plumbline.operators.ranking import by_group, global_rank, hashed_rank
from plumbline.session import cut
from plumbline.sources.tables import seeded_order


# Strata whose sizes are broadcast: about 3 MB.  Beyond it they meet the rows in an ordinary join.
BROADCAST_STRATA = 100_000


def _ranked(df: DataFrame, stratum: str, seed: int) -> DataFrame:
    """Rank and size within the stratum.  The strata are counted first; few ones are broadcast, so no row moves to its
    stratum and a hot one stays where its rows are."""
    keyed = df.select("id", F.col(stratum).alias("_stratum"), seeded_order(seed).alias("_digest"))
    ranked = hashed_rank(keyed, ["_stratum"], "_digest", "id", "_rank")
    sizes = cut(keyed.groupBy("_stratum").agg(F.count("*").alias("_size")))
    return by_group(ranked, sizes, ["_stratum"], small=sizes.count() <= BROADCAST_STRATA)


def stratified_split(df: DataFrame, stratum: str, seed: int = SEED) -> DataFrame:
    """60/20/20 per stratum: (id, stratum, split), in the order of a seeded hash.

    Stratifying by project keeps every project in every split; it does not separate projects.  Use
    ``group_split`` where stories of one project must not be on both sides.
    """
    share = F.col("_rank") / F.col("_size")
    split = F.when(share <= 0.6, "train").when(share <= 0.8, "val").otherwise("test")
    return _ranked(df, stratum, seed).select("id", F.col("_stratum").alias(stratum), split.alias("split"))


def label_split(df: DataFrame, label: str, seed: int = SEED, test_share: float = 0.2) -> DataFrame:
    """80/20 per label: (id, label, split)."""
    held_out = F.col("_rank") <= F.round(F.col("_size") * test_share)
    return _ranked(df, label, seed).select(
        "id", F.col("_stratum").alias(label), F.when(held_out, "test").otherwise("train").alias("split")
    )


def label_splits(df: DataFrame, runs: Sequence[str], label: str, seed: str, test_share: float = 0.2) -> DataFrame:
    """``df`` plus ``split``: the 80/20 split of ``label_split`` for every run in one pass.

    A run is told apart by the columns ``runs``; ``seed`` is the column with its seed.  The sizes have one row per run
    and label and are broadcast.
    """
    keyed = df.withColumn("_digest", F.md5(F.concat(F.col(seed).cast("string"), F.lit("-"), F.col("id").cast("string"))))
    strata = [*runs, label]
    ranked = hashed_rank(keyed, strata, "_digest", "id", "_rank")
    sizes = keyed.groupBy(*strata).agg(F.count("*").alias("_size"))
    held_out = F.col("_rank") <= F.round(F.col("_size") * test_share)
    return by_group(ranked, sizes, strata, small=True).select(*df.columns, F.when(held_out, "test").otherwise("train").alias("split"))


def group_split(df: DataFrame, group: str, seed: int = SEED) -> DataFrame:
    """60/20/20 over whole groups: every row of a group lands in the same split.  No shuffle."""
    share = F.conv(F.substring(seeded_order(seed, group), 1, 8), 16, 10).cast("double") / 2**32
    split = F.when(share < 0.6, "train").when(share < 0.8, "val").otherwise("test")
    return df.select("id", group, split.alias("split"))


def contiguous_folds(df: DataFrame, label: str, k: int = 5) -> DataFrame:
    """k contiguous folds per label in id order, the larger folds first: (id, label, fold)."""
    keyed = df.select("id", label)
    ranked = global_rank(keyed, [label], [F.col("id")], "_rank")
    sizes = keyed.groupBy(label).agg(F.count("*").alias("_size"))
    rank, size = F.col("_rank") - 1, F.col("_size")
    small = F.floor(size / k)
    large = size % k  # so many folds hold one row more
    in_large = rank < large * (small + 1)
    fold = F.when(in_large, F.floor(rank / (small + 1))).otherwise(
        large + F.floor((rank - large * (small + 1)) / F.greatest(small, F.lit(1)))
    )
    return by_group(ranked, sizes, [label], small=True).select("id", label, fold.cast("int").alias("fold"))


def split_distribution(split: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Share of each class within each split."""
    counts = split.select("id", "split").join(labels.select("id", label), "id").groupBy("split", label).agg(
        F.count("*").alias("n")
    )
    totals = counts.groupBy("split").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "split").select("split", label, "n", (100.0 * F.col("n") / F.col("_total")).alias("pct"))


def sample_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_class).  The class table has one row per class and is broadcast.
    A missing label is a class of its own."""
    classes = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = classes.agg(F.struct(F.sum("_n").alias("n"), F.count("*").alias("k"))).scalar()
    weights = classes.withColumn("_t", totals).select(
        label, (F.col("_t.n") / (F.col("_t.k") * F.col("_n"))).alias("weight")
    )
    return by_group(df, weights, [label], small=True)
