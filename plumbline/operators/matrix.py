"""Feature matrix: scaling, embeddings, fusion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.arrays import l2_normalize
from plumbline.functions.hashing import hashed_words

EMBEDDING_SIZE = 64


def scaling_stats(train: DataFrame, columns: Sequence[str]) -> Column:
    """Mean and population deviation of every column as a struct-valued scalar subquery."""
    return train.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        )
    ).scalar()


def scaling_values(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of every column as plain numbers, one row, so that they can be saved with a model."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, s if (s := row[f"s_{c}"]) and s > 1e-12 else 1.0) for c in columns}


def scale_by(df: DataFrame, values: dict[str, tuple[float, float]]) -> DataFrame:
    """z-scores with given means and deviations."""
    scaled = [((F.col(c) - m) / s).alias(c) for c, (m, s) in values.items()]
    return df.select(*[c for c in df.columns if c not in values], *scaled)


def scale(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with the statistics of ``train``; a constant column is only centred."""
    fitted = df.withColumn("_z", scaling_stats(train, columns))
    scaled = [
        ((F.col(c) - F.col(f"_z.m_{c}")) / F.when(F.col(f"_z.s_{c}") > 1e-12, F.col(f"_z.s_{c}")).otherwise(1.0)).alias(c)
        for c in columns
    ]
    return fitted.select(*[c for c in df.columns if c not in columns], *scaled)


def hashed_embedding(df: DataFrame, text: str, size: int = EMBEDDING_SIZE) -> DataFrame:
    """Signed feature hashing of all words of a text, unit length."""
    hashed = df.withColumn("_raw", hashed_words(F.lower(F.coalesce(F.col(text), F.lit(""))), size))
    return hashed.withColumn("embedding", l2_normalize(F.col("_raw"))).drop("_raw")


def embed_texts(
    df: DataFrame, text: str, encoder: Callable[[], Callable] | None = None, size: int = EMBEDDING_SIZE, batch: int = 32
) -> DataFrame:
    """Add a unit-length ``embedding`` per text.

    ``encoder`` is a factory for a batch function (array of texts -> matrix), loaded once per Python
    worker; equal texts are encoded once.  Without one, words are hashed.
    """
    if encoder is None:
        return hashed_embedding(df, text, size)
    run = predict_batch_udf(encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return score_distinct(df, text, lambda d: d.withColumn("embedding", l2_normalize(run(F.col(text)))))


def score_distinct(df: DataFrame, text: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run an expensive per-text step once per distinct text and join the result back.

    Copies collapse in a partial aggregate.  The join back has one row per digest on one side; a digest
    shared by many rows is split by adaptive skew handling on the other.
    """
    keyed = df.withColumn("_digest", F.md5(F.coalesce(F.col(text), F.lit(""))))
    distinct = keyed.groupBy("_digest").agg(F.first(text).alias(text))
    scored = score(distinct).drop(text)
    return keyed.join(scored, "_digest", "left").drop("_digest")


def fuse(symbolic: DataFrame, embeddings: DataFrame, columns: Sequence[str], size: int = EMBEDDING_SIZE) -> DataFrame:
    """(id, features): scaled symbolic values followed by the embedding, ``size`` zeros for a row without one."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    vector = F.coalesce(F.transform("embedding", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), size))
    return symbolic.join(embeddings.select("id", "embedding"), "id", "left").select("id", F.concat(values, vector).alias("features"))


def fused_names(columns: Sequence[str], size: int = EMBEDDING_SIZE) -> list[str]:
    return [*columns, *[f"embedding_{i}" for i in range(size)]]
