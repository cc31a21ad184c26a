"""A stored table of embeddings, keyed by the digest of the text, that grows by the texts it has not seen.

Each encoder has its own folder, so vectors of different encoders never meet.  A second run over the same texts
encodes nothing.  Two runs at the same time may store a text twice; readers take one of the equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.matrix import embed_texts

SCHEMA = "digest string, embedding array<double>"


def _folder(path: str, encoder_name: str) -> str:
    return f"{path.rstrip('/')}/encoder={encoder_name}"


def stored(spark: SparkSession, path: str, encoder_name: str = "hashed") -> DataFrame:
    """(digest, embedding) of all stored texts; no rows where nothing was stored yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(_folder(path, encoder_name)).dropDuplicates(["digest"])
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def add_texts(df: DataFrame, text: str, path: str, encoder_name: str = "hashed", encoder: Callable[[], Callable] | None = None) -> int:
    """Encode and store the texts of ``df`` that are not stored yet; returns their number.  A null text has no vector.

    Equal texts collapse in a partial aggregate, known ones fall to the anti-join before the encoder runs, and the
    number is observed while the rows are written.
    """
    keyed = df.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("digest"), F.col(text).alias("text"))
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    new = distinct.join(stored(df.sparkSession, path, encoder_name).select("digest"), "digest", "left_anti")
    counted = Observation()
    vectors = embed_texts(new, "text", encoder).select("digest", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    vectors.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(_folder(path, encoder_name))
    return counted.get["n"]


def embedded(df: DataFrame, text: str, path: str, encoder_name: str = "hashed", encoder: Callable[[], Callable] | None = None) -> DataFrame:
    """``df`` plus ``embedding``, from the stored table after the texts it lacks were added.

    The table has one row per digest; a text that many rows share is split by adaptive skew handling.
    """
    add_texts(df, text, path, encoder_name, encoder)
    keyed = df.withColumn("_digest", F.sha2(text, 256))
    vectors = stored(df.sparkSession, path, encoder_name).withColumnRenamed("digest", "_digest")
    return keyed.join(vectors, "_digest", "left").drop("_digest")
