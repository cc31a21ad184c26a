"""Stories of unusual kind: clusters of embeddings, and a vote for those that few stories share.

Precise language can still describe unusual work.  Most stories fall into large clusters of ordinary work; a story in a
cluster with a small share of all rows, or far from every centre, is a risk.  K-means passes over the rows with
one partial sum per cluster and task, so a vector that a third of all rows share costs no more than others.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import ABSTAIN, RISK, SEED
from plumbline.functions.arrays import dot, doubles, literal_array
from plumbline.operators.training import as_vector, fit_partitions, spread_by_id
from plumbline.session import without_summary

VOTE = "lf_cluster_outlier"
CLUSTERS = 12
SMALL_SHARE = 0.03
FAR = 3.0  # times the root of the mean squared distance


def _usable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("embedding").isNotNull()).select("id", doubles(F.col("embedding")).alias("embedding"))


def fit(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED, rounds: int = 20) -> KMeansModel:
    """Centres of (id, embedding).  Rows are dealt by id, so that the same table gives the same centres."""
    usable = as_vector(_usable(rows), "embedding")
    dealt = spread_by_id(usable, fit_partitions(rows.sparkSession, usable.count())).persist()
    model = KMeans(k=clusters, seed=seed, maxIter=rounds, featuresCol="embedding", predictionCol="cluster").fit(dealt)
    dealt.unpersist()
    return without_summary(model)


def assigned(rows: DataFrame, model: KMeansModel) -> DataFrame:
    """(id, cluster, distance): the nearest centre and the Euclidean distance to it."""
    found = model.setFeaturesCol("_v").setPredictionCol("cluster").transform(as_vector(_usable(rows).withColumn("_v", F.col("embedding")), "_v"))
    centres = F.array(*[literal_array([float(x) for x in c]) for c in model.clusterCenters()])
    gap = F.zip_with("embedding", F.element_at(centres, F.col("cluster") + 1), lambda a, b: a - b)
    return found.select("id", "cluster", F.sqrt(dot(gap, gap)).alias("distance"))


def outlier_votes(rows: DataFrame, model: KMeansModel, small_share: float = SMALL_SHARE, far: float = FAR) -> DataFrame:
    """(id, cluster, cluster_size, distance, lf_cluster_outlier) for every row of (id, embedding).

    A cluster is small with less than ``small_share`` of the rows that have an embedding; a row is far beyond ``far`` times
    the root mean square distance.  A row without embedding abstains, without cluster.  The sizes have one row per
    cluster and are broadcast.
    """
    placed = assigned(rows, model)
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("cluster_size"), F.sum(F.col("distance") ** 2).alias("_squares"))
    totals = sizes.agg(F.struct(F.sum("cluster_size").alias("n"), F.sum("_squares").alias("squares"))).scalar()
    known = F.broadcast(sizes.withColumn("_t", totals))
    limit = far * F.sqrt(F.col("_t.squares") / F.col("_t.n"))
    odd = (F.col("cluster_size") < small_share * F.col("_t.n")) | (F.col("distance") > limit)
    judged = placed.join(known, "cluster").select("id", "cluster", "cluster_size", "distance", F.when(odd, RISK).otherwise(ABSTAIN).cast("tinyint").alias(VOTE))
    without = rows.filter(F.col("embedding").isNull()).select("id", F.lit(ABSTAIN).cast("tinyint").alias(VOTE))
    return judged.unionByName(without, allowMissingColumns=True)


def with_outlier_vote(votes: DataFrame, outliers: DataFrame) -> DataFrame:
    """Votes by id with the vote of the clusters; a story without one abstains."""
    return votes.join(outliers.select("id", VOTE), "id", "left").withColumn(VOTE, F.coalesce(VOTE, F.lit(ABSTAIN)).cast("tinyint"))
