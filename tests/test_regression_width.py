"""Partitions of the regressions: what the driver receives in an iteration grows with them."""

import numpy as np
from pyspark.ml.linalg import Vectors

from plumbline.operators import noise, training


def test_many_rows_are_dealt_to_few_partitions(spark):
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        sizes = [0, 1, 2048, 2049, 47_884, 480_000, 2_900_000, 10**9]
        assert [training.regression_partitions(spark, n) for n in sizes] == [1, 1, 1, 2, 8, 30, 178, 500]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_partitions_do_not_move_the_probabilities(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    rows = [(i, int(v[0] + 0.3 * rng.normal() > 0), Vectors.dense(v), i % 4) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, ["id", "y", "features", "fold"])
    found = [
        {r["id"]: r["pb1"] for r in noise.out_of_fold(df.drop("fold"), df.select("id", "fold"), "y", 4, partitions=p).collect()}
        for p in (None, 24)
    ]
    assert len(found[0]) == 400
    assert max(abs(found[0][i] - found[1][i]) for i in found[0]) < 1e-6
