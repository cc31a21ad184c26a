"""Splittable CSV, stored embeddings, votes of clusters, rows counted on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import ABSTAIN, RISK
from plumbline.operators import clusters
from plumbline.plans import flows
from plumbline.sources import files, tables, vectors

DATA = "/root/testdata/sf0.001"
AWKWARD = ["", " ", "\\N", "\\", "\\\\", "\\n", "\n", "\\\n", "\\\\n", "\r\n", "a\rb", 'say "x"\n\\"', "\\\\\\n\\", '"', ",", "\ttab ", "end\\", None, "ü\n é"]


def test_csv_round_trip_in_several_tasks(spark, tmp_path):
    rows = [(k, AWKWARD[k % len(AWKWARD)], f"line {k}\nline two of {k} " + "x" * 200) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, title string, description string")
    files.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        read = files.read_csv(spark, str(tmp_path / "c"), df.schema)
        assert read.select(F.spark_partition_id()).distinct().count() > 3
        assert sorted(map(str, read.collect())) == sorted(map(str, df.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_of_other_writers(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,title\n1,"two\nlines, ""quoted"""\n2,back\\n slash\n')
    read = files.read_csv(spark, str(tmp_path / "f.csv"), spark.createDataFrame([], "id long, title string").schema, line_breaks=True)
    assert [tuple(r) for r in read.orderBy("id").collect()] == [(1, 'two\nlines, "quoted"'), (2, "back\\n slash")]


def test_second_run_encodes_nothing(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def encoder():
        def run(texts):
            import uuid

            (calls / uuid.uuid4().hex).write_text("\n".join(str(t) for t in texts))
            return np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)

        return run

    def encoded():
        return sorted(line for f in calls.iterdir() for line in f.read_text().split("\n"))

    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "aa"), (4, None), (5, "")], "id long, t string")
    first = vectors.embedded(df, "t", path, "length", encoder)
    assert {r["id"]: r["embedding"] and round(r["embedding"][0], 4) for r in first.collect()} == {1: 0.8944, 2: 0.9487, 3: 0.8944, 4: None, 5: 0.0}
    seen = encoded()
    assert sorted(set(seen)) == ["", "aa", "bbb"]
    assert vectors.add_texts(df, "t", path, "length", encoder) == 0 and encoded() == seen
    more = df.unionByName(spark.createDataFrame([(6, "c")], df.schema))
    assert vectors.add_texts(more, "t", path, "length", encoder) == 1 and "c" in encoded()
    assert vectors.stored(spark, path, "length").count() == 4 and vectors.stored(spark, path, "other").count() == 0


def test_small_clusters_and_far_rows_are_risks(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(140, 3)) + 20, rng.normal(size=(5, 3)) + [0, 60, 0], [[20, 20, 29.5]]])
    points[:100] = points[0]  # a third of the rows share one vector
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)] + [(1000, None), (1001, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    model = clusters.fit(df, 3)
    found = {r["id"]: r for r in clusters.outlier_votes(df, model).collect()}
    assert len(found) == len(rows)
    assert {k for k, r in found.items() if r[clusters.VOTE] == RISK} == {290, 291, 292, 293, 294, 295}
    assert found[1000][clusters.VOTE] == ABSTAIN and found[1000]["cluster"] is None
    again = clusters.outlier_votes(df.repartition(5), clusters.fit(df.repartition(7), 3))
    assert {r["id"]: r[clusters.VOTE] for r in again.collect()} == {k: r[clusters.VOTE] for k, r in found.items()}
    votes = clusters.with_outlier_vote(spark.createDataFrame([(290, 1), (0, 0), (5000, 1)], "id long, lf_other int"), again)
    assert {r["id"]: r[clusters.VOTE] for r in votes.collect()} == {290: RISK, 0: ABSTAIN, 5000: ABSTAIN}


def test_saving_counts_rows_without_reading_a_stage_again(spark, tmp_path, monkeypatch):
    raw = tables.stories(spark, DATA)
    stages = flows.augment(raw, epochs=20)
    monkeypatch.setattr(flows, "funnel", lambda *_: pytest.fail("counted by extra jobs"))
    flows.save_augmented(stages, str(tmp_path), "run")
    found = {r["stage"]: r["value"] for r in spark.read.parquet(f"{tmp_path}/metrics").filter("metric = 'n'").collect()}
    names = ("raw", "cleaned", "labeled", "pruned", "high_confidence")
    assert found == {name: getattr(stages, name).count() for name in names} and found["raw"] == raw.count()
