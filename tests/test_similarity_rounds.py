"""Searches in rounds: the same answers, few tiles on disk at a time; the recall is that of all stories."""

import os
import time

import numpy as np
import pytest

from plumbline import session
from plumbline.operators import similarity
from plumbline.plans import catalog, flows
from plumbline.sources import tables


def planted(spark, n=300):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 16))[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, 16))
    vectors[:90] = vectors[0]  # copies
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(5 * n)[:n], vectors)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3)


def answers(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "similarity").collect()))


@pytest.mark.parametrize("search", [similarity.top_k, lambda df, k, least: similarity.approximate(df, df, k, least, others_only=True, bucket_rows=16)])
def test_rounds_give_the_answers_of_one_round(spark, monkeypatch, search):
    df = planted(spark)
    monkeypatch.setattr(similarity, "SEARCH_BYTES", 128 * 50)
    monkeypatch.setattr(similarity, "BAND_BYTES", 128 * 50)
    once = answers(search(df, 4, 0.5))
    stored, cut_all = [], similarity.cut_all

    def counted(parts):
        listed = list(parts)
        stored.append(len(listed))
        return cut_all(listed)

    monkeypatch.setattr(similarity, "cut_all", counted)
    monkeypatch.setattr(similarity, "ROUND_BYTES", 300 * 128)
    assert answers(search(df, 4, 0.5)) == once
    assert len(stored) == 1 and stored[0] >= 6


def test_shuffle_files_go_with_the_query_that_wrote_them(spark):
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    def gone(before):
        for _ in range(50):
            if not files() - before:
                return True
            time.sleep(0.1)
        return False

    before = files()
    spark.range(20_000).repartition(4, "id").write.parquet(session.scratch_path(spark, "plain"))
    assert files() - before
    before = files()
    kept = session.cut(spark.range(20_000).repartition(4, "id"))
    assert gone(before) and kept.count() == 20_000
    before = files()
    both = session.cut_all(spark.range(i, i + 10).repartition(2, "id") for i in (0, 10))
    assert gone(before) and sorted(r["id"] for r in both.collect()) == list(range(20)) and both.columns == ["id"]
    assert spark.conf.get(session.SHUFFLE_CLEANUP, "false") == "false"


def test_recall_of_all_stories(spark):
    """Links between all stories, against brute force; every hundredth story alone has fewer."""
    data = "/root/testdata/sf0.001"
    rows = flows.embedded_corpus(tables.stories(spark, data)).collect()
    unit = np.array([r["embedding"] for r in rows])
    sims = unit @ unit.T
    np.fill_diagonal(sims, -1.0)
    best = -np.sort(-np.round(sims, 12), axis=1)[:, :5]
    found = catalog.REGISTRY["similar_recall"](spark, data).first()
    assert found["links"] == (best >= 0.9).sum() and found["found"] >= 0.9 * found["links"]
