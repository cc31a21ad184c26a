"""Queries over stories answer for every complete story."""

import pytest

from plumbline.operators import cleaning
from plumbline.plans.catalog import REGISTRY
from plumbline.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["explanations", "tfidf_bigram", "fused_features", "cluster_outliers"])
def test_every_complete_story_has_rows(spark, name):
    wanted = {r["id"] for r in cleaning.preprocess(tables.stories(spark, DATA)).select("id").collect()}
    assert {r["id"] for r in REGISTRY[name](spark, DATA).select("id").collect()} == wanted
