"""Plans stay free of cross joins, and filters reach the scan."""

import re
from pathlib import Path

import pytest

from plumbline.operators import cleaning
from plumbline.plans.catalog import REGISTRY

DATA = "/root/testdata/sf0.001"
LAZY = [
    "assessment_fallback", "confusion_matrix", "explanations", "health_by_project", "label_issues", "lf_correlation",
    "lf_summary", "pruned", "roc_auc", "sample_weights", "similar_topk", "split_distribution", "stratified_split",
    "tfidf_vectors", "value_counts",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, name):
    plan = REGISTRY[name](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_confidence_filter_reaches_the_scan(spark, tmp_path):
    spark.sql("SELECT 1 AS id, 'RISK' AS risk_label, 0.9D AS risk_confidence, 'x' AS full_text").write.parquet(f"{tmp_path}/t")
    df = cleaning.confident(spark.read.parquet(f"{tmp_path}/t")).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(risk_confidence,0.75)" in plan and "full_text" not in re.findall(r"ReadSchema: .*", plan)[0]


def test_no_machine_local_shortcuts():
    sources = "".join(p.read_text() for p in (Path(__file__).parents[1] / "plumbline").rglob("*.py"))
    for banned in ("localCheckpoint", "crossJoin", "toPandas("):
        assert banned not in sources
