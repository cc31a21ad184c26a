"""The report over the stages reads the texts once and still names what a stage lacks."""

from plumbline.operators import labeling
from plumbline.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_four_stages_vote_once(spark, monkeypatch):
    voted, vote = [], labeling.apply_functions
    monkeypatch.setattr(labeling, "apply_functions", lambda *a, **k: voted.append(1) or vote(*a, **k))
    report = catalog.REGISTRY["verify_report"](spark, DATA)
    assert len(voted) == 1 and "documents.parquet" not in report._jdf.queryExecution().executedPlan().toString()
    found = {r["stage"]: r for r in report.collect()}
    assert {s: (r["missing_columns"], r["ok"]) for s, r in found.items()} == {
        "weak_labels": ("", True), "pruned": ("", True), "mapped": ("", True), "unmapped": ("risk_class", False),
    }
    assert found["unmapped"]["n_bad_label"] == found["weak_labels"]["n_rows"] == found["mapped"]["n_rows"] > 0
