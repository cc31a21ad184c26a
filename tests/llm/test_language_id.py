import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_id, queries
from tests.llm.conftest import DATA


def test_gradients():
    """Backpropagation through time against finite differences."""
    network = language_id.new_network(["a", "b", "c"], 1)
    for layer in (network.ahead, network.behind):
        layer.rows, layer.recurrent = layer.rows.astype(float), layer.recurrent.astype(float)
    network.output = network.output.astype(float)
    rng = np.random.default_rng(2)
    bytes_, target = rng.integers(97, 100, (5, 4)).astype(np.uint8), rng.integers(0, 3, 5)

    def loss():
        s = network.states(bytes_)[0].astype(float) @ network.output
        log = s - np.log(np.exp(s).sum(axis=2, keepdims=True))
        return -log[:, np.arange(5), target].mean()

    for w, g in zip(network.weights(), network.gradients(bytes_, target), strict=True):
        for _ in range(8):
            at = (int(rng.integers(97, 100)) if w.shape[0] == 256 else int(rng.integers(w.shape[0])), int(rng.integers(w.shape[1])))
            kept = w[at]
            w[at] = kept + 1e-3
            up = loss()
            w[at] = kept - 1e-3
            down = loss()
            w[at] = kept
            assert g[at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=2e-4)


def test_held_out_accuracy(spark):
    sf = DATA.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op6_language_id(spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_words_are_read_whole_and_alone():
    network = language_id.new_network(["a", "b"])
    words = [b"abc", b"x" * 100, "é".encode(), b"abc"]
    together = network.read(words)
    assert together.sum(axis=1) == pytest.approx([3, 100, 2, 3], rel=1e-4)
    assert np.allclose(together, np.concatenate([network.read([w]) for w in words]), atol=1e-4)


def test_edge_cases(spark, edge, empty):
    network = language_id.fit(edge, steps=5)
    named, (lang, score) = language_id.with_language(edge, network)
    assert (lang, score) == ("_language", "language_score") and named.count() == edge.count()
    found = {r["doc_id"]: (r[lang], r[score]) for r in named.collect() if (r["doc_id"] or 0) >= 900}
    assert [found[k] for k in (900, 901, 902, 903)] == [("und", 0.0)] * 4 and found[904][0] != "und"
    kept = language_id.keep_identified(edge, network, min_score=0.0)
    assert kept.columns == edge.columns and kept.where(F.col("doc_id").isin(900, 901, 902, 903)).count() == 0
    assert language_id.keep_identified(empty, network).count() == 0
    nothing = language_id.fit(empty)
    assert nothing.languages == []
    assert {tuple(r) for r in language_id.with_language(edge, nothing)[0].select(lang, score).collect()} == {("und", 0.0)}
