import numpy as np
import pytest

from plumbline.llm import queries, toxicity
from tests.llm.conftest import DATA


def auc(label, score):
    order = np.argsort(score, kind="stable")
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    ones = label.sum()
    assert len(order) == len(label)
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_held_out_documents(spark):
    sf = DATA.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op1_toxicity(spark, sf).where("held_out").join(truth, "doc_id").toPandas()
    assert auc(rows.toxic.to_numpy(), rows.score.to_numpy()) > 0.85
    assert rows.predicted[rows.toxic == 0].mean() < 0.02 and rows.predicted[rows.toxic == 1].mean() > 0.5
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all()


def brute_evidence(model, own, shared, word):
    """The recursion, letter by letter, on dictionaries of counts."""
    text, out = "\x02" + word + "\x03", 0.0
    d, order = toxicity.DISCOUNT, toxicity.ORDER

    def stats(counts, h):
        found = [c for g, c in counts.items() if g[:-1] == h and g != "\x02" and c > 0]
        return sum(found), sum(min(c, d) for c in found)

    for i in range(1, len(text)):
        low, p = 1 / toxicity.ALPHABET, [1 / toxicity.ALPHABET] * 2
        for k in range(min(order - 1, i) + 1):
            h, x = text[i - k : i], text[i]
            for y in (0, 1):
                total, taken = stats(own[y], h)
                if total:
                    p[y] = (max(own[y].get(h + x, 0) - d, 0) + taken * low) / total
            total, taken = stats(shared, h)
            if total:
                low = (max(shared.get(h + x, 0) - d, 0) + taken * low) / total
        out += np.log(p[1]) - np.log(p[0])
    return out


def test_evidence_equals_the_recursion(spark):
    rows = [("you mean idiot idea", 1), ("an idiot and a moron", 1), ("a fine idea and a mean", 0), ("you and an idea", 0),
            ("mean mean mean", 0), ("moron idle", 1)] * 3
    rows = [(k, f"{t} w{'abcdefghijklmnopqr'[k]}", y) for k, (t, y) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    own = [{}, {}]
    for _, text, y in rows:
        for word in set(text.split()):
            s = "\x02" + word + "\x03"
            for i in range(len(s)):
                for k in range(min(toxicity.ORDER - 1, i) + 1):
                    g = s[i - k : i + 1]
                    own[y][g] = own[y].get(g, 0) + 1
    grams = set(own[0]) | set(own[1])
    longer = {g: sum(1 for x in grams if x[1:] == g) for g in grams}
    shared = {g: longer[g] or own[0].get(g, 0) + own[1].get(g, 0) for g in grams}
    words = ["idiot", "idea", "you", "moronic", "zzz", "wa"]
    assert model.evidence([w.encode() for w in words]) == pytest.approx([brute_evidence(model, own, shared, w) for w in words])


def test_probabilities_add_up():
    counts, lower = np.array([3.0, 1, 0, 0]), np.full(4, 0.25)
    taken = np.minimum(counts, toxicity.DISCOUNT).sum()
    assert toxicity.discounted(counts, np.full(4, 4.0), np.full(4, taken), lower).sum() == pytest.approx(1)


def test_edge_cases(spark, edge, empty, labels):
    model = toxicity.fit(edge, labels)
    scored, name = toxicity.with_score(edge, model)
    assert name == "_toxicity" and scored.count() == edge.count() and scored.where(f"{name} BETWEEN 0 AND 1").count() == edge.count()
    kept = toxicity.keep_ordinary(edge, model)
    assert kept.columns == edge.columns
    assert toxicity.keep_ordinary(empty, model).count() == 0
    one = spark.createDataFrame([(901, 1)], "doc_id long, toxic int")
    for docs, known, prior in ((empty, labels, 0.0), (edge, labels.limit(0), 0.0), (edge, one, 1.0)):
        only = toxicity.fit(docs, known)
        assert {r[0] for r in toxicity.with_score(edge, only)[0].select(name).collect()} == {prior}


def test_a_balanced_sample_keeps_the_share_of_toxic_rows():
    """One point in sixteen of the ordinary class: the curve is that of all points."""
    rng = np.random.default_rng(5)
    y = (np.arange(34_000) % 17 == 0).astype(float)
    x = np.c_[np.ones(len(y)), rng.normal(y * 1.5, 1)[:, None]]
    whole = toxicity._fit_curve(x, y)
    kept = (y == 1) | (rng.random(len(y)) < 1 / 16)
    sampled = toxicity._fit_curve(x[kept], y[kept], {0: int((y == 0).sum()), 1: int(y.sum())})
    assert sampled == pytest.approx(whole, abs=0.15)


def test_scores_mean_the_same_in_a_balanced_sample(spark):
    """All toxic rows against a seventh of the ordinary ones: scores still average to the share of toxic rows."""
    sf = DATA.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic").distinct()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").join(labels.select("doc_id"), "doc_id").cache()
    scored, name = toxicity.with_score(docs, toxicity.fit(docs, labels, per_class=500))
    rows = scored.select("doc_id", name).join(labels, "doc_id").toPandas()
    docs.unpersist()
    assert rows[name].mean() == pytest.approx((rows.toxic == 1).mean(), abs=0.03)
    assert (rows[name][rows.toxic == 0] >= toxicity.THRESHOLD).mean() < 0.015
