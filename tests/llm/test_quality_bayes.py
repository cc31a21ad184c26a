import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality_bayes, queries
from tests.llm.conftest import DATA


def test_held_out_documents(spark):
    sf = DATA.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op7_quality_bayes(spark, sf).where("held_out").join(truth, "doc_id").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.3
    assert ((rows.posterior >= 0.5) == rows.kept).all()


def sites(spark, rows):
    docs = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], "doc_id long, host string, path string")
    labels = spark.createDataFrame([(k, r[2]) for k, r in enumerate(rows)], "doc_id long, quality int")
    table, rate = quality_bayes.site_posteriors(docs, labels, "doc_id", "host", "path", "quality")
    return {(r["host"], r["path"]): (r["host_rate"], r["path_rate"]) for r in table.collect()}, rate


def strength(groups):
    """Method of moments on plain lists of (n, good, parent's rate)."""
    level = sum(p * (1 - p) * n for n, _, p in groups) / sum(n for n, _, _ in groups)
    spread = sum(n * (g / n - p) ** 2 for n, g, p in groups)
    between = (spread - len(groups) * level) / sum(n for n, _, _ in groups)
    return quality_bayes.STRONGEST if between <= 0 else min(quality_bayes.STRONGEST, max(quality_bayes.WEAKEST, level / between - 1))


def test_posteriors_equal_the_formulas(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{h}", f"p{p}", int(rng.random() < 0.15 + 0.1 * h + 0.05 * p)) for h in range(7) for p in range(3) for _ in range(4 + 9 * h)]
    rows += [(None, None, 1), (None, "p0", 0), ("h0", None, 1), ("h1", "p1", None)]
    found, rate = sites(spark, rows)
    known = [r for r in rows if r[2] is not None]
    assert rate == pytest.approx((sum(r[2] for r in known) + 0.5) / (len(known) + 1))
    hosts, paths = {}, {}
    for h, p, y in known:
        for table, key in ((hosts, h), (paths, (h, p))):
            n, g = table.get(key, (0, 0))
            table[key] = n + 1, g + y
    k = strength([(n, g, rate) for n, g in hosts.values()])
    host_rate = {h: (g + k * rate) / (n + k) for h, (n, g) in hosts.items()}
    k = strength([(n, g, host_rate[h]) for (h, _), (n, g) in paths.items()])
    assert found.keys() == paths.keys()
    for (h, p), (n, g) in paths.items():
        assert found[h, p] == pytest.approx((host_rate[h], (g + k * host_rate[h]) / (n + k)))


def test_sparse_sites_stay_near_the_global_rate(spark):
    rows = [(f"h{k}", "p", int(k % 10 > 0)) for k in range(100)] + [("big", "p", 0)] * 300 + [("fine", "p", 1)] * 300
    found, rate = sites(spark, rows)
    assert found["big", "p"][1] < 0.1 and found["fine", "p"][1] > 0.9
    assert all(abs(found[f"h{k}", "p"][1] - rate) < 0.4 for k in range(100))


def test_edge_cases(spark, edge, empty, labels):
    docs = edge.drop("host", "path").withColumns({"host": F.col("source"), "path": F.col("lang")})
    found = quality_bayes.score(docs, docs, labels)
    assert found.count() == edge.count() and found.where("posterior BETWEEN 0 AND 1").count() == edge.count()
    assert quality_bayes.score(docs.limit(0), docs, labels).count() == 0
    blank = quality_bayes.score(docs, docs.limit(0), labels).select("evidence", "posterior").distinct().collect()
    assert [tuple(r) for r in blank] == [(0.0, 0.5)]


def test_hosts_and_paths_of_urls(spark):
    rows = [("https://Blog.example.com:80/en/x?y#z", "blog.example.com", "en"), ("http://a.org", "a.org", ""), ("a b", "", ""), (None, None, None)]
    df = spark.createDataFrame(rows, "url string, host string, path string")
    found = df.select(quality_bayes.host_of(F.col("url")).alias("h"), quality_bayes.path_of(F.col("url")).alias("p"), "host", "path").collect()
    assert all((r["h"], r["p"]) == (r["host"], r["path"]) for r in found)
