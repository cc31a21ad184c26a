import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality_rules as qr
from plumbline.llm import queries
from tests.llm.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_counts_equal_brute_force(spark, edge):
    docs = edge.select("doc_id", "text", "lang").union(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang"))
    docs = docs.union(spark.createDataFrame([(5000, "a b c a b c a\na b c\n \na b c", "x"), (5001, "a a a a", "x"), (5002, "a|b", "x")], docs.schema))
    for r in qr.measured(docs.withColumn("copy", F.col("text"))).collect():
        m = r["m"]
        got = (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"])
        assert got == brute(r["copy"])
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])


@pytest.mark.parametrize("n", [1, 10, 300, 5000, 200_000])
def test_binomial_tail_is_exact(spark, n):
    p = Fraction(1, 100)
    ks = sorted({0, 1, n // 200, n // 120, n})
    df = spark.createDataFrame([(k, n) for k in ks], "k long, n long")
    for r in df.select("k", qr.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        k = r["k"]
        if k >= n * p:
            assert r["p"] == 1.0
        elif n <= 5000:
            whole = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            assert r["p"] == pytest.approx(float(whole), rel=1e-8)
        else:
            assert 0 <= r["p"] < 0.01


def test_false_rejections_are_limited(spark):
    """Bad documents go, and on fresh good documents the proven cutoffs keep their promise."""
    good = "id AS doc_id, concat_ws(' ', transform(sequence(1, 80), i -> concat('w', i, '_', id, if((i + id) % 40 = 0, '#', '')))) AS text, 'en' AS lang"
    bad = good.replace("% 40 = 0", "% 2 = 0").replace("id AS doc_id", "100000 + id AS doc_id")
    docs = spark.range(4000).selectExpr(*split(good)).union(spark.range(200).selectExpr(*split(bad)))
    docs = docs.union(docs.where("doc_id % 10 = 0").withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6))
    labels = docs.where("doc_id < 3000 OR doc_id >= 1000000").selectExpr("doc_id", "1 AS quality")
    found = qr.judge(docs, labels).withColumn("good", F.col("id") % 1_000_000 < 100_000)
    counts = {(r["good"], r["stratum"]): (r["n"], r["k"]) for r in found.groupBy("good", "stratum").agg(
        F.count("*").alias("n"), F.sum((~F.col("kept")).cast("int")).alias("k")).collect()}
    assert counts[False, "en"][1] == counts[False, "en"][0] == 200
    assert counts[True, "en"][1] <= qr.RISK * counts[True, "en"][0]
    assert counts[True, None] == (400, 0) and counts[False, None][1] == 0  # too few labels to prove anything


def test_copies_are_no_evidence(spark):
    """Copies of a text share a half and count once, so one odd text with many copies cannot move a cutoff."""
    text = "concat_ws(' ', transform(sequence(1, 80), i -> concat('w', i, '_', id, if(i <= id % 5, '#', ''))))"
    docs = spark.range(800).selectExpr("id", f"{text} AS text", "'en' AS lang")
    odd = docs.where("id = 7").selectExpr("explode(sequence(10000, 10800)) AS id", "concat(text, ' ####') AS text", "lang")
    repeated = docs.selectExpr("id + 5000 AS id", "text", "lang")

    def limits(df, texts):
        found = qr.stored(qr.measured(df.withColumn("digest", F.md5("text"))), "test-counts")
        good = qr.stored(qr.good_documents(found, df.selectExpr("id AS doc_id", "1 AS quality"), "id", "lang"), "test-good")
        assert good.count() == texts
        return {(r["rate"], r["cutoff"]): (r["k"], r["n"]) for r in qr.cutoffs(good).collect()}

    alone, crowded = limits(docs, 800), limits(docs.union(odd).union(repeated), 801)
    # The odd text is one more text in one of the halves.
    shared = alone.keys() & crowded.keys()
    assert shared and all(crowded[x][1] - alone[x][1] in (0, 1) and crowded[x][0] - alone[x][0] in (0, 1) for x in shared)


def split(columns):
    return [c for c in re.split(r", (?=concat_ws|'en')", columns)]


def test_edge_cases(edge, empty, labels):
    found = qr.judge(edge, labels)
    assert found.count() == edge.count() and found.where("kept IS NULL").count() == 0
    assert qr.judge(empty, labels).count() == 0
    assert qr.judge(edge, labels.limit(0)).where("kept = base_failed").count() == 0


def test_main_path_is_native(spark):
    plan = queries.op9_quality_rules(spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
