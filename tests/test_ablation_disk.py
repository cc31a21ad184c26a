"""Vocabularies of many runs without a count of every rare term; regressions a few at a time."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import tfidf


@pytest.mark.parametrize("first, counted", [(8, 8), (2, 248)])
def test_rare_terms_are_not_counted_and_vocabularies_stay(spark, monkeypatch, first, counted):
    rows = [(i, " ".join(f"common{j}" for j in range(i % 9)) + f" rare{i} odd{i}", 1 + i % 3) for i in range(120)]
    df = tfidf.with_terms(spark.createDataFrame([*rows, (500, "", 3), (501, "unused words", 0)], "id int, full_text string, train long"))
    monkeypatch.setattr(tfidf, "FIRST_BUCKETS", first)
    few, every = tfidf.frequent_counts(df, 2, size=5), tfidf.run_counts(df, 2)
    sizes = [df.filter(F.col("train").bitwiseAND(1 << r) != 0).count() for r in range(2)]
    assert [(m.terms, m.idf) for m in tfidf.fit_runs(few, sizes, 5)] == [(m.terms, m.idf) for m in tfidf.fit_runs(every, sizes, 5)]
    assert (few.count(), every.count()) == (counted, 248)
    assert few.exceptAll(every).count() == 0


def test_all_terms_are_counted_where_ties_reach_the_rarest(spark, monkeypatch):
    df = tfidf.with_terms(spark.createDataFrame([(i, f"word{i}", 1) for i in range(40)], "id int, full_text string, train long"))
    monkeypatch.setattr(tfidf, "FIRST_BUCKETS", 2)
    assert tfidf.frequent_counts(df, 1, size=1000).count() == 40


def test_words_stored_and_pairs_built_later_are_the_terms(spark):
    df = spark.createDataFrame([(1, "one"), (2, "aa bb cc"), (3, "")], "id int, full_text string")
    later = tfidf.with_pairs(session.cut(tfidf.with_terms(df)))
    assert sorted(later.collect()) == sorted(tfidf.with_terms(df, bigrams=True).collect())


def test_fits_side_by_side_are_bounded(spark):
    running, most, lock = [], [], threading.Lock()

    def work(i):
        with lock:
            running.append(i)
            most.append(len(running))
        time.sleep(0.05)
        with lock:
            running.remove(i)
        return i

    assert session.side_by_side(work, range(7), at_once=2) == list(range(7)) and max(most) == 2
