"""Measures of many texts at once against the patterns and Spark's ``HashingTF``."""

import random

import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline import config
from plumbline.functions import hashing, measures, text
from plumbline.operators import features, labeling, matrix, tfidf

PIECES = [*" \t\n\r\x0b\x1c\x85  　.!?,;-_'éßaeizbcxyZ9½文ёİΣσ𝐀😀", "\r\n", ". ", "...", ".\u0085", "is ", "was ", "be\t", "been ",
          "built", "quickly ", "red", "painted", "user-friendly", "user-", "friendly", "might", "efficient", "understood", "beautiful", "the"]


def random_texts(n=3000):
    rng = random.Random(7)
    return [None, "", "  \n", *["".join(rng.choice(PIECES) for _ in range(rng.choice([2, 6, 40]))) for _ in range(n)]]


def frame(spark):
    return spark.createDataFrame(list(enumerate(random_texts())), "id int, s string").repartition(4)


def test_measures_are_what_the_patterns_count(spark):
    low = F.lower(F.coalesce("s", F.lit("")))
    tokens = F.regexp_extract_all(low, F.lit(f"({text.WORD_CHAR}+)"))
    expected = {
        "words": text.word_count(low), "letter_runs": text.matches(low, text.LETTERS),
        "syllables": text.matches(low, text.VOWEL_GROUP) + text.matches(low, text.NO_VOWEL_WORD),
        "hard": text.matches(low, text.COMPLEX_WORD), "tokens": F.size(tokens),
        "function_words": F.size(F.filter(tokens, lambda w: w.isin(config.FUNCTION_WORDS))),
        "modals": text.matches(low, text.whole_word(config.WEAK_MODALS)),
        "vague": low.rlike(text.whole_word(config.VAGUE_TERMS)), "sentences": F.size(text.sentences(low)),
        "passive": F.size(F.filter(text.sentences(low), lambda s: s.rlike(text.PASSIVE))),
    }
    rows = frame(spark).withColumn("m", measures.text_measures(low)).withColumn("n", measures.word_counts(F.col("s")))
    got = [(F.col(f"m.{k}") > 0) if k == "vague" else F.col(f"m.{k}") for k in expected] + [F.col("n")]
    differ = rows.select("s", *[(~g.eqNullSafe(e)).alias(k) for g, (k, e) in zip(got, {**expected, "n": text.word_count(F.col("s"))}.items())])
    assert {k: differ.filter(k).count() for k in differ.columns[1:]} == dict.fromkeys([*expected, "n"], 0)


def test_hashed_words_are_those_of_hashing_tf(spark):
    even = lambda t: F.crc32(t.cast("binary")) % 2 == 0
    df = frame(spark).withColumn("s", F.concat("s", F.repeat(F.col("s"), 30)))
    rows = df.withColumn("terms", tfidf.tokens(F.coalesce("s", F.lit(""))))
    rows = rows.withColumn("a", F.filter("terms", even)).withColumn("b", F.filter("terms", lambda t: ~even(t)))
    for side in "ab":
        rows = HashingTF(numFeatures=64, inputCol=side, outputCol=f"{side}v").transform(rows)
    expected = F.zip_with(vector_to_array("av"), vector_to_array("bv"), lambda x, y: x - y)
    assert rows.filter(~expected.eqNullSafe(hashing.hashed_words(F.lower("s"), 64))).count() == 0


def test_batches_of_nothing_but_empty_texts_and_of_many_slices():
    empty = measures._by_text(measures.measure, pa.array([None, "", ""]), len(measures.MEASURES))
    assert [column.to_pylist() for column in empty] == [[0, 0, 0]] * len(measures.MEASURES)
    long = pa.array(["the cat is painted. " * 30_000, "", "a b"] * 3)
    counted = dict(zip(measures.MEASURES, measures._by_text(measures.measure, long, len(measures.MEASURES))))
    assert counted["words"].to_pylist() == [120_000, 0, 2] * 3
    assert counted["passive"].to_pylist() == [30_000, 0, 0] * 3


def test_a_text_is_not_searched_once_per_pattern(spark):
    df = frame(spark).withColumnRenamed("s", "full_text")
    plan = matrix.embed_texts(features.symbolic_features(df), "full_text")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(lower" not in plan and "HashingTF" not in plan


def test_lexicons_are_searched_together(spark):
    rng = random.Random(11)
    terms = [*sum(config.LF_TERMS.values(), []), *config.SATD_TERMS, *config.SECURITY_TERMS, "blocked by #3", "dependenc", "Blocking", "É"]
    rows = [("x", "".join(rng.choice([*terms, " ", "a"]) for _ in range(rng.randint(0, 6)))) for _ in range(1500)] + [("x", None)]
    df = spark.createDataFrame(rows, "title string, full_text string").withColumns(
        {"description": F.col("full_text"), "story_points": F.lit(3.0), "word_count": F.lit(3), "list_item_count": F.lit(3)}
    ).withColumn("low", F.lower("full_text"))
    votes = labeling.apply_functions(df, keep=["low"])
    for name, wanted in labeling.TEXT_LEXICONS.items():
        expected = F.col("low").rlike(config.DEPENDENCY_PATTERN) if name == "lf_dependency_link" else text.contains_any(F.col("low"), wanted)
        assert votes.filter((F.col(name) >= 0) != F.coalesce(expected, F.lit(False))).count() == 0, name
    counted = df.withColumn("n", measures.lexicon_counts(F.col("low"), {"satd": config.SATD_TERMS, "security": config.SECURITY_TERMS}))
    for name, wanted in (("satd", config.SATD_TERMS), ("security", config.SECURITY_TERMS)):
        expected = F.coalesce(text.total_occurrences(F.col("low"), wanted), F.lit(0.0))
        assert counted.filter(F.col(f"n.{name}") != expected).count() == 0
    assert "Contains(_text" not in votes._jdf.queryExecution().optimizedPlan().toString()
