"""Spelling variants: words at one edit from each other, found among sorted permuterm rotations.

A word w of m code points, closed by a terminator, has m + 1 rotations.  Turning w so that the code point at place i comes
last gives the key ``w[i+1:] + terminator + w[:i]`` followed by ``w[i]``: words that differ from w in that place alone have a
rotation with the same key, and the word without that place has the key itself as a whole rotation.  In sorted order
both form one range.  So a range holds at most one entry per code point of the alphabet and one whole entry, whatever the
input, and each member's near words in it are counted and the best chosen by one scan, without pairing the members.
Places inside a run of equal code points give the same shorter word; only the first of a run counts for it.  Rotations of
words over ``LONG_WORD`` code points are compared by hashes, so a word costs its length and not the square of it.

Words are maximal runs of the given letters, with A-Z in lower case.  ``slip_every`` plants known misspellings: a word whose
hash with its document is divisible by it loses one code point before it is counted.

The form of a word is its near word with the largest count, if that is at least ``ratio`` times its own; counts grow
along forms, so forms have no cycles and the last of them, the root, is reached in a number of doublings that the largest
count bounds.

Defined results: a null or empty text has no words; a missing id is the empty text; repeated rows count again; words with
equal counts choose by code-point order; a word or text of any length is read whole; extra columns are not looked at; an
empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text_blocks import Rolling, mixed, row_slices, stored

LETTERS = "A-Za-zÀ-ÿ"
TERMINATOR = "$"  # no letter
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
HELD_WORDS = 100_000  # distinct words that a task holds before it passes their counts on
LONG_WORD = 64  # code points beyond which rotations are hashed
ENTRIES = 50_000  # hashed rotations passed on at once


def slip(prefix: int, word: str, every: int) -> str:
    """The word without the code point at h % length if ``every`` divides h, the crc32 of ``<id>:<word>``."""
    h = zlib.crc32(word.encode(), prefix)
    at = h % len(word)
    return word[:at] + word[at + 1 :] if h % every == 0 else word


def word_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", letters: str = LETTERS,
                min_length: int = MIN_LENGTH, slip_every: int | None = None) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points with their occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = re.compile(f"[{letters}]{{{min_length},}}").findall, Counter()

        def passed_on() -> pa.RecordBatch:
            rows = pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return rows

        for batch in batches:
            for rows in row_slices(batch, text):
                for ident, t in zip(rows.column("id").to_pylist(), rows.column(text).cast(pa.binary()).to_pylist(), strict=True):
                    if not t:
                        continue
                    found = Counter(runs(t.lower().decode()))  # bytes: lower case for A-Z only
                    if slip_every:
                        prefix = zlib.crc32(f"{ident or ''}:".encode())
                        for w, c in found.items():
                            if len(changed := slip(prefix, w, slip_every)) >= min_length:
                                held[changed] += c
                    else:
                        held.update(found)
                    if len(held) > HELD_WORDS:
                        yield passed_on()
        yield passed_on()

    docs = docs.select(F.col(ident).cast("string").alias("id"), F.col(text).alias(text))
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, first, word, n): the ranges that each word belongs to, with the code point that the key leaves out.

    ``skipped`` is null for whole rotations; ``first`` marks a place that does not repeat the code point before it.
    """
    w, m, j = F.col("word"), F.char_length("word"), F.col("j")
    whole, i = j <= m, F.when(j <= m, j).otherwise(j - m)
    skipped, one = F.substring(w, i, F.lit(1)), F.lit(1)
    return words.select("word", "n", F.explode(F.sequence(F.lit(0), 2 * m)).alias("j")).select(
        F.concat(F.substring(w, i + 1, m), F.lit(TERMINATOR), F.substring(w, one, F.when(whole, i).otherwise(i - 1))).alias("key"),
        F.when(~whole, skipped).alias("skipped"),
        (~whole & ((i == 1) | (skipped != F.substring(w, i - 1, one)))).alias("first"),
        "word", "n",
    )


def hashed_rotations(words: DataFrame, long_word: int) -> DataFrame:
    """The same entries for words over ``long_word`` code points, and the whole ones for words of just that length.

    Written out, the rotations of a word take the square of its length.  Here both sides of the terminator are 64-bit
    hashes with their lengths, and the word is named by its sha256.  Two different rotations share a key with a
    chance of about 2**-128.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, ident, n in zip(*(batch.column(c).to_pylist() for c in ("word", "ident", "n")), strict=True):
                points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                m, rolling = len(points), Rolling(mixed(points.astype(np.uint64)))
                place, skips = np.arange(m + 1), np.zeros(m + 1, bool)
                if m > long_word:
                    place, skips = np.append(place, np.arange(m)), np.append(skips, np.ones(m, bool))
                for a in range(0, len(place), ENTRIES):
                    p, s = place[a : a + ENTRIES], skips[a : a + ENTRIES]
                    sides = (rolling.of(p + s, np.full(len(p), m)), m - p - s, rolling.of(np.zeros(len(p), np.int64), p), p)
                    here = points[np.minimum(p, m - 1)]
                    yield pa.record_batch({
                        "key": pc.binary_join_element_wise(*(pa.array(x).cast(pa.string()) for x in sides), ":"),
                        "skipped": pa.array([chr(c) if k else None for c, k in zip(here.tolist(), s.tolist(), strict=True)], pa.string()),
                        "first": pa.array(s & ((p == 0) | (here != points[p - 1]))),
                        "word": pa.array([ident] * len(p), pa.string()),
                        "n": pa.array(np.full(len(p), n, np.int64)),
                    })

    chosen = words.where(F.char_length("word") >= long_word).select("word", F.sha2("word", 256).alias("ident"), "n")
    return chosen.mapInArrow(run, "key string, skipped string, first boolean, word string, n long")


def scanned(entries: DataFrame) -> DataFrame:
    """(word, near, near_n, links): for each entry the number of its near words in its range and the best of them.

    An entry that skips a place has the other skipping entries as near words (one replaced code point), and the whole
    entry if its place is the first of its run (one code point less); a whole entry has those first places (one more).
    """
    in_order = Window.partitionBy("key").orderBy(F.col("skipped").isNull(), F.desc("n"), "skipped")
    span = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct("word", "n")
    ranged = entries.select(
        "*",
        F.count("*").over(span).alias("members"),
        F.count("skipped").over(span).alias("skipping"),
        F.first(entry).over(span).alias("top"),
        F.nth_value(entry, 2).over(span).alias("second"),
        F.max(F.when(F.col("skipped").isNull(), entry)).over(span).alias("shorter"),
        F.count(F.when(F.col("first"), 1)).over(span).alias("longer"),
        F.first(F.when(F.col("first"), entry), ignorenulls=True).over(span).alias("longest"),
    ).where("members > 1")
    skips = F.col("skipped").isNotNull()

    def found(when: Column, near: Column, links: Column) -> Column:
        return F.when(when, F.struct(near["word"].alias("near"), near["n"].alias("near_n"), links.cast("long").alias("links")))

    return ranged.select("word", F.explode(F.array_compact(F.array(
        found(skips & (F.col("skipping") > 1), F.when(F.col("word") == F.col("top.word"), F.col("second")).otherwise(F.col("top")), F.col("skipping") - 1),
        found(skips & F.col("first"), F.col("shorter"), F.lit(1)),
        found(~skips, F.col("longest"), F.col("longer")),
    ))).alias("x")).select("word", "x.*").where("near IS NOT NULL")


def near_words(words: DataFrame, long_word: int = LONG_WORD) -> DataFrame:
    """(word, near, near_n, links) of a table (word, n): ``links`` near words, of which ``near`` comes first."""
    long = words.where(F.char_length("word") >= long_word)
    named = long.select(F.sha2("word", 256).alias("ident"), F.col("word").alias("spelt"))
    found = scanned(hashed_rotations(words, long_word))
    for c in ("word", "near"):
        found = found.join(named, found[c] == named["ident"]).drop(c, "ident").withColumnRenamed("spelt", c)
    short = scanned(rotations(words.where(F.char_length("word") <= long_word)))
    return short.unionByName(found)


def with_forms(words: DataFrame, ratio: int = RATIO, long_word: int = LONG_WORD) -> DataFrame:
    """(word, n, n_near, form, form_n) of a table (word, n) of distinct words."""
    nothing = F.lit(None).cast("struct<m:bigint,near:string>").alias("best")
    near = near_words(words, long_word).select(
        "word", F.lit(None).cast("long").alias("n"), "links", F.struct((-F.col("near_n")).alias("m"), "near").alias("best")
    )
    every = words.select("word", "n", F.lit(0).cast("long").alias("links"), nothing).unionByName(near)
    best = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("links").alias("n_near"), F.min("best").alias("best"))
    form = -F.col("best.m") >= ratio * F.col("n")
    return best.select("word", "n", "n_near", F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n"))


def with_roots(formed: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``formed`` plus the last word that its forms lead to; the word itself if it has no form.

    Each join doubles the steps taken.  A step multiplies the count by ``ratio`` at least, which bounds the steps.
    """
    formed = stored(formed, "spelling-forms")
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    least, most = formed.agg(F.min("n"), F.max("n")).first()
    steps, taken = int(log2(most / least) / log2(ratio)) if most else 0, 1
    while taken < steps:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        taken *= 2
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT, ratio: int = RATIO,
             **options) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words with at least ``min_count`` occurrences in ``docs``."""
    words = stored(word_counts(docs, ident, text, **options).where(F.col("n") >= min_count), "spelling-words")
    return with_roots(with_forms(words, ratio), ratio)
