"""Document quality by hierarchical empirical Bayes.

A logistic classifier over text measures gives each document's evidence, a log likelihood ratio.  Labels counted by
site (host) and by path within the site give beta posteriors: the path is shrunk toward its host, the host toward the
global rate.  The strength of each shrinkage is estimated from the spread between the groups (method of moments), so a
sparse or unlabelled site says what the global rate says.  A document's posterior is the path's log odds plus its own
evidence.

Counts and spreads are grouped aggregates over all labelled rows.  The classifier is fitted on about ``per_class``
labelled documents of each class, chosen by the hash of the text.  Sites meet the documents in a join that is salted,
so a site with a third of all documents is dealt over ``SALTS`` parts.

Defined results: null and empty texts have the measures of an empty text; a null host or path is a host or path of its
own; labels that are null or refer to no document are ignored, several labels of one document count each; without
labels of both classes the evidence is 0; without any label every posterior is 0.5; repeated documents get equal
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.text_blocks import (
    ALNUM, NOT_SPACE, appended, labelled_sample, row_slices, split_words, stored, text_bytes, word_hashes,
)

PER_CLASS = 5000
SALTS = 16
WEAKEST, STRONGEST = 1.0, 1e6  # shrinkage in labelled documents
LIMIT = 6.0  # largest evidence in nats
KEEP = 0.5


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Measures of each text: sizes, kinds of characters, repetition."""
    words = split_words(data, offsets)
    n = np.diff(words.first)
    length = np.maximum(np.diff(offsets), 1)

    def share(table: np.ndarray) -> np.ndarray:
        filled = np.r_[0, np.cumsum(table[data])]
        return (filled[offsets[1:]] - filled[offsets[:-1]]) / length

    kinds = np.arange(256)
    upper = (kinds >= 65) & (kinds <= 90)
    digit = (kinds >= 48) & (kinds <= 57)
    mark = ~ALNUM & NOT_SPACE
    bar = np.isin(kinds, [ord(c) for c in "#*$%&|<>=_~^"])
    shout = kinds == ord("!")
    hashes = word_hashes(words)
    pairs = np.unique(np.stack([words.doc.astype(np.uint64), hashes], axis=1), axis=0)[:, 0].astype(np.int64)
    distinct = np.bincount(pairs, minlength=len(n))
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])] if len(words) else np.zeros(0, bool)
    repeated = np.bincount(words.doc, same, len(n))
    chars = np.bincount(words.doc, words.end - words.start, len(n))
    per_word = 1 / np.maximum(n, 1)
    x = [share(upper), share(digit), share(mark), share(bar), share(shout), distinct * per_word, repeated * per_word,
         chars * per_word / 10, np.log1p(n) / 5, (n < 20).astype(float), share(kinds == 10) * 10]
    x += [np.sqrt(v) for v in x[:5]]
    return np.stack([np.ones(len(n)), *x], axis=1)


@dataclass
class Classifier:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights, -LIMIT, LIMIT)


def _measured(text: str, names: list[str], extra: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, text):
                x = measures(*text_bytes(part, text))
                yield pa.record_batch({n: pa.array(c) for n, c in zip(names, x.T, strict=True)} | {extra: part.column(extra)})

    return run


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality",
        per_class: int = PER_CLASS) -> Classifier:
    """The classifier; its evidence is relative to equal classes."""
    width = measures(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    sample, sizes = labelled_sample(docs, labels, ident, text, label, per_class)
    if len(sizes) < 2:
        return Classifier(np.zeros(width), np.zeros(width), np.ones(width))
    names = [f"x{k}" for k in range(width)]
    schema = ", ".join(f"{n} double" for n in names) + ", y int"
    points = sample.mapInArrow(_measured("text", names, "y"), schema).toArrow()
    x = np.stack([points.column(n).to_numpy() for n in names], axis=1)
    y = points.column("y").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Classifier(np.zeros(width), np.zeros(width), np.ones(width))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], scale[0] = 0, 1
    x = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, ridge = np.zeros(width), np.diag([1e-6, *[1.0] * (width - 1)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(w, mean, scale)


def _strength(groups: DataFrame, parent_rate: Column) -> float:
    """Shrinkage in labelled documents, from the spread of the groups' rates around their parents' (moments)."""
    n, p = F.col("n"), parent_rate
    row = groups.agg(
        F.sum(n * F.pow(F.col("good") / n - p, 2)).alias("spread"),
        F.sum((1 - 1 / n) * p * (1 - p)).alias("chance"),
        F.sum(n).alias("all"),
        F.count("*").alias("groups"),
        F.sum(p * (1 - p) * n).alias("level"),
    ).first()
    if not row["all"] or row["groups"] < 2:
        return STRONGEST
    level = row["level"] / row["all"]
    # Expected spread: chance alone gives p(1-p) for each group, true differences add n times their variance.
    between = (row["spread"] - row["groups"] * level) / row["all"]
    if between <= 0 or level <= 0:
        return STRONGEST
    return float(min(STRONGEST, max(WEAKEST, level / between - 1)))


def site_posteriors(docs: DataFrame, labels: DataFrame, ident: str, host: str, path: str, label: str) -> tuple[DataFrame, float]:
    """(host, path, host_rate, path_rate) of the labelled sites, and the global rate.

    Paths without labels get their host's rate and hosts without labels the global rate when they are joined.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(ident).alias("label_id"), F.col(label).cast("long").alias("y"))
    rows = docs.select(F.col(ident).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"))
    rows = rows.join(known, F.col("id") == F.col("label_id"))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    paths = stored(paths, "site-counts")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (total["good"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    k = _strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + k * rate) / (F.col("n") + k)).alias("host_rate"))
    met = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k = _strength(met, F.col("host_rate"))
    path_rate = (F.col("good") + k * F.col("host_rate")) / (F.col("n") + k)
    return met.select("host", "path", "host_rate", path_rate.alias("path_rate")), rate


def score(docs: DataFrame, known: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text",
          host: str = "host", path: str = "path", label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """(id, evidence, host_rate, path_rate, posterior, kept) of every row of ``docs``.

    The model is learned from the rows of ``known`` (columns as ``docs``) and their ``labels``.
    """
    classifier = docs.sparkSession.sparkContext.broadcast(fit(known, labels, ident, text, label, per_class))
    slim = docs.select(F.col(ident).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                e = classifier.value.evidence(measures(*text_bytes(part, "text")))
                yield appended(part.drop_columns(["text"]), {"evidence": pa.array(e)})

    judged = slim.mapInArrow(run, T.StructType([*slim.drop("text").schema.fields, T.StructField("evidence", T.DoubleType())]))
    sites, rate = site_posteriors(known, labels, ident, host, path, label)
    salt = F.pmod(F.xxhash64("id", "evidence"), F.lit(SALTS))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    hosts = sites.groupBy("host").agg(F.first("host_rate").alias("host_rate"))
    hosts = hosts.select(F.col("host").alias("host1"), "host_rate", salts.alias("salt1"))
    paths = sites.select(F.col("host").alias("host2"), F.col("path").alias("path2"), "path_rate", salts.alias("salt2"))
    met = judged.withColumn("salt", salt)
    met = met.join(hosts, F.col("host").eqNullSafe(F.col("host1")) & (F.col("salt") == F.col("salt1")), "left")
    met = met.join(
        paths,
        F.col("host").eqNullSafe(F.col("host2")) & F.col("path").eqNullSafe(F.col("path2")) & (F.col("salt") == F.col("salt2")),
        "left",
    )
    host_rate = F.coalesce("host_rate", F.lit(rate))
    path_rate = F.coalesce("path_rate", host_rate)
    odds = F.log(path_rate / (1 - path_rate)) + F.col("evidence")
    posterior = 1 / (1 + F.exp(-odds))
    return met.select(
        "id", "evidence", host_rate.alias("host_rate"), path_rate.alias("path_rate"), posterior.alias("posterior"),
        (posterior >= KEEP).alias("kept"),
    )


def host_of(url: Column) -> Column:
    """Host of a URL, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    """First part of the path of a URL."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
