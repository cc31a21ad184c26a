"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of the letters of a word given up to ``ORDER - 1`` letters before them.  Counts are documents
with the word, so a long document has no more say than a short one.  A class backs off from the longest context that it
has seen to one shared Kneser-Ney distribution (continuation counts of both classes together): a rare expression is
judged by the letters it shares with others, and where a class knows nothing both models agree.

A word's evidence is the difference of its two log-likelihoods.  A document's log-likelihood ratios are compared per
word (normalised by the number of words), as mean of the evidence beyond ``EXCESS`` nats and as plain mean, next to the
strongest word; a logistic curve fitted on documents that were left out of the counts (four folds) turns that into a
score.

The model is fitted on a bounded sample of labelled rows: about ``per_class`` documents of each class, chosen by the
hash of the text.  Its size is bounded by that sample, and it is broadcast.  The curve weights the points by the inverse
share of their class in the sample, so a score means the same whatever the number of labelled rows.

Defined results: null and empty texts are scored like a text without evidence; labels that are null or refer to no
document are not used; several labels of one document count each; without labels of both classes every score is the
share of toxic labels (0 without labels); repeated documents get equal scores; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.text_blocks import (
    ALNUM, Memo, Rolling, Words, appended, fresh, labelled_sample, mixed, row_slices,
    split_words, text_bytes, with_fields, word_hashes,
)

PER_CLASS = 6000
ORDER = 5
PART_LETTERS = 1 << 16  # letters judged at once
COUNT_BYTES = 1 << 17  # text counted at once: a letter takes some 400 bytes while its stretches are counted
DISCOUNT = 2.0
EXCESS = 3.0
FOLDS = 4
ALPHABET = 200.0
NO_CONTEXT = -1
THRESHOLD = 0.7


@dataclass
class Grams:
    """Letter stretches of words: codes of all stretches that end at each letter, by length, 0 where there is none."""

    codes: list[np.ndarray]
    word: np.ndarray


def grams(words: list[bytes]) -> Grams:
    joined = b"".join(b"\x02" + w + b"\x03" for w in words).decode("utf-8", "replace")
    letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    rolling = Rolling(mixed(letters.astype(np.uint64) + np.uint64(977)))
    head = np.flatnonzero(letters == 2)
    word = np.cumsum(letters == 2) - 1
    depth = np.arange(len(letters)) - head[word] if len(letters) else np.zeros(0, int)
    place = np.arange(len(letters))
    codes = []
    for k in range(ORDER):
        valid = depth >= k
        out = np.zeros(len(letters), np.uint64)
        out[valid] = rolling.of(place[valid] - k, place[valid] + 1)
        codes.append(out)
    return Grams(codes, word)


def find(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of codes among sorted keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, at, -1)


@dataclass
class Model:
    """Counts by letter stretch: per class, and continuations shared by both.  Single precision holds counts exactly."""

    keys: np.ndarray
    table: np.ndarray
    totals: np.ndarray
    taken: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    prior: float | None = None

    @staticmethod
    def of(keys: np.ndarray, own: np.ndarray, shared: np.ndarray, hist: np.ndarray) -> Model:
        """From counts per class, continuation counts, and the place of each stretch's context."""
        n, counts = len(keys), np.c_[own, shared]
        table = np.r_[counts, np.zeros((1, 3))].astype(np.float32)  # the last row, -1, is of unseen stretches
        # Slots behind the stretches: the empty context, unseen contexts, and what stands before a word's beginning.
        at = np.where(hist >= 0, hist, np.where(hist == NO_CONTEXT, n, n + 2))
        totals = np.stack([np.bincount(at, c, n + 3) for c in counts.T]).astype(np.float32)
        taken = np.stack([np.bincount(at, np.minimum(c, DISCOUNT), n + 3) for c in counts.T]).astype(np.float32)
        return Model(keys, table, totals, taken)

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary), in parts of about ``PART_LETTERS`` letters."""
        ends = np.cumsum([len(w) for w in words])
        cuts = np.searchsorted(ends, np.arange(PART_LETTERS, ends[-1] if len(words) else 0, PART_LETTERS), side="right").tolist()
        places = sorted({0, *cuts, len(words)})
        parts = [self._evidence(words[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
        return np.concatenate([np.zeros(0), *parts])

    def _evidence(self, words: list[bytes]) -> np.ndarray:
        g = grams(words)
        size = len(g.word)
        if not size:
            return np.zeros(len(words))
        low = np.full(size, 1 / ALPHABET)
        own = [low, low]
        context = np.full(size, len(self.keys))
        for k in range(ORDER):
            found = find(self.keys, g.codes[k])
            known = g.codes[k] != 0
            counts = self.table[found]
            for y in (0, 1):
                total = np.where(known, self.totals[y][context], 0)
                mass = discounted(counts[:, y], total, self.taken[y][context], low)
                own[y] = np.where(total > 0, mass, own[y])
            total = np.where(known, self.totals[2][context], 0)
            low = np.where(total > 0, discounted(counts[:, 2], total, self.taken[2][context], low), low)
            # The stretch that ended one letter earlier is the context of the next length.
            context = np.r_[-1, found[:-1]]
            context = np.where(context < 0, len(self.keys) + 1, context)
        ratio = np.log(own[1]) - np.log(own[0])
        ratio[np.r_[True, g.word[1:] != g.word[:-1]]] = 0  # the mark of the word's beginning
        return np.bincount(g.word, ratio, minlength=len(words))

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(features), self.prior)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def discounted(count: np.ndarray, total: np.ndarray, taken: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Absolute discounting: what is taken from the counts of a context goes to the lower order."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return (np.maximum(count - DISCOUNT, 0) + taken * lower) / total


def features(words: Words, evidence: np.ndarray) -> np.ndarray:
    """Per document: constant, log of the mean evidence beyond ``EXCESS``, strongest word, mean evidence."""
    n_docs = len(words.first) - 1
    n = np.maximum(np.diff(words.first), 1)
    excess = np.bincount(words.doc, np.maximum(evidence - EXCESS, 0), n_docs) / n
    mean = np.bincount(words.doc, evidence, n_docs) / n
    top = np.zeros(n_docs)
    np.maximum.at(top, words.doc, evidence)
    return np.c_[np.ones(n_docs), np.log(excess + 1e-3), np.minimum(top, 20) / 10, np.clip(mean, -2, 2)]


def _counts(text: str):
    """Letter stretches of labelled texts with their documents by fold and class, one row per stretch and task."""

    def of_slice(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        words = split_words(*text_bytes(part, text), ALNUM)
        group = np.array(part.column("fold")) * 2 + np.array(part.column("label"))
        _, where, inverse = np.unique(word_hashes(words), return_index=True, return_inverse=True)
        pairs = np.unique(words.doc * max(1, len(where)) + inverse)
        counts = np.zeros((len(where), 2 * FOLDS))
        np.add.at(counts, (pairs % max(1, len(where)), group[pairs // max(1, len(where))]), 1)
        g = grams([words.text(i) for i in where])
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for k in range(ORDER):
            at = np.flatnonzero(g.codes[k])
            begins = np.diff(g.word, prepend=-1)[at] != 0
            columns[0].append(g.codes[k][at])
            columns[1].append(g.codes[k - 1][at - 1] if k else begins.astype(np.uint64))
            columns[2].append(g.codes[k - 1][at] if k else np.zeros(len(at), np.uint64))
            columns[3].append(counts[g.word[at]])
        return merged(*(np.concatenate(c) for c in columns))

    def merged(code: np.ndarray, hist: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        keys, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        n = np.stack([np.bincount(inverse, c, len(keys)) for c in n.T], axis=1)
        return keys, hist[first], suffix[first], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        kept = none, none, none, np.zeros((0, 2 * FOLDS))
        for batch in batches:
            for part in row_slices(batch, text, COUNT_BYTES):
                kept = merged(*(np.concatenate(x) for x in zip(kept, of_slice(part), strict=True)))
        arrays = {c: pa.array(v.view(np.int64)) for c, v in zip(("code", "hist", "suffix"), kept, strict=False)}
        yield pa.record_batch(arrays | {f"n{c}": pa.array(kept[3][:, c].astype(np.int64)) for c in range(2 * FOLDS)})

    return run


def _model(rows: dict[str, np.ndarray], without: int | None = None) -> Model:
    """The model of all folds, or of all but one."""
    folds = [f for f in range(FOLDS) if f != without]
    own = np.stack([sum(rows[f"n{2 * f + y}"] for f in folds) for y in (0, 1)], axis=1).astype(float)
    seen = own.sum(axis=1) > 0
    code, hist, suffix, own = (x[seen] for x in (rows["code"], rows["hist"], rows["suffix"], own))
    order = np.argsort(code)
    code, hist, suffix, own = code[order], hist[order], suffix[order], own[order]
    # Continuations: how many longer stretches end in this one; what begins a word cannot be longer.
    at = find(code, suffix)
    longer = np.bincount(at[at >= 0], minlength=len(code)).astype(float)
    shared = np.where(longer > 0, longer, own.sum(axis=1))
    return Model.of(code, own, shared, np.where(hist <= 1, NO_CONTEXT - hist.astype(int), find(code, hist)))


def _fit_curve(x: np.ndarray, y: np.ndarray, sizes: dict[int, int] | None = None) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge.  ``sizes`` are the rows of each class that the points
    were sampled from: a point stands for as many of them, so the share of toxic rows is that of all labelled rows."""
    drawn = np.bincount(y.astype(int), minlength=2)
    each = np.array([(sizes or {}).get(c, drawn[c]) / max(drawn[c], 1) for c in (0, 1)])[y.astype(int)]
    each *= len(y) / max(each.sum(), 1e-9)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.1] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (each * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = PER_CLASS) -> Model:
    """A model of the documents that have a label of 0 or 1."""
    spark = docs.sparkSession
    rows, sizes = labelled_sample(docs, labels, ident, text, label, per_class)
    if len(sizes) < 2:
        nothing = np.zeros(0, np.uint64)
        model = Model.of(nothing, np.zeros((0, 2)), np.zeros(0), np.zeros(0, np.int64))
        model.prior = float(1 in sizes)
        return model
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int").alias("fold")
    sample = rows.select("text", F.col("y").alias("label"), fold)
    counts = [f"n{c}" for c in range(2 * FOLDS)]
    schema = "code long, hist long, suffix long, " + ", ".join(f"{c} long" for c in counts)
    table = (
        sample.mapInArrow(_counts("text"), schema)
        .groupBy("code")
        .agg(F.first("hist").alias("hist"), F.first("suffix").alias("suffix"), *[F.sum(c).alias(c) for c in counts])
        .toArrow()
    )
    found = {c: table.column(c).to_numpy() for c in table.column_names}
    found |= {c: found[c].view(np.uint64) for c in ("code", "hist", "suffix")}

    def left_out(part: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = Memo(1)
            for batch in batches:
                for rows in row_slices(batch, "text"):
                    x = _features(part.value, memo, rows, "text")
                    yield pa.record_batch({f"x{c}": pa.array(x[:, c]) for c in range(4)} | {"label": rows.column("label")})

        return run

    points = []
    for f in range(FOLDS):  # one model of a fold at a time
        part = spark.sparkContext.broadcast(_model(found, f))
        chosen = sample.where(F.col("fold") == f)
        points.append(chosen.mapInArrow(left_out(part), "x0 double, x1 double, x2 double, x3 double, label int").toArrow())
        part.unpersist()
    points = pa.concat_tables(points)
    x = np.stack([points.column(f"x{c}").to_numpy() for c in range(4)], axis=1)
    model = _model(found)
    model.weights = _fit_curve(x, points.column("label").to_numpy().astype(float), sizes)
    return model


def _features(model: Model, memo: Memo, part: pa.RecordBatch, text: str) -> np.ndarray:
    words = split_words(*text_bytes(part, text), ALNUM)
    found = memo.lookup(word_hashes(words), lambda at: model.evidence([words.text(i) for i in at])[:, None])
    return features(words, found[:, 0].astype(float))


def with_score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus the score; the name of that column comes second."""
    name = fresh(docs, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(1)
        for batch in batches:
            for part in row_slices(batch, text):
                yield appended(part, {name: pa.array(shared.value.score(_features(shared.value, memo, part, text)))})

    return docs.mapInArrow(run, with_fields(docs, T.StructField(name, T.DoubleType()))), name


def keep_ordinary(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold."""
    scored, name = with_score(docs, model, text)
    return scored.where(F.col(name) < threshold).select(*docs.columns)
