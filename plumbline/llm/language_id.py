"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of one word (a run of ASCII letters and non-ASCII bytes; long runs in pieces of
``PIECE`` bytes) from both ends and gives every position a probability for each language.  A document's probabilities
are the mean over all its positions.  It is trained in numpy by backpropagation through time on words of a bounded
sample: about ``per_lang`` documents of each language, chosen by the hash of the text.  Words of one length form a
batch, so nothing is padded.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if no language could
be learned; training rows without text or language are not used; upper and lower case ASCII read alike; repeated
documents get equal results; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.text_blocks import (
    LETTERS, Memo, Words, appended, fresh, row_slices, split_words, text_bytes, with_fields, word_hashes,
)

PER_LANG = 300
HIDDEN = 16
PIECE = 24
STEPS = 500
BATCH = 512
RATE = 0.01
BLOCK = 8192  # words of one length that are read at once
UNKNOWN = "und"
MIN_SCORE = 0.3  # with four languages hardly better than a guess


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Direction:
    """One gated recurrent layer: input rows by byte (update, reset, candidate gates) and recurrent weights."""

    rows: np.ndarray
    recurrent: np.ndarray

    def forward(self, bytes_: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (time, word, unit) and what the way back needs."""
        n = self.recurrent.shape[0]
        h, states, kept = np.zeros((len(bytes_), n), np.float32), [], []
        for t in range(bytes_.shape[1]):
            x, u = self.rows[bytes_[:, t]], h @ self.recurrent
            gates = _sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(x[:, 2 * n :] + r * u[:, 2 * n :])
            kept.append((h, z, r, c, u[:, 2 * n :]))
            h = c + z * (h - c)
            states.append(h)
        return np.stack(states), kept

    def backward(self, bytes_: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.recurrent.shape[0]
        d_rows, d_recurrent = np.zeros_like(self.rows), np.zeros_like(self.recurrent)
        back = np.zeros_like(d_states[0])
        for t in reversed(range(bytes_.shape[1])):
            h, z, r, c, u = kept[t]
            d = d_states[t] + back
            d_c = d * (1 - z) * (1 - c * c)
            d_z = d * (h - c) * z * (1 - z)
            d_r = d_c * u * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_c], axis=1)
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
            np.add.at(d_rows, bytes_[:, t], d_x)
            d_recurrent += h.T @ d_u
            back = d * z + d_u @ self.recurrent.T
        return d_rows, d_recurrent


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    output: np.ndarray

    def states(self, bytes_: np.ndarray) -> tuple[np.ndarray, list, list]:
        a, kept_a = self.ahead.forward(bytes_)
        b, kept_b = self.behind.forward(bytes_[:, ::-1])
        ones = np.ones((*a.shape[:2], 1), np.float32)
        return np.concatenate([a, b[::-1], ones], axis=2), kept_a, kept_b

    def positions(self, bytes_: np.ndarray) -> np.ndarray:
        """Probabilities (time, word, language)."""
        s = self.states(bytes_)[0] @ self.output
        e = np.exp(s - s.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def gradients(self, bytes_: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        states, kept_a, kept_b = self.states(bytes_)
        s = states @ self.output
        p = np.exp(s - s.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(target)), target] -= 1
        p /= p.shape[0] * p.shape[1]
        d_output = np.einsum("twi,twk->ik", states, p)
        d_states = p @ self.output.T
        n = self.ahead.recurrent.shape[0]
        d_a = self.ahead.backward(bytes_, kept_a, d_states[..., :n])
        d_b = self.behind.backward(bytes_[:, ::-1], kept_b, d_states[::-1, :, n : 2 * n])
        return [*d_a, *d_b, d_output]

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.rows, self.ahead.recurrent, self.behind.rows, self.behind.recurrent, self.output]

    def read(self, words: list[bytes]) -> np.ndarray:
        """Sums of the position probabilities of each word."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        pieces = [(k, w[i : i + PIECE]) for k, w in enumerate(words) for i in range(0, len(w), PIECE)]
        length = np.array([len(p) for _, p in pieces])
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            for k in range(0, len(at), BLOCK):
                block = [pieces[i] for i in at[k : k + BLOCK].tolist()]
                bytes_ = np.frombuffer(b"".join(p for _, p in block), np.uint8).reshape(-1, n)
                np.add.at(out, [w for w, _ in block], self.positions(bytes_).sum(axis=0))
        return out


def new_network(languages: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)

    def random(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.3, shape).astype(np.float32)

    layers = [Direction(random(256, 3 * HIDDEN), random(HIDDEN, 3 * HIDDEN)) for _ in range(2)]
    return Network(languages, *layers, random(2 * HIDDEN + 1, len(languages)))


def train(words: list[bytes], target: np.ndarray, count: np.ndarray, languages: list[str], steps: int = STEPS,
          seed: int = 7) -> Network:
    """Adam on batches of words of one length; words are drawn by their counts, languages alike."""
    network, rng = new_network(languages, seed), np.random.default_rng(seed)
    cut = [(p, t, c) for w, t, c in zip(words, target.tolist(), count.tolist(), strict=True)
           for p in [w[i : i + PIECE] for i in range(0, len(w), PIECE)]]
    length, t = np.array([len(p) for p, *_ in cut]), np.array([t for _, t, _ in cut])
    weight = np.array([c for *_, c in cut], float)
    weight /= np.bincount(t, weight, len(languages))[t]
    groups = []
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        bytes_ = np.frombuffer(b"".join(cut[i][0] for i in at.tolist()), np.uint8).reshape(-1, n)
        chance = np.cumsum(weight[at])
        groups.append((bytes_, t[at], chance / chance[-1], chance[-1] * n))
    size = np.cumsum([g[3] for g in groups])
    first = [np.zeros_like(w) for w in network.weights()]
    second = [np.zeros_like(w) for w in network.weights()]
    for step in range(1, steps + 1):
        bytes_, y, chance, _ = groups[int(np.searchsorted(size, rng.random() * size[-1]))]
        pick = np.minimum(np.searchsorted(chance, rng.random(BATCH)), len(y) - 1)
        rate = RATE * (1 - step / (steps + 1))
        for w, g, m, v in zip(network.weights(), network.gradients(bytes_[pick], y[pick]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return network


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_slices(batch, "text"):
            words = split_words(*text_bytes(part, "text"), LETTERS)
            langs = part.column("lang").to_pylist()
            found: dict[tuple[str, bytes], int] = {}
            for k, d in enumerate(words.doc.tolist()):
                key = langs[d], words.text(k)
                found[key] = found.get(key, 0) + 1
            yield pa.record_batch({
                "lang": pa.array([k for k, _ in found], pa.string()),
                "word": pa.array([w for _, w in found], pa.binary()),
                "n": pa.array(list(found.values()), pa.int64()),
            })


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, steps: int = STEPS) -> Network:
    """A network trained on words of about ``per_lang`` documents of each language."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text <> '' AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return new_network([])
    spread = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1_000_000))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, per_lang / n)]), F.col("lang"))
    words = (
        rows.where(spread < 1_000_000 * share)
        .mapInArrow(_sample_words, "lang string, word binary, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .orderBy("lang", "word")
        .toArrow()
    )
    languages = sorted(set(words.column("lang").to_pylist()))
    if not languages:
        return new_network([])
    target = np.searchsorted(np.array(languages), np.array(words.column("lang").to_pylist()))
    return train(words.column("word").to_pylist(), target, np.array(words.column("n")), languages, steps)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = np.r_[0, np.cumsum(LETTERS[data] & (data < 0x80))]
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for k in np.flatnonzero(~found).tolist():
        found[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _pooled(network: Network, memo: Memo, part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(part, text)
    words: Words = split_words(data, offsets, LETTERS)
    sums = memo.lookup(word_hashes(words), lambda at: network.read([words.text(i) for i in at]))
    whole = np.stack([np.bincount(words.doc, s, part.num_rows) for s in sums.T], axis=1)
    positions = np.bincount(words.doc, words.end - words.start, part.num_rows)
    return whole / np.maximum(positions, 1)[:, None], has_letter(data, offsets)


def with_language(docs: DataFrame, network: Network, text: str = "text") -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` plus language and score; the names of these columns come second."""
    names = fresh(docs, "language"), fresh(docs, "language_score")
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        memo = Memo(len(net.languages))
        for batch in batches:
            for part in row_slices(batch, text):
                if net.languages:
                    p, letters = _pooled(net, memo, part, text)
                    best = p.argmax(axis=1)
                    lang = [net.languages[b] if x else UNKNOWN for b, x in zip(best.tolist(), letters, strict=True)]
                    score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
                else:
                    lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                yield appended(part, {names[0]: pa.array(lang, pa.string()), names[1]: pa.array(score.astype(float))})

    schema = with_fields(docs, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()))
    return docs.mapInArrow(run, schema), names


def keep_identified(docs: DataFrame, network: Network, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those whose language is unknown or less likely than ``min_score``."""
    named, (lang, score) = with_language(docs, network, text)
    return named.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
