"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are words (runs of bytes other than ASCII white space, lower-cased in ASCII) and one end per document.  Every
word, and the start of a document, is the context of the token after it and has a restaurant of its own.  All pairs of
a context and a token are counted exactly, in a distributed table that grows with the corpus.  Who opens a table there
orders from the parent: a distribution over all words that depends on the place in the document, as follows.

The ``DISHES`` most frequent words, the end and "some rarer word" are the dishes of restaurants for the last frequent
function word (one of the ``NEAR`` most frequent words) and the one before it (one of the ``FAR`` most frequent);
restaurants with the same last word share a parent, and all parents share the root, whose base is uniform over the
dishes.  These are fitted to all tokens first and then held.  A rarer word is drawn from a Pitman-Yor restaurant over
all rarer words of the corpus, whose base is continuous: every word sits at one table, and what the discount leaves is
the probability of any unknown word.

Seating is sampled by Gibbs: given the predictive distribution of its parent, every sweep draws the tables of all dishes
from their exact conditional (``seating``) and goes on from the last one's state, which is one mass per restaurant; the
first one starts from customers seated one by one and repeats that ``MOVES`` times.  Tables are the customers of the parent.  The predictive probabilities of several samples are averaged.  A text's score is the sum of the log10
probabilities of its tokens; all probabilities of one context add up to 1.

What grows with the corpus stays in Spark.  Pairs are dealt to buckets by the word before, those of restaurants with more
than ``WIDE`` customers by the pair, and travel as compressed blocks: words are numbers of the ``CACHED`` most frequent
ones, and the context takes the place of the parent's probability, which is looked up where blocks meet.  Narrow
restaurants are seated where their pairs are counted; the rows of wide ones stay dealt over all tasks, and only their total
tables reach the driver (one number per ``WIDE`` tokens at most).  Tokens to score meet the seated pairs of their bucket;
those outside the cache then meet the table of counts.  Bounded and broadcast are the counts of the ``CACHED`` most frequent
words at most, the averaged table of function words by dishes, and the pairs that occur more than ``WIDE`` times (at most
one per ``WIDE`` tokens).  Words are told apart by 64-bit codes.

Defined results: a null or empty text is its end alone; without training documents every probability is 1 (score 0);
repeated documents are counted and scored as often as they occur; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.seating import DISCOUNT, STRENGTH, draw, draw_mass
from plumbline.llm.text_blocks import mixed, row_slices, split_words, stored, text_bytes, word_hashes

DISHES = 8192
NEAR = 64
FAR = 8
CACHED = 1 << 20
BURN_IN = 2
SAMPLES = 3
MOVES = 6
END = np.uint64(1)
START = np.uint64(2)
WIDE = 4096
FLUSH = 1 << 20
CHUNK = 1 << 19
PART = 1 << 18
BUCKETS = 64
BUCKET = 1 << 22


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens, the end of each document included, and the first token of each document."""
    words = split_words(data, offsets)
    first = words.first + np.arange(len(words.first))
    codes = np.full(len(words) + len(offsets) - 1, END)
    codes[np.arange(len(words)) + words.doc] = word_hashes(words)
    return codes, first


def _among(listed: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes in an ordered list, and whether they are there."""
    at = np.minimum(np.searchsorted(listed, codes), max(0, len(listed) - 1))
    return at, listed[at] == codes if len(listed) else np.zeros(len(codes), bool)


class Places:
    """Places of codes in an ordered list.  Codes are spread evenly, so their first bits nearly tell the place."""

    def __init__(self, listed: np.ndarray):
        self.listed, self.bits = listed, max(8, len(listed).bit_length())
        self.begin = np.searchsorted(listed, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each code, or a place near it, and whether the code is there."""
        if not len(self.listed):
            return np.zeros(len(codes), np.int32), np.zeros(len(codes), bool)
        last = len(self.listed) - 1
        at = np.minimum(self.begin[(codes >> np.uint64(64 - self.bits)).view(np.int64)], last)
        found = self.listed[at]
        rest = np.flatnonzero((found < codes) & (at < last))
        while len(rest):
            at[rest] += 1
            found[rest] = self.listed[at[rest]]
            rest = rest[(found[rest] < codes[rest]) & (at[rest] < last)]
        return at, found == codes


# --- counts --------------------------------------------------------------------------------------------------


def _merged(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([c for c, _ in kept]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in kept]), len(codes)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, waiting = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0

    def rows() -> pa.RecordBatch:
        return pa.record_batch({"h": pa.array(kept[0][0].view(np.int64)), "c": pa.array(kept[0][1])})

    for batch in batches:
        for part in row_slices(batch, "text"):
            kept.append(np.unique(tokens(*text_bytes(part, "text"))[0], return_counts=True))
            waiting += len(kept[-1][0])
            if waiting > CHUNK:
                kept, waiting = [_merged(kept)], 0
                if len(kept[0][0]) > FLUSH:
                    yield rows()
                    kept = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    kept = [_merged(kept)]
    yield rows()


def count_words(texts: DataFrame) -> DataFrame:
    """(h, c) over all tokens of the column ``text``."""
    return stored(texts.mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")


@dataclass
class Corpus:
    """Totals of the training tokens, and the counts of the most frequent words, ordered by code."""

    tokens: int
    types: int
    codes: np.ndarray
    counts: np.ndarray
    cached_from: int
    rare_discount: float


def corpus(counts: DataFrame, cached: int = CACHED) -> Corpus:
    by_count = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toArrow()
    c, n = (np.array(by_count.column(x), np.int64) for x in ("c", "n"))
    fits = np.flatnonzero(np.cumsum(n) <= cached)
    least = int(c[fits[-1]]) if len(fits) else int(c[0]) + 1 if len(c) else 1
    top = counts.where(F.col("c") >= least).toArrow()
    codes, order = np.unique(np.array(top.column("h"), np.int64).view(np.uint64), return_index=True)
    once, twice = (int(n[c == k].sum()) for k in (1, 2))
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    return Corpus(int((c * n).sum()), int(n.sum()), codes, np.array(top.column("c"), np.int64)[order], least, discount)


# --- contexts ------------------------------------------------------------------------------------------------


@dataclass
class Menu:
    """Dishes by code (the end among them); the last dish stands for all rarer words."""

    codes: np.ndarray
    near: np.ndarray  # rank among the most frequent words by dish, or -1

    @property
    def rare(self) -> int:
        return len(self.codes)

    def dishes(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes), int)
        at, there = self.places.of(codes)
        return np.where(there, at, self.rare)

    @cached_property
    def places(self) -> Places:
        return Places(self.codes)

    def contexts(self, dishes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Number of the context of each token."""
        rank = np.r_[self.near, -1][dishes]
        marked = rank >= 0
        ends = first[1:][first[1:] > first[0]] - 1
        marked[ends] = True  # nothing is known beyond the end of a document
        rank[ends] = NEAR
        last = rank[marked]
        before = np.r_[NEAR, last[:-1]][: len(last)]
        found = last * (FAR + 1) + np.where((before < FAR) & (last < NEAR), before, FAR)
        # For each token the number of marks before it, and through it the last mark and the one before that.
        return np.r_[NEAR * (FAR + 1) + FAR, found][np.cumsum(marked) - marked]


CONTEXTS = (NEAR + 1) * (FAR + 1)


def menu(known: Corpus, dishes: int = DISHES) -> Menu:
    order = np.lexsort((known.codes, -known.counts))
    # Whole levels of counts only, so the menu does not depend on the order of equal counts.
    if len(order) > dishes:
        order = order[known.counts[order] > known.counts[order[dishes]]]
    codes = np.unique(np.r_[known.codes[order], [END] if known.tokens else []].astype(np.uint64))
    words = known.codes[order][known.codes[order] != END][:NEAR]
    near = np.full(len(codes), -1)
    near[np.searchsorted(codes, words)] = np.arange(len(words))
    return Menu(codes, near)


def count_contexts(texts: DataFrame, width: int, shared: Shared) -> tuple[DataFrame, DataFrame]:
    """(x, dish, c) of all tokens of the column ``text``, and (v, w, x) of those outside the cache: the word before, the
    word and the context.  One reading writes both as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value, np.zeros(CONTEXTS * width, np.int64)
        for codes, first, _ in _chunks(batches, "text"):
            known, v, w, x, lost = _read(m, codes, first)
            keys, n = np.unique(x * width + m.served.dishes(codes), return_counts=True)
            table[keys] += n
            if lost.any():
                block = _pack(known.codes(v[lost]), codes[lost], x[lost].astype(np.uint16))
                yield pa.record_batch({"counts": pa.nulls(1, pa.binary()), "lost": pa.array([block], pa.binary())})
        at = np.flatnonzero(table)
        block = _pack(at.astype(np.uint32), table[at].astype(np.uint64))
        yield pa.record_batch({"counts": pa.array([block], pa.binary()), "lost": pa.nulls(1, pa.binary())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("counts"):
                at, c = (y.astype(np.int64) for y in _unpack(block.as_py(), (np.uint32, np.uint64)))
                yield pa.record_batch({"x": at // width, "dish": at % width, "c": c})

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("lost"):
                v, w, x = _unpack(block.as_py(), (np.int64, np.int64, np.uint16))
                yield pa.record_batch({"v": v, "w": w, "x": x.astype(np.int64)})

    read = stored(texts.mapInArrow(run, "counts binary, lost binary"), "lm-contexts")
    counts = read.where("counts IS NOT NULL").select("counts").mapInArrow(counted, "x long, dish long, c long")
    lost = read.where("lost IS NOT NULL").select("lost").mapInArrow(missing, "v long, w long, x long")
    return counts.groupBy("x", "dish").agg(F.sum("c").alias("c")), lost


# --- seating -------------------------------------------------------------------------------------------------


def seat(customers: np.ndarray, parent: np.ndarray, rng: np.random.Generator, moves: int = MOVES) -> np.ndarray:
    """Tables of each dish in one restaurant, seated customer by customer: where the chain of ``reseat`` begins."""
    n, t = np.ones(len(customers), np.int64), np.ones(len(customers), np.int64)
    sizes, owner = [np.ones(len(customers), np.int64)], [np.arange(len(customers))]
    while (open_ := np.flatnonzero(n < customers)).size:
        step = np.minimum(np.maximum(1, n[open_] // 8), customers[open_] - n[open_])
        fresh_ = (STRENGTH + DISCOUNT * t.sum()) * parent[open_]
        new = rng.binomial(step, fresh_ / (fresh_ + n[open_] - DISCOUNT * t[open_]))
        sizes[0][open_] += step - new  # who joins a table joins the first; the moves below even that out
        owner.append(np.repeat(open_, new))
        sizes.append(np.ones(new.sum(), np.int64))
        n[open_] += step
        t[open_] += new
    size, who = np.concatenate(sizes), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    size, who = size[order], who[order]
    movable = np.flatnonzero(customers > 1)
    for _ in range(moves if movable.size else 0):
        # One customer of each dish gets up ...
        ends = np.cumsum(size)
        begin = np.r_[0, np.cumsum(customers)][movable]
        at = np.searchsorted(ends, begin + (rng.random(len(movable)) * customers[movable]).astype(np.int64), "right")
        size[at] -= 1
        weight = np.where(size > 0, size - DISCOUNT, 0.0)
        mass = np.bincount(who, weight, len(customers))[movable]
        # ... and opens a table or joins one in proportion to its size.
        fresh_ = (STRENGTH + DISCOUNT * np.count_nonzero(size)) * parent[movable]
        opens = rng.random(len(movable)) * (fresh_ + mass) < fresh_
        ends = np.cumsum(weight)
        before = np.r_[0.0, ends][np.searchsorted(who, movable)]
        last = np.searchsorted(who, movable, "right") - 1
        to = np.searchsorted(ends, before + rng.random(len(movable)) * mass * (1 - 1e-12), "right")
        np.add.at(size, np.minimum(to, last)[~opens], 1)
        size, who = np.r_[size, np.ones(opens.sum(), np.int64)], np.r_[who, movable[opens]]
        order = np.argsort(who, kind="stable")
        order = order[size[order] > 0]
        size, who = size[order], who[order]
    return np.bincount(who, minlength=len(customers))


def reseat(customers: np.ndarray, parent: np.ndarray, rng: np.random.Generator, mass: float | None = None) -> np.ndarray:
    """Tables of each dish in one restaurant, given its customers and the parent's probability of each dish, all drawn
    anew from their conditional.  The chain goes on from ``mass``; without one it begins here, with ``MOVES`` moves."""
    moves = 1
    if mass is None:
        mass, moves = float(draw_mass(seat(customers, parent, rng).sum(), rng)), MOVES
    for k in range(moves):
        if k:
            mass = float(draw_mass(tables.sum(), rng))
        tables = draw(customers, mass * parent, rng)
    return tables


def predictive(customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Probability of each dish; rows of arrays are restaurants."""
    all_customers, all_tables = customers.sum(axis=-1, keepdims=True), tables.sum(axis=-1, keepdims=True)
    return (customers - DISCOUNT * tables + (STRENGTH + DISCOUNT * all_tables) * parent) / (STRENGTH + all_customers)


def _seat_rows(state, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for x, dish, c in zip(*(batch.column(k) for k in ("x", "dish", "c")), strict=True):
                x, dish, c = x.as_py(), np.array(dish.values), np.array(c.values)
                rng = np.random.default_rng([seed, x])
                parents, masses = state.value
                mass = None if masses is None else masses[x]
                rows.append((x, dish, reseat(c, parents[x // (FAR + 1)][dish], rng, mass)))
            yield pa.record_batch({
                "x": pa.array([r[0] for r in rows], pa.int64()),
                "dish": pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                "t": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            })

    return run


def average_predictive(pairs: DataFrame, width: int, burn_in: int = BURN_IN, samples: int = SAMPLES) -> np.ndarray:
    """Averaged probabilities (context, dish).  The restaurants of the contexts are seated in parallel by Spark; the
    driver holds their parents and the root, whose size is fixed by the parameters."""
    spark = pairs.sparkSession
    rows = pairs.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("dish", "c"))).alias("p"))
    rows = stored(rows.select("x", F.col("p.dish").alias("dish"), F.col("p.c").alias("c")).repartition(32, "x"), "lm-rows")
    customers = np.zeros((CONTEXTS, width), np.int64)
    for r in rows.toArrow().to_batches():
        for x, dish, c in zip(*(r.column(k) for k in ("x", "dish", "c")), strict=True):
            customers[x.as_py(), np.array(dish.values)] = np.array(c.values)
    root = (customers.sum(axis=0) + 1.0) / (customers.sum() + width)
    parents = np.tile(root, (NEAR + 1, 1))
    total = np.zeros((CONTEXTS, width))
    masses, up_masses, top_mass = None, [None] * (NEAR + 1), None
    for sweep in range(burn_in + samples):
        shared = spark.sparkContext.broadcast((parents, masses))
        tables = np.zeros((CONTEXTS, width), np.int32)
        for r in rows.mapInArrow(_seat_rows(shared, sweep), "x long, dish array<long>, t array<long>").toArrow().to_batches():
            for x, dish, t in zip(*(r.column(k) for k in ("x", "dish", "t")), strict=True):
                tables[x.as_py(), np.array(dish.values)] = np.array(t.values)
        shared.unpersist()
        # Tables of the contexts are the customers of their parents; those tables are the customers of the root.
        up = tables.reshape(NEAR + 1, FAR + 1, width).sum(axis=1)
        up_tables = np.zeros_like(up)
        rng = np.random.default_rng([sweep, CONTEXTS])
        # What the next sweep goes on from: the mass of each restaurant, given its tables.
        masses = draw_mass(tables.sum(axis=1), rng)
        for a in range(NEAR + 1):
            at = np.flatnonzero(up[a])
            up_tables[a, at] = reseat(up[a, at], root[at], rng, up_masses[a])
            up_masses[a] = float(draw_mass(up_tables[a].sum(), rng))
        top = up_tables.sum(axis=0)
        top_tables, at = np.zeros_like(top), np.flatnonzero(top)
        flat = np.full(width, 1 / width)
        top_tables[at] = reseat(top[at], flat[at], rng, top_mass)
        top_mass = float(draw_mass(top_tables.sum(), rng))
        root = predictive(top, top_tables, flat)
        parents = predictive(up, up_tables, root)
        if sweep >= burn_in:
            for a in range(NEAR + 1):
                own = slice(a * (FAR + 1), (a + 1) * (FAR + 1))
                total[own] += predictive(customers[own], tables[own], parents[a])
    return total / samples


# --- blocks --------------------------------------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as one compressed block; the first bytes of all numbers lie together, then the second ones, and so on."""
    sizes = np.array([len(c) for c in columns], np.int64).tobytes()
    raw = sizes + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(block: bytes, types: tuple[type, ...], only: int | None = None) -> list[np.ndarray]:
    """The columns of a block, or only the first ones."""
    raw = np.frombuffer(pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd"), np.uint8)
    at, out = 8 * len(types), []
    for n, kind in list(zip(raw[:at].view(np.int64), types, strict=True))[:only]:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _distinct(*fields: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of whole numbers from 0 in their order, and how often each occurs."""
    if not len(fields[0]):
        return list(fields), np.zeros(0, np.int64)
    bits = [int(f.max()).bit_length() for f in fields]
    if sum(bits) > 64:
        order = np.lexsort(fields[::-1])
        rows = [f[order] for f in fields]
        at = np.flatnonzero(np.r_[True, np.any([f[1:] != f[:-1] for f in rows], axis=0)])
        return [f[at] for f in rows], np.diff(np.r_[at, len(order)])
    key = np.zeros(len(fields[0]), np.uint64)
    for f, b in zip(fields, bits, strict=True):
        key = (key << np.uint64(b)) | f.astype(np.uint64)
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n, key, rows = np.diff(np.r_[at, len(key)]), key[at], []
    for b in reversed(bits):
        rows.append((key & np.uint64((1 << b) - 1)).astype(np.int32 if b < 32 else np.int64))
        key = key >> np.uint64(b)
    return rows[::-1], n


def _starts(*fields: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before."""
    if not len(fields[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([f[1:] != f[:-1] for f in fields], axis=0)])


def _runs(at: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[at, n])


ASKED = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint16, np.uint32, np.uint32)
SEATED = (np.uint64, np.uint32, np.uint32, np.uint32, np.uint64, np.uint64)
OPEN = (*SEATED[:-1], np.float64)


def _asked(m: Model, known: Bucket, v: np.ndarray, w: np.ndarray, x: np.ndarray, n: np.ndarray,
           doc: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """Blocks of ordered rows (word before, word, context, times, document) by bucket; words are numbers of ``known``."""
    cached, at = len(m.known.codes), _starts(v, w)
    dealt = np.repeat(m.deal(known.codes(v[at]), known.codes(w[at])), _runs(at, len(v)))
    order = np.argsort(dealt, kind="stable")
    ends = np.searchsorted(dealt[order], np.arange(m.buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        part = order[ends[b] : ends[b + 1]]
        v_, w_ = v[part], w[part]
        pair = _starts(v_, w_)
        run = _starts(v_[pair])
        refs, others = _refs(np.r_[v_[pair][run], w_[pair]], cached)
        columns = (known.others[others], known.counts[others], refs[: len(run)], _runs(run, len(pair)), refs[len(run) :],
                   _runs(pair, len(part)), x[part], n[part], np.zeros(0) if doc is None else doc[part])
        yield int(b), _pack(*(c.astype(kind) for c, kind in zip(columns, ASKED, strict=True)))


def _refs(words: np.ndarray, cached: int) -> tuple[np.ndarray, np.ndarray]:
    """Words numbered for one block: places in the cache as they are, and which of the others are there, in their order."""
    outside = words >= cached
    others = np.unique(words[outside])
    refs = words.copy()
    refs[outside] = cached + np.searchsorted(others, words[outside])
    return refs, others - cached


def _codes(m: Model, others: np.ndarray, refs: np.ndarray) -> np.ndarray:
    out, inside = np.zeros(len(refs), np.uint64), refs < len(m.known.codes)
    out[inside] = m.known.codes[refs[inside]]
    out[~inside] = others[refs[~inside] - len(m.known.codes)]
    return out


@dataclass
class Bucket:
    """Numbers of words that hold for all blocks of a bucket: places in the cache, then the codes found besides."""

    m: Model
    others: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(m: Model, codes: list[np.ndarray], counts: list[np.ndarray]) -> Bucket:
        others, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]), return_inverse=True)
        best = np.zeros(len(others), np.int64)
        np.maximum.at(best, inverse, np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64))
        return Bucket(m, others, best)

    def numbers(self, refs: np.ndarray, codes: np.ndarray) -> np.ndarray:
        cached, refs = len(self.m.known.codes), refs.astype(np.int64)
        at = np.r_[np.searchsorted(self.others, codes), 0]
        return np.where(refs < cached, refs, cached + at[np.clip(refs - cached, 0, len(at) - 1)])

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        return _codes(self.m, self.others, numbers)

    def parent(self, words: np.ndarray, of: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Probability at the parent of the words ``words[of]`` in contexts ``x``."""
        m, codes, c = self.m, self.codes(words), np.zeros(len(words), np.int64)
        dishes, inside = m.served.dishes(codes), words < len(m.known.codes)
        c[inside] = m.known.counts[words[inside]]
        c[~inside] = self.counts[words[~inside] - len(m.known.codes)]
        rare = (dishes == m.served.rare) & (codes != END)
        factor = np.where(rare, 10.0 ** m.log_rare(c), 1.0)
        return 10.0 ** m.log_dish[x, dishes[of]].astype(float) * factor[of]


# --- pairs ---------------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """Codes of about ``CHUNK`` tokens, the first token of each document, and the other columns of the documents."""
    kept, n = [], 0

    def whole() -> tuple[np.ndarray, np.ndarray, pa.Table]:
        begin = np.cumsum([0, *(len(c) for c, _, _ in kept)])
        first = np.concatenate([*(f[:-1] + b for (_, f, _), b in zip(kept, begin[:-1], strict=True)), begin[-1:]])
        return np.concatenate([c for c, _, _ in kept]), first, pa.Table.from_batches([p for _, _, p in kept])

    for batch in batches:
        for part in row_slices(batch, text):
            codes, first = tokens(*text_bytes(part, text))
            kept.append((codes, first, part.drop_columns([text])))
            n += len(codes)
            if n > CHUNK:
                yield whole()
                kept, n = [], 0
    if kept:
        yield whole()


def _numbered(m: Model, codes: np.ndarray) -> tuple[Bucket, np.ndarray]:
    """The number of each code: its place in the cache, or one after these."""
    place, hit = m.places(codes)
    others = np.unique(codes[~hit])
    place[~hit] = len(m.known.codes) + np.searchsorted(others, codes[~hit])
    return Bucket(m, others, np.zeros(len(others), np.int64)), place


def _read(m: Model, codes: np.ndarray, first: np.ndarray) -> tuple[Bucket, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk; of each token the word before, the word, the context, and whether its count is missing."""
    known, w = _numbered(m, np.r_[codes, START])
    begin, w = w[-1], w[:-1]
    dishes = m.served.dishes(codes)
    v = np.r_[begin, w[:-1]]
    v[first[:-1]] = begin
    lost = (w >= len(m.known.codes)) & (dishes == m.served.rare) & (codes != END)
    return known, v, w, m.served.contexts(dishes, first), lost


def _with_rare(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Words ``w`` outside the cache with their counts ``c``."""
    rare = counts.where(F.col("c") < model.known.cached_from).select(F.col("h").alias("w2"), F.col("c").alias("c2"))
    return rows.join(rare, rows["w"] == rare["w2"], "left").select(*rows.columns, F.coalesce("c2", F.lit(0)).alias("c"))


def _resolved(rows: DataFrame, model: Model, counts: DataFrame, shared: Shared) -> DataFrame:
    """(bucket, block) of the rows (v, w, x) of words outside the cache, which meet the table of counts first."""
    met = _with_rare(rows, model, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kept = shared.value, []

        def blocks() -> pa.RecordBatch:
            table = pa.Table.from_batches(kept)
            v, w, x, c = (table.column(k).to_numpy() for k in ("v", "w", "x", "c"))
            known, words = _numbered(m, np.r_[v, w].view(np.uint64))
            v, w = words[: len(v)], words[len(v) :]
            known.counts[w - len(m.known.codes)] = c
            (v, w, x), n = _distinct(v, w, x)
            return _bucket_rows(_asked(m, known, v, w, x, n))

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) > CHUNK:
                yield blocks()
                kept = []
        if sum(b.num_rows for b in kept):
            yield blocks()

    return met.mapInArrow(run, "bucket int, block binary")


def _bucket_rows(blocks: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    listed = list(blocks)
    return pa.record_batch({"bucket": pa.array([b for b, _ in listed], pa.int32()), "block": pa.array([x for _, x in listed], pa.binary())})


def count_pairs(texts: DataFrame, lost: DataFrame, model: Model, counts: DataFrame, shared: Shared) -> DataFrame:
    """(bucket, seated, open): the pairs of neighbours of each bucket.  Narrow restaurants come with their tables; pairs
    of wide ones with the mean probability of the word at the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for codes, first, _ in _chunks(batches, "text"):
            known, v, w, x, lost = _read(m, codes, first)
            (v, w, x), n = _distinct(v[~lost], w[~lost], x[~lost])
            yield _bucket_rows(_asked(m, known, v, w, x, n))

    def gather(table: pa.Table) -> pa.Table:
        m: Model = shared.value
        heads = [_unpack(b.as_py(), ASKED, 2) for b in table.column("block")]
        known = Bucket.of(m, [h[0] for h in heads], [h[1] for h in heads])
        keys, times, shares = [], [], []
        for block in table.column("block"):
            codes, _, v, nv, w, nw, x, n, _ = _unpack(block.as_py(), ASKED)
            v, w = np.repeat(known.numbers(v, codes), nv), known.numbers(w, codes)
            h = known.parent(w, np.repeat(np.arange(len(w)), nw), x) * n
            at = np.r_[0, np.cumsum(nw, dtype=np.int64)[:-1]]
            keys.append((v << 32) | w)
            times.append(np.add.reduceat(n.astype(np.int64), at))
            shares.append(np.add.reduceat(h, at))
        keys, times, shares = (np.concatenate(y) for y in (keys, times, shares))
        # Some of the restaurants at a time, to hold less.
        parts, rows = -(-len(keys) // PART), []
        which = ((keys >> 32) % parts).astype(np.int32)
        for part in range(parts):
            own = which == part
            if own.any():
                rows.append(seat_some(m, known, keys[own], times[own], shares[own]))
        seated, open_ = (pa.array(y, pa.binary()) for y in zip(*rows, strict=True))
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int32()), "seated": seated, "open": open_})

    def seat_some(m: Model, known: Bucket, keys: np.ndarray, times: np.ndarray, shares: np.ndarray) -> list[bytes | None]:
        key, inverse = np.unique(keys, return_inverse=True)
        c = np.bincount(inverse, times, len(key)).astype(np.int64)
        h = np.bincount(inverse, shares, len(key)) / c
        v, w = key >> 32, key & 0xFFFFFFFF
        run = _starts(v)
        wide = np.repeat(m.is_wide(known.codes(v[run])), _runs(run, len(v)))
        tables = _seat_narrow(v[~wide], w[~wide], c[~wide], h[~wide])
        return [_packed_pairs(known, v[a], w[a], c[a], last, kinds) if a.any() else None
                for a, last, kinds in ((~wide, tables, SEATED), (wide, h[wide], OPEN))]

    blocks = texts.mapInArrow(run, "bucket int, block binary")
    if len(model.known.codes) < model.known.types:
        blocks = blocks.unionByName(_resolved(lost, model, counts, shared))
    return stored(blocks.groupBy("bucket").applyInArrow(gather, "bucket int, seated binary, open binary"), "lm-pairs")


def _packed_pairs(known: Bucket, v: np.ndarray, w: np.ndarray, c: np.ndarray, last: np.ndarray, kinds: tuple) -> bytes:
    run = _starts(v)
    refs, others = _refs(np.r_[v[run], w], len(known.m.known.codes))
    columns = (known.others[others], refs[: len(run)], _runs(run, len(v)), refs[len(run) :], c, last)
    return _pack(*(x.astype(kind) for x, kind in zip(columns, kinds, strict=True)))


def _pairs_of(m: Model, block: bytes) -> tuple[np.ndarray, ...]:
    """(v, w, c, t) of a block of seated pairs, words as codes."""
    others, v, nv, w, c, t = _unpack(block, SEATED)
    return np.repeat(_codes(m, others, v), nv), _codes(m, others, w), c.astype(np.int64), t / SAMPLES


def _pair_code(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(v * np.uint64(0x9E3779B97F4A7C15) + mixed(w))


def _rng(sweep: int, *columns: np.ndarray) -> np.random.Generator:
    """The same rows get the same draws when a task is repeated."""
    return np.random.default_rng([sweep, *(int(np.bitwise_xor.reduce(mixed(x.astype(np.uint64)))) for x in columns)])


def _seat_narrow(v: np.ndarray, w: np.ndarray, c: np.ndarray, h: np.ndarray, burn_in: int = BURN_IN,
                 samples: int = SAMPLES) -> np.ndarray:
    """Whole chains of some restaurants, whose rows come ordered by restaurant: the tables of all samples together."""
    at = _starts(v)
    which = np.repeat(np.arange(len(at)), _runs(at, len(v)))
    rng, total = _rng(0, v, w, c), np.zeros(len(v), np.int64)
    many = np.flatnonzero(c > 1)  # who comes alone has a table
    own, customers, share, tables = which[many], c[many], h[many], np.ones(len(many), np.int64)
    total += samples
    for sweep in range(MOVES + burn_in + samples):
        mass = draw_mass(_runs(at, len(v)) + np.bincount(own, tables - 1, len(at)), rng)
        tables = draw(customers, mass[own] * share, rng)
        if sweep >= MOVES + burn_in:
            total[many] += tables - 1
    return total


def _seat_wide(pairs: DataFrame, model: Model, shared: Shared, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(bucket, seated) of the restaurants whose rows are dealt over many tasks: given its mass, a restaurant's dishes
    are independent."""
    sc, places = pairs.sparkSession.sparkContext, len(model.wide)
    rest = pairs.where("open IS NOT NULL").select("bucket", "open")

    def step(kept: list[np.ndarray], seed: int) -> np.ndarray:
        masses = sc.broadcast(kept)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(places)
            for batch in batches:
                for block in batch.column("open"):
                    at, t, _ = _drawn(shared.value, block.as_py(), masses.value, seed)
                    sums += np.bincount(at, t, places)
            yield pa.record_batch({"v": np.flatnonzero(sums), "t": sums[sums > 0]})

        found = rest.mapInArrow(run, "v long, t double").groupBy("v").agg(F.sum("t").alias("t")).toArrow()
        masses.unpersist()
        tables = np.zeros(places)
        tables[found.column("v").to_numpy()] = found.column("t").to_numpy()
        return tables

    rng, masses, sweeps = np.random.default_rng(0), [], MOVES + burn_in + samples
    if places:
        tables = step([], 0)
        for sweep in range(sweeps):
            masses.append(draw_mass(tables, rng))
            if sweep + 1 < sweeps:
                tables = step(masses[-1:], sweep)
    last = sc.broadcast(masses[-samples:])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in batch.column("open"):
                _, t, (*words, c, _) = _drawn(shared.value, block.as_py(), last.value, sweeps)
                out.append(_pack(*words, c, t.astype(np.uint64)))
            yield pa.record_batch({"bucket": batch.column("bucket"), "seated": pa.array(out, pa.binary())})

    return stored(rest.mapInArrow(whole, "bucket int, seated binary"), "lm-wide")


def _drawn(m: Model, block: bytes, masses: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Restaurants of the pairs of a block, tables of all the given samples together (one each without any), and the columns."""
    others, v, nv, w, c, h = columns = _unpack(block, OPEN)
    at, c = np.repeat(np.searchsorted(m.wide, _codes(m, others, v)), nv), c.astype(np.int64)
    rng, many = _rng(seed, v, w, c), np.flatnonzero(c > 1)
    t = np.full(len(c), max(1, len(masses)), np.int64)
    for mass in masses:
        t[many] += draw(c[many], mass[at[many]] * h[many], rng) - 1
    return at, t, columns


PAIRS = "v long, w long, c long, t double"


def _listed(seated: DataFrame, shared: Shared, least: int = 0) -> DataFrame:
    """(v, w, c, t): customers of each dish and the mean number of their tables, of pairs with more than ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("seated"):
                v, w, c, t = _pairs_of(shared.value, block.as_py())
                at = c > least
                yield pa.record_batch({"v": v[at].view(np.int64), "w": w[at].view(np.int64), "c": c[at], "t": t[at]})

    return seated.select("seated").mapInArrow(run, PAIRS)


def seat_pairs(pairs: DataFrame, model: Model, shared: Shared, wide: int) -> None:
    """The model's pairs, seated, and what of them every task knows: totals of wide restaurants and frequent pairs."""
    dealt = _seat_wide(pairs, model, shared)
    if len(model.wide):
        sums = _listed(dealt, shared).groupBy("v").agg(F.sum("c").alias("n"), F.sum("t").alias("tables")).toArrow()
        at = np.searchsorted(model.wide, sums.column("v").to_numpy().view(np.uint64))
        for k, name in enumerate(("n", "tables")):
            model.totals[k, at] = sums.column(name).to_numpy()
        often = _listed(dealt, shared, wide).toArrow()
        codes = _pair_code(*(often.column(k).to_numpy().view(np.uint64) for k in ("v", "w")))
        order = np.argsort(codes)
        model.often = codes[order]
        model.often_seated = np.stack([often.column(k).to_numpy()[order].astype(float) for k in ("c", "t")])
    model.seated = pairs.where("seated IS NOT NULL").select("bucket", "seated").unionByName(dealt)
    model.pairs = _listed(model.seated, shared)
    model.restaurants = model.pairs.groupBy("v").agg(F.sum("c").alias("n"), F.sum("t").alias("tables"))


# --- scores --------------------------------------------------------------------------------------------------


@dataclass
class Model:
    known: Corpus
    served: Menu
    log_dish: np.ndarray
    rare_tokens: int
    rare_types: int
    buckets: int = BUCKETS
    # Words whose restaurants are dealt over all buckets, with customers and tables; pairs that all tasks know.
    wide: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    totals: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    often: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    often_seated: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    shared: Shared | None = None
    seated: DataFrame | None = None
    pairs: DataFrame | None = None
    restaurants: DataFrame | None = None

    def __getstate__(self) -> dict:
        # Frames stay on the driver, and each task makes its own tables of places.
        kept = {k: x for k, x in self.__dict__.items() if k not in ("_wide", "_known")}
        return kept | {"shared": None, "seated": None, "pairs": None, "restaurants": None}

    def is_wide(self, codes: np.ndarray) -> np.ndarray:
        return self._wide.of(codes)[1]

    @cached_property
    def _wide(self) -> Places:
        return Places(self.wide)

    @cached_property
    def _known(self) -> Places:
        return Places(self.known.codes)

    def deal(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Bucket of each pair: that of the word before, or of the pair where the restaurant is wide."""
        spread = np.where(self.is_wide(v), _pair_code(v, w), mixed(v))
        return (spread % np.uint64(self.buckets)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int32)

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words in the cache, and whether they are there."""
        return self._known.of(codes)

    def log_rare(self, c: np.ndarray) -> np.ndarray:
        """log10 probability of a word outside the menu, given that it is one."""
        d, mass = self.known.rare_discount, STRENGTH + self.rare_tokens
        return np.log10(np.where(c > 0, c - d, STRENGTH + d * self.rare_types) / mass)

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.known.tokens + 0.5 * (self.known.types + 1)))


def fit(texts: DataFrame, text: str = "text", dishes: int = DISHES, cached: int = CACHED,
        wide: int = WIDE) -> tuple[Model, DataFrame]:
    """The model of all rows of ``texts``, and the counts of all words."""
    texts = texts.select(F.col(text).alias("text"))
    counts = count_words(texts)
    known = corpus(counts, cached)
    served = menu(known, dishes)
    on_menu = np.isin(known.codes, served.codes)
    # An end that is rarer than the cache is still on the menu; its count is the number of documents.
    n_menu, types_menu = int(known.counts[on_menu].sum()), len(served.codes)
    if known.tokens and END not in known.codes:
        n_menu += counts.where(F.col("h") == int(END)).first()["c"]
    model = Model(known, served, np.zeros((CONTEXTS, 1), np.float32), known.tokens - n_menu, known.types - types_menu)
    model.buckets = max(BUCKETS, -(-known.tokens // BUCKET))
    # A word is as often a context as it occurs, the start as often as the end.
    often = counts.where(F.col("c") > wide).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    model.wide = np.unique(np.where(often == END, START, often))
    model.totals = np.zeros((2, len(model.wide)))
    shared = Shared(texts.sparkSession.sparkContext).also(model=model)
    contexts, lost = count_contexts(texts, served.rare + 1, shared)
    if known.tokens:
        model.log_dish = np.log10(average_predictive(contexts, served.rare + 1)).astype(np.float32)
        shared = shared.also(log_dish=model.log_dish)
    seat_pairs(count_pairs(texts, lost, model, counts, shared), model, shared, wide)
    model.shared = shared.also(totals=model.totals, often=model.often, often_seated=model.often_seated)
    return model, counts


OWN = "n_tokens long, n_known long, base double, near double"


# A block of a chunk, a document at a place of it, or a token outside the cache: the word, times how often it occurs.
BEFORE = ("block", "chunk", "at", "w", "times", "own", "share")


def _fields(id_type: pa.DataType, *before: str) -> pa.Schema:
    """Fields of the rows between the steps of ``score``."""
    kinds = {"bucket": pa.int32(), "block": pa.binary(), "id": id_type} | {k: pa.float64() for k in ("base", "near", "own", "share")}
    names = [*before, "id", *(x.split()[0] for x in OWN.split(", "))]
    return pa.schema([(k, kinds.get(k, pa.int64())) for k in names])


def _filled(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in schema}, schema)


def _score(shared: Shared, ident: str, text: str):
    """Rows of documents with what is known without their pairs, and blocks of the pairs of a chunk of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        task = TaskContext.get().partitionId()
        chunk = task << 32
        for codes, first, docs in _chunks(batches, text):
            known, v, w, x, lost = _read(m, codes, first)
            n = docs.num_rows
            of = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
            hit, ask, near = w < len(m.known.codes), np.ones(len(w), bool), np.zeros(n)
            base = np.bincount(of[hit], m.log_base(m.known.counts[w[hit]]), n)
            if len(m.often):
                before = known.codes(v)
                some = np.flatnonzero(~lost & m.is_wide(before))
                place, there = _among(m.often, _pair_code(before[some], codes[some]))
                some, place = some[there], place[there]
                wide, _ = _among(m.wide, before[some])
                p = _probability(*m.often_seated[:, place], *m.totals[:, wide], known.parent(w[some], np.arange(len(some)), x[some]))
                near = np.bincount(of[some], np.log10(p), n)
                ask[some] = False
            ids = docs.column(ident).combine_chunks()
            schema = _fields(ids.type, "bucket", *BEFORE)
            yield _filled(
                schema, n, bucket=np.full(n, (task + chunk) % m.buckets, np.int32), chunk=np.full(n, chunk), at=np.arange(n), id=ids,
                n_tokens=np.diff(first), n_known=np.bincount(of[hit], minlength=n),
                base=base, near=near,
            )
            (v, w, x, of), times = _distinct(v[ask], w[ask], x[ask], of[ask])
            rows = _bucket_rows(_asked(m, known, v, w, x, times, doc=of))
            yield _filled(schema, len(rows), bucket=rows.column("bucket"), block=rows.column("block"), chunk=np.full(len(rows), chunk))
            chunk += 1

    return run


class Shared:
    """What tasks know of the model: each part is broadcast once, when it is known."""

    def __init__(self, context: SparkContext, parts: tuple = ()):
        self.context, self.parts = context, parts

    def also(self, **fields) -> Shared:
        return Shared(self.context, (*self.parts, self.context.broadcast(fields)))

    def __getstate__(self) -> dict:
        return {"context": None, "parts": self.parts}

    @property
    def value(self) -> Model:
        m = self.parts[0].value["model"]
        for part in self.parts[1:]:
            m.__dict__.update(part.value)
        return m


def _probability(c: np.ndarray, t: np.ndarray, n: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    return (c - DISCOUNT * t + (STRENGTH + DISCOUNT * tables) * parent) / (STRENGTH + n)


SUMS = (np.uint32, np.float64)


def _answer(shared: Shared):
    """Sums of log10 probabilities by document, in a block for each chunk.  A token outside the cache is a row of its own:
    the probability is ``own`` and, times the probability of the word among rarer ones, ``share``."""

    def run(asked: pa.Table, seated: pa.Table) -> pa.Table:
        m: Model = shared.value
        there, schema = asked.column("block").is_valid(), _fields(asked.schema.field("id").type, *BEFORE)
        docs, asked = asked.filter(asked.column("block").is_null()), asked.filter(there)
        held = [_unpack(b.as_py(), SEATED) for b in seated.column("seated")]
        found = [_unpack(b.as_py(), ASKED, 2) for b in asked.column("block")]
        known = Bucket.of(m, [b[0] for b in [*found, *held]], [*(b[1] for b in found), *(np.zeros(len(b[0])) for b in held)])
        key, c, t = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        if held:
            key = np.concatenate([(np.repeat(known.numbers(v, o), nv) << 32) | known.numbers(w, o) for o, v, nv, w, _, _ in held])
            c, t = (np.concatenate([h[k] for h in held]).astype(float) for k in (4, 5))
            held, order = None, np.argsort(key)
            key, c, t = key[order], c[order], t[order] / SAMPLES
        at = _starts(key >> 32)
        own = key[at] >> 32
        totals = np.add.reduceat(np.stack([c, t]), at, axis=1) if len(at) else np.zeros((2, 0))
        place, wide = m._wide.of(known.codes(own))
        totals[:, wide] = m.totals[:, place[wide]]
        c, t, totals = np.r_[c, 0.0], np.r_[t, 0.0], np.c_[totals, np.zeros(2)]
        chunks, blocks, rows = [], [], []
        for chunk, block in zip(asked.column("chunk"), asked.column("block"), strict=True):
            codes, _, v, nv, w, nw, x, times, doc = _unpack(block.as_py(), ASKED)
            v, w, of = known.numbers(v, codes), known.numbers(w, codes), np.repeat(np.arange(len(w)), nw)
            restaurant, met = _among(own, v)
            total = totals[:, np.where(met, restaurant, len(own))]
            place, wide = m._wide.of(known.codes(v))
            total[:, wide] = m.totals[:, place[wide]]
            total = np.repeat(total, nv, axis=1)
            pair, met = _among(key, (np.repeat(v, nv) << 32) | w)
            pair = np.where(met, pair, len(key))
            own_ = (c[pair] - DISCOUNT * t[pair]) / (STRENGTH + total[0])
            share, chunk = (STRENGTH + DISCOUNT * total[1]) / (STRENGTH + total[0]), chunk.as_py()
            lost = ((w >= len(m.known.codes)) & (known.codes(w) != END))[of]
            logs = np.log10(own_[of] + share[of] * known.parent(w, of, x)) * times
            logs[lost] = 0
            chunks.append(chunk)
            docs_ = np.flatnonzero(np.bincount(doc))
            blocks.append(_pack(docs_.astype(np.uint32), np.bincount(doc, logs)[docs_]))
            if lost.any():
                of = of[lost]
                rare = 10.0 ** m.log_dish[x[lost], m.served.rare].astype(float)
                rows.append(_filled(
                    schema, len(of), chunk=np.full(len(of), chunk), at=doc[lost].astype(np.int64), w=known.codes(w)[of].view(np.int64),
                    times=times[lost].astype(np.int64), own=own_[of], share=share[of] * rare,
                ))
        rows.append(_filled(schema, len(chunks), chunk=pa.array(chunks, pa.int64()), block=pa.array(blocks, pa.binary())))
        return pa.concat_tables([docs.select(schema.names).cast(schema), pa.Table.from_batches(rows)])

    return run


def _whole(table: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums of all buckets."""
    docs = table.filter(table.column("block").is_null())
    at = docs.column("at").to_numpy()
    score = np.zeros(int(at.max()) + 1)
    for block in table.filter(table.column("block").is_valid()).column("block"):
        places, s = _unpack(block.as_py(), SUMS)
        score[places] += s
    docs = docs.set_column(docs.column_names.index("near"), "near", pa.array(docs.column("near").to_numpy() + score[at]))
    return docs.select(["chunk", "at", *_fields(docs.schema.field("id").type).names])


def score(docs: DataFrame, model: Model, counts: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every document."""
    own = f"id {docs.schema[ident].dataType.simpleString()}, {OWN}"
    answers = f"block binary, chunk long, at long, w long, times long, own double, share double, {own}"
    shared = model.shared
    asked = docs.select(ident, text).mapInArrow(_score(shared, ident, text), f"bucket int, {answers}")
    # Every token meets the restaurant of the word before it.
    met = asked.groupBy("bucket").cogroup(model.seated.groupBy("bucket")).applyInArrow(_answer(shared), answers)
    met = stored(met, "lm-answers")
    whole = met.where("w IS NULL").groupBy("chunk").applyInArrow(_whole, f"chunk long, at long, {own}")
    # Words outside the cache meet the table of counts; only their sums come back to the documents.
    lost = _with_rare(met.where("w IS NOT NULL").select("chunk", "at", "w", "times", "own", "share"), model, counts)
    c, mass = F.col("c"), STRENGTH + model.rare_tokens
    among = F.when(c > 0, c - model.known.rare_discount).otherwise(STRENGTH + model.known.rare_discount * model.rare_types) / mass
    base = F.log10((c + 0.5) / (model.known.tokens + 0.5 * (model.known.types + 1)))
    more = lost.groupBy(F.col("chunk").alias("chunk2"), F.col("at").alias("at2")).agg(
        F.sum(F.when(c > 0, F.col("times"))).alias("k"),
        F.sum(F.col("times") * base).alias("b"),
        F.sum(F.col("times") * F.log10(F.col("own") + F.col("share") * among)).alias("s"),
    )
    return whole.join(more, (F.col("chunk") == F.col("chunk2")) & (F.col("at") == F.col("at2")), "left").select(
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("near") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """One row: perplexity per token over all scored documents."""
    return scored.agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
