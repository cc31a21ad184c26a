"""Helpers for text columns inside tasks: bounded slices of Arrow batches, word boundaries, word hashes, memo.

Everything here works on one slice of about a megabyte of text (or one longer document), so the memory of a task
does not depend on the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut

SLICE_BYTES = 1 << 20
MEMO_ROWS = 400_000
# Word bytes: everything but ASCII white space, and letters, digits and non-ASCII bytes only.
NOT_SPACE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
ALNUM = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LETTERS = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_RADIX = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


@dataclass
class Words:
    """Words of a slice: byte ranges in ``data``, their documents, and the first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cheap column reads, no lineage to redo.

    The copies go with ``session.release``, once what is made of them has been written.
    """
    return cut(df, name)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo.  A missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, ident: str, text: str, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts and labels (text, y) of about ``per_class`` documents of each class, and all labelled rows by class.

    Ids, classes and hashes of the texts are joined first; the chosen ids, bounded by ``per_class``, are broadcast to
    the texts, so no text is shuffled.  Equal labels of one document count once.
    """
    spread = F.pmod(F.xxhash64(F.lit("sample"), text), F.lit(1_000_000)).alias("spread")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(ident).alias("label_id"), F.col(label).cast("int").alias("y")).distinct()
    slim = docs.select(F.col(ident).alias("id"), spread).join(known, F.col("id") == F.col("label_id"))
    slim = stored(slim.select("id", "spread", "y"), "labelled")
    sizes = {r["y"]: r["n"] for r in slim.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, per_class / sizes.get(1, 1)).otherwise(per_class / sizes.get(0, 1))
    chosen = slim.where(F.col("spread") < 1_000_000 * share).select("id", "y").distinct()
    texts = docs.select(F.col(ident).alias("text_id"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("text_id") == F.col("id")).select("text", "y")
    return stored(sample, "labelled-sample"), sizes


def row_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text; a longer document is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = np.cumsum(lengths)
    at, rows = 0, batch.num_rows
    while at < rows:
        before = filled[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(filled, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_bytes(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; a null is an empty text."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of word bytes that do not cross a document; ASCII letters come out in lower case."""
    inside = table[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[heads] = inside[heads]
    tails = heads[1:] - 1
    closes[tails] = inside[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(LOWER[data], start, end, doc, first)


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, radix: int) -> np.ndarray:
    known = _POWERS.get(radix)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 1), radix, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= 4 * SLICE_BYTES:
            _POWERS[radix] = known
    return known[:n]


class Rolling:
    """Polynomial hashes modulo 2**64 of stretches of a sequence, from prefix sums."""

    def __init__(self, values: np.ndarray):
        self.back = _powers(len(values) + 1, pow(_RADIX, -1, 1 << 64))
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _powers(len(values), _RADIX), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit code per word.  Two different words share one with a chance of about 2**-64."""
    return Rolling(_BYTE_CODES[words.data]).of(words.start, words.end)


class Memo:
    """Results by word, kept between slices.  Beyond ``limit`` words it starts anew; results do not depend on it."""

    def __init__(self, width: int, dtype: type = np.float32, limit: int = MEMO_ROWS):
        self.limit, self.keys = limit, np.zeros(0, np.uint64)
        self.rows = np.zeros((0, width), dtype)

    def lookup(self, hashes: np.ndarray, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """One row per hash.  ``compute`` gets one index for each hash that is new."""
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.zeros((len(keys), self.rows.shape[1]), self.rows.dtype)
        out[known] = self.rows[at[known]]
        if not known.all():
            out[~known] = compute(where[~known])
            if len(self.keys) + (~known).sum() > self.limit:
                self.keys, self.rows = keys, out
            else:
                every = np.concatenate([self.keys, keys[~known]])
                order = np.argsort(every)
                self.keys, self.rows = every[order], np.concatenate([self.rows, out[~known]])[order]
        return out[inverse]


def per_document(words: Words, values: np.ndarray) -> np.ndarray:
    """Sums of word values by document."""
    if values.ndim == 1:
        return np.bincount(words.doc, values, minlength=len(words.first) - 1)
    return np.stack([np.bincount(words.doc, v, minlength=len(words.first) - 1) for v in values.T], axis=1)


def with_fields(df: DataFrame, *added: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *added])


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])
