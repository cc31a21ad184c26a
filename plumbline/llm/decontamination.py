"""Benchmark decontamination: a broadcast set of normalised benchmark windows, scanned over all documents.

Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes.  A window is ``width`` consecutive words of
an item; an item with fewer words, but at least one, is one window.  Every window of every document is looked up by
its hash, and each hit is verified on the words themselves.

Defined results: a null or empty text has no words and is clean; an item without words has no window; an item without
id marks words but is not named; repeated items and ids count once; repeated documents are judged one by one; columns
of the documents may have any names; an empty benchmark leaves all documents clean.

The benchmark is broadcast in blocks of about ``block_bytes`` of item text, measured first.  Each block is one more
map over the documents in the same stage, so a benchmark of any size is scanned whole, no shuffle is needed, and no
task holds more than its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.text_blocks import (
    ALNUM, Rolling, Words, appended, fresh, row_slices, split_words, text_bytes, with_fields, word_hashes,
)

WIDTH = 13
BLOCK_BYTES = 8 << 20
MIN_SHARE = 20  # contaminated from one twentieth of the words on
SEEN = 50_000  # verified stretches remembered by a task
_BUILT: dict[int, WindowSet] = {}


class WindowSet:
    """Windows of some items, sorted by hash, with the bytes of their words for verification, in flat arrays."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.names = [name for name, _ in items]
        data, start, end, item = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        hashes, firsts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        n_bytes = n_words = n_items = 0
        for part in row_slices(pa.record_batch({"t": pa.array([t for _, t in items], pa.string())}), "t"):
            words = split_words(*text_bytes(part, "t"), ALNUM)
            count = np.diff(words.first)
            size = np.minimum(width, count)
            windows = np.where(size > 0, count - size + 1, 0)
            of = np.repeat(np.arange(len(count)), windows)
            s = words.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
            hashes.append(Rolling(word_hashes(words)).of(s, s + size[of]))
            firsts.append((s + n_words).astype(np.int32))
            sizes.append(size[of].astype(np.int32))
            data.append(words.data)
            start.append(words.start + n_bytes)
            end.append(words.end + n_bytes)
            item.append((words.doc + n_items).astype(np.int32))
            n_bytes, n_words, n_items = n_bytes + len(words.data), n_words + len(words), n_items + part.num_rows
        self.words = Words(*(np.concatenate(x) for x in (data, start, end, item)), first=np.zeros(0, np.int64))
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.hashes, self.first, self.size = every[order], np.concatenate(firsts)[order], np.concatenate(sizes)[order]
        self.lengths = np.unique(self.size).tolist()
        # A table in front of the sorted hashes answers most lookups.
        self.bits = np.zeros(1 << max(16, int(np.ceil(np.log2(len(self.hashes) + 1))) + 3), bool)
        self.mask = np.uint64(len(self.bits) - 1)
        self.bits[self.hashes & self.mask] = True
        self.seen: dict[tuple[int, bytes], set[str] | None] = {}

    def likely(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are those of a window."""
        out = self.bits[hashes & self.mask]
        asked = hashes[out]
        if len(asked):
            out[out] = self.hashes[np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)] == asked
        return out

    def verified(self, words: Words, s: int, n: int, code: int, stretch: bytes) -> set[str] | None:
        """Items of the window at word ``s``, if its words are those of a window; remembered by the very bytes."""
        if (n, stretch) not in self.seen:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            content, found = [words.text(i) for i in range(s, s + n)], None
            low, high = (int(np.searchsorted(self.hashes, np.uint64(code), side)) for side in ("left", "right"))
            for k in range(low, high):
                at = int(self.first[k])
                if self.size[k] == n and all(self.words.text(at + i) == content[i] for i in range(n)):
                    found = set() if found is None else found
                    name = self.names[self.words.doc[at]]
                    found.update([name] if name is not None else [])
            self.seen[n, stretch] = found
        return self.seen[n, stretch]

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, items) of each verified window."""
        rolling, raw = Rolling(word_hashes(words)), words.data.tobytes()
        for n in self.lengths:
            starts = np.arange(max(0, len(words) - n + 1))
            starts = starts[words.doc[starts] == words.doc[starts + n - 1]] if len(starts) else starts
            hashes = rolling.of(starts, starts + n)
            likely = self.likely(hashes)
            starts, hashes = starts[likely], hashes[likely]
            froms, tos = words.start[starts].tolist(), words.end[starts + n - 1].tolist()
            for s, h, a, b in zip(starts.tolist(), hashes.tolist(), froms, tos, strict=True):
                items = self.verified(words, s, n, h, raw[a:b])
                if items is not None:
                    yield s, n, items


def _scan(block: Broadcast, key: int, width: int, text: str, names: tuple[str, str, str]):
    n_name, at_name, item_name = names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = WindowSet(block.value, width)
        windows = _BUILT[key]
        for batch in batches:
            for part in row_slices(batch, text):
                words = split_words(*text_bytes(part, text), ALNUM)
                marked = np.zeros(len(words) + 1, np.int32)
                items: dict[int, set[str]] = {}
                for s, n, found in windows.hits(words):
                    marked[s] += 1
                    marked[s + n] -= 1
                    items.setdefault(int(words.doc[s]), set()).update(found)
                hit = np.flatnonzero(np.cumsum(marked[:-1]) > 0)
                place = hit - words.first[words.doc[hit]]
                ends = np.searchsorted(words.doc[hit], np.arange(part.num_rows + 1))
                at: list[list[int] | None] = [None] * part.num_rows
                for k in np.unique(words.doc[hit]).tolist():
                    at[k] = place[ends[k] : ends[k + 1]].tolist()
                named = [sorted(items[k]) if k in items else None for k in range(part.num_rows)]
                if n_name in part.schema.names:  # a later block adds to the marks of the blocks before it
                    old_at, old_items = part.column(at_name).to_pylist(), part.column(item_name).to_pylist()
                    at = [sorted({*(x or []), *(y or [])}) for x, y in zip(old_at, at, strict=True)]
                    named = [sorted({*(x or []), *(y or [])}) for x, y in zip(old_items, named, strict=True)]
                    part = part.drop_columns([n_name, at_name, item_name])
                yield appended(part, {
                    n_name: pa.array(np.diff(words.first), pa.int64()),
                    at_name: pa.array([x or [] for x in at], pa.list_(pa.int32())),
                    item_name: pa.array([x or [] for x in named], pa.list_(pa.string())),
                })

    return scan


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` plus three columns, whose names come second: words, positions of the hit words, ids of the items."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    names = tuple(fresh(docs, x) for x in ("bench_words", "bench_positions", "bench_items"))
    schema = with_fields(
        docs,
        T.StructField(names[0], T.LongType()),
        T.StructField(names[1], T.ArrayType(T.IntegerType())),
        T.StructField(names[2], T.ArrayType(T.StringType())),
    )
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        block = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in rows])
        docs = docs.mapInArrow(_scan(block, block._jbroadcast.id(), width, text, names), schema)
    return docs, names


def contaminated(n_words, n_hit):
    return (n_hit > 0) & (MIN_SHARE * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words of all documents taken out of their texts.

    With ``remove="spans"`` the remaining text is kept byte for byte; only the hit words themselves go.
    """
    text, columns = options.get("text", "text"), docs.columns
    marked, (n, at, _) = mark(docs, benchmark, **options)
    if remove == "documents":
        return marked.where(~contaminated(F.col(n), F.size(at))).select(*columns)
    if remove != "spans":
        raise ValueError(f"remove must be documents or spans, not {remove!r}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, text):
                data, offsets = text_bytes(part, text)
                words = split_words(data, offsets, ALNUM)
                keep = np.ones(len(data), bool)
                for k, places in enumerate(part.column(at).to_pylist()):
                    for w in places:
                        keep[words.start[words.first[k] + w] : words.end[words.first[k] + w]] = False
                old = part.column(text).to_pylist()
                new = [
                    None if old[k] is None else data[a:b][keep[a:b]].tobytes().decode()
                    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))
                ]
                kept = [pa.array(new, part.schema.field(c).type) if c == text else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays(kept, names=columns)

    return marked.mapInArrow(cut, T.StructType([marked.schema[c] for c in columns]))
