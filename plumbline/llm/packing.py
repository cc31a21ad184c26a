"""Packing by concatenate and cut.

All documents, each followed by an end id, form one long sequence in partition order; windows of ``capacity`` tokens of
it are the training sequences, so only the very last one can be short.  Pass one tokenises every document once, counts
the tokens before it inside its partition, and stores ids and counts as Parquet.  The totals per partition (one number
per partition) give the global offset of each partition by a prefix sum.  Pass two reads the stored ids and cuts them
at the window borders.  Nothing is shuffled, and a lost executor costs only its own partitions.

Defined results: null and empty texts are a document of the end id alone; a document of any length may span sequences;
repeated documents are packed as often as they occur; extra columns are not looked at; an empty table gives no piece.

Words repeat, so every Python worker remembers the ids of ``MEMO_WORDS`` units in arrays of fixed size: a run of letters
without the punctuation around it, that punctuation, or a word of any other make.  A unit has one place, found by a hash
and taken by the unit seen last; its bytes are kept and compared, so no two units are mixed up.  Longer units and those
of many ids are encoded once per slice.  ``by_word`` may only be set for a tokenizer that splits at ASCII white space,
drops it, lower-cases, and separates runs of letters from other characters, as ``word_bpe_49k.json`` does; otherwise
whole texts are encoded.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text_blocks import LOWER, mixed, row_slices, split_words, stored

CAPACITY = 2048
END_ID = 1
MEMO_WORDS = 1 << 19
UNIT_BYTES, UNIT_IDS = 24, 8
# Letters that no normal form changes: ASCII, and U+00C0 to U+00FF but for the two signs among them (C3 80 to C3 BF).
_ASCII_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_LATIN_TAIL = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_LATIN_UPPER = np.array([0x80 <= b <= 0x9E and b != 0x97 for b in range(256)])
# ASCII characters other than white space, the apostrophe, control characters and letters.
_EDGE = np.array([0x20 < b < 0x7F and b != 0x27 for b in range(256)]) & ~_ASCII_LETTER
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Memo:
    """Ids of short units by their bytes: one place per hash, the unit seen last keeps it."""

    def __init__(self, places: int):
        self.places = places
        self.keys = np.zeros((places, UNIT_BYTES // 8), np.uint64)
        self.sizes = np.zeros(places, np.uint8)  # 0 for a free place, since no unit is empty
        self.ids = np.zeros((places, UNIT_IDS), "<u4")
        self.counts = np.zeros(places, np.uint8)

    def place(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = sizes.astype(np.uint64)
        for column in keys.T:
            h = mixed(h ^ column)
        return (h % np.uint64(self.places)).astype(np.int64)


def _keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of units of at most ``UNIT_BYTES``, as numbers."""
    padded = np.concatenate([data, np.zeros(UNIT_BYTES, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    columns = []
    for at in range(0, UNIT_BYTES, 8):
        column = np.zeros(len(start), np.uint64)
        row = np.flatnonzero(size > at)
        column[row] = eights[start[row] + at] & _LOW_BYTES[np.minimum(size[row] - at, 8)]
        columns.append(column)
    return np.stack(columns, axis=1)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start, end, is-a-run-of-letters and document of the units of a slice, in order.

    A word that is one run of letters between edges gives up to three units, and the run is in lower case; any other
    word is one unit as it stands.
    """
    words = split_words(data, offsets)
    n = len(data)
    lead = (data == 0xC3) & np.append(_LATIN_TAIL[data[1:]], False)
    tail = np.append(False, lead[:-1])[:n]
    letter = _ASCII_LETTER[data] | lead | tail
    opens, closes = letter.copy(), letter.copy()
    opens[1:] &= ~letter[:-1]
    closes[:-1] &= ~letter[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]  # texts may touch without white space between them
    opens[heads] = letter[heads]
    closes[heads[1:] - 1] = letter[heads[1:] - 1]
    run_start, run_end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    odd = ~(letter | _EDGE[data])
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # special ids begin with <|
    odds = np.append(0, np.cumsum(odd))
    first = np.searchsorted(run_start, words.start)
    plain = (np.searchsorted(run_start, words.end) - first == 1) & (odds[words.end] == odds[words.start])
    run = first[plain]
    inside = np.zeros(n + 1, np.int8)
    inside[run_start[run]] += 1
    inside[run_end[run]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    lower = np.where(tail & _LATIN_UPPER[data], data + np.uint8(0x20), LOWER[data])
    seen = np.where(inside, lower, data)
    begin = np.stack([words.start, words.start, words.end], axis=1)
    end = np.stack([words.start, words.end, words.end], axis=1)
    begin[plain, 1], end[plain, 0] = run_start[run], run_start[run]
    end[plain, 1], begin[plain, 2] = run_end[run], run_end[run]
    kind = np.zeros(begin.shape, bool)
    kind[plain, 1] = True
    begin, end, kind, doc = begin.ravel(), end.ravel(), kind.ravel(), np.repeat(words.doc, 3)
    filled = end > begin
    return seen, begin[filled], end[filled], kind[filled], doc[filled]


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, encoded word by word."""

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.memo = Memo(MEMO_WORDS if by_word else 1)
        self.letters: dict[int, str] = {}
        if by_word:
            self._learn_letters()

    def _learn_letters(self) -> None:
        """How the tokenizer's model sees a letter, taken from the library; lower-case letters only."""
        letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x100)) if chr(c).isalpha()]
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        for word in [*letters, "word", "".join(letters)]:
            if self._letters(word) != self._whole([word])[0]:
                raise ValueError("by_word does not suit this tokenizer")
        parts = [self._letters("ab"), self._letters("cd"), *self._whole([","]), self._letters("ab")]
        if b"".join(parts) != self._whole(["Ab\tcd, ab"])[0]:
            raise ValueError("by_word does not suit this tokenizer")

    def _letters(self, word: str) -> bytes:
        """A run of lower-case letters needs no normalising or splitting and goes to the model at once."""
        seen = word if word.isascii() else word.translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()

    def _whole(self, parts: list[str]) -> list[bytes]:
        """Encode units together, apart by blanks, and give each its ids."""
        if not parts:
            return []
        found = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        begins = np.cumsum([0, *(len(u) + 1 for u in parts)])
        cuts = np.searchsorted(np.fromiter((a for a, _ in found.offsets), np.int64, len(ids)), begins)
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _learn(self, parts: list[tuple[bytes, bool]]) -> list[bytes]:
        """Ids of units, each with whether it is a run of letters."""
        others = iter(self._whole([u.decode() for u, letters in parts if not letters]))
        return [self._letters(u.decode()) if letters else next(others) for u, letters in parts]

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and where each document's begin."""
        if self.memo.places != MEMO_WORDS:
            self.memo = Memo(MEMO_WORDS)
        memo = self.memo
        seen, begin, end, kind, doc = units(data, offsets)
        size = end - begin
        short = np.flatnonzero(size <= UNIT_BYTES)
        keys, sizes = _keys(seen, begin[short], size[short]), size[short].astype(np.uint8)
        place = memo.place(keys, sizes)
        known = (memo.sizes[place] == sizes) & (memo.keys[place] == keys).all(axis=1)
        hit, at = short[known], place[known]
        counts = np.zeros(len(begin), np.int64)
        counts[hit] = memo.counts[at]
        # Units of this slice that are not remembered, each once.
        order: dict[tuple[bytes, bool], int] = {}
        text, new = seen.tobytes(), np.ones(len(begin), bool)
        new[hit] = False
        new = np.flatnonzero(new)
        which = np.array([order.setdefault((text[a:b], k), len(order)) for a, b, k in
                          zip(begin[new].tolist(), end[new].tolist(), kind[new].tolist(), strict=True)], np.int64)
        learnt = self._learn(list(order))
        lengths = np.fromiter(map(len, learnt), np.int64, len(learnt)) // 4
        flat = np.frombuffer(b"".join(learnt), "<u4")
        base = np.cumsum(lengths) - lengths
        counts[new] = lengths[which]
        to = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), "<u4")
        for k in range(UNIT_IDS):
            more = memo.counts[at] > k
            hit, at = hit[more], at[more]
            out[to[hit] + k] = memo.ids[at, k]
        many = counts[new]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(to[new], many) + step] = flat[np.repeat(base[which], many) + step]
        self._remember(short[~known], keys[~known], sizes[~known], place[~known], new, which, flat, base, lengths)
        filled = np.append(0, np.cumsum(np.bincount(doc, counts, minlength=len(offsets) - 1).astype(np.int64)))
        return out, filled

    def _remember(self, row: np.ndarray, keys: np.ndarray, sizes: np.ndarray, place: np.ndarray, new: np.ndarray,
                  which: np.ndarray, flat: np.ndarray, base: np.ndarray, lengths: np.ndarray) -> None:
        """Give each learnt unit with few ids its place; of several with one place the last one wins, whole."""
        mine = which[np.searchsorted(new, row)]
        _, last = np.unique(place[::-1], return_index=True)
        chosen = len(place) - 1 - last
        chosen = chosen[lengths[mine[chosen]] <= UNIT_IDS]
        mine, place, memo = mine[chosen], place[chosen], self.memo
        memo.keys[place], memo.sizes[place], memo.counts[place] = keys[chosen], sizes[chosen], lengths[mine]
        for k in range(UNIT_IDS):
            more = lengths[mine] > k
            memo.ids[place[more], k] = flat[base[mine[more]] + k]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            found = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]
        offsets = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
        ids, cuts = self._ids(np.frombuffer(b"".join(texts), np.uint8), offsets)
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_ENCODERS: dict[tuple[str, bool], WordIds] = {}


def encoder(path: str, by_word: bool) -> WordIds:
    """One encoder per Python worker, so later tasks find the words of earlier ones."""
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = WordIds(path, by_word)
    return _ENCODERS[path, by_word]


def tokenised(docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", by_word: bool = False,
              end_id: int = END_ID) -> DataFrame:
    """(id, part, before, tokens, ids): ids with the end id, and the tokens before the document in its partition."""
    id_type = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, part = encoder(tokenizer, by_word), 0, TaskContext.get().partitionId()
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for rows in row_slices(batch, text):
                ids = [x + end for x in encode([t or b"" for t in rows.column(text).cast(pa.binary()).to_pylist()])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.record_batch({
                    "id": rows.column(ident),
                    "part": pa.array(np.full(len(n), part, np.int64)),
                    "before": pa.array(before + np.cumsum(n) - n),
                    "tokens": pa.array(n),
                    "ids": pa.array(ids, pa.binary()),
                })
                before += int(n.sum())

    return docs.select(ident, text).mapInArrow(run, f"id {id_type}, part long, before long, tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", by_word: bool = False,
         end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Boundary records with their ids: (id, start, length, doc_tokens, sequence_id, offset, ids)."""
    table = stored(tokenised(docs, tokenizer, ident, text, by_word, end_id), "packing-ids")
    totals = table.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    base, total = {}, 0
    for r in totals:
        base[r["part"]] = total
        total += r["n"]
    offsets = docs.sparkSession.sparkContext.broadcast(base)
    id_type = docs.schema[ident].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array(batch.column("tokens"), np.int64)
            at = np.array([offsets.value[p] for p in batch.column("part").to_pylist()], np.int64)
            at += np.array(batch.column("before"), np.int64)
            first, last = at // capacity, (at + n - 1) // capacity
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(sequence * capacity, at[row])
            end = np.minimum((sequence + 1) * capacity, (at + n)[row])
            ids = batch.column("ids")
            a, b = (4 * (start - at[row])).tolist(), (4 * (end - at[row])).tolist()
            content = [ids[r].as_buffer()[x:y].to_pybytes() for r, x, y in zip(row.tolist(), a, b, strict=True)]
            yield pa.record_batch({
                "id": batch.column("id").take(pa.array(row)),
                "start": pa.array(start - at[row]),
                "length": pa.array(end - start),
                "doc_tokens": pa.array(n[row]),
                "sequence_id": pa.array(sequence),
                "offset": pa.array(start - sequence * capacity),
                "ids": pa.array(content, pa.binary()),
            })

    schema = f"id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return table.mapInArrow(cut, schema)


def with_checksum(pieces: DataFrame, ids: str = "ids") -> DataFrame:
    """``pieces`` with ids_crc32, the unsigned CRC of the little-endian 32-bit ids, in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32(ids)).drop(ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): each training sequence with its boundary records, at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "id", "start", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    return grouped.select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x.dropFields("ids")).alias("documents"),
    )


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
