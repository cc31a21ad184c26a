"""Text measures of many texts at once: what the patterns of ``text`` count, from character classes.

A text that is searched once per pattern costs microseconds per character.  Here the texts of a slice are one array of
code points; runs of a class begin and end where a lookup changes, and sums by text are bin counts.  A slice is about a
million bytes (or one longer text), so memory does not depend on the batch.  Classes come from Python's Unicode tables.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from plumbline.config import BE_FORMS, FUNCTION_WORDS, IRREGULAR_PARTICIPLES, VAGUE_TERMS, VOWELS, WEAK_MODALS

SLICE_BYTES = 1 << 20
# Classes as bits: letter, letter or digit or underscore, vowel, white space as in ``text.SPACE``, Java's ``\s``, a-z.
LETTER, WORD, VOWEL, BLANK, GAP, LOW, UNKNOWN = 1, 2, 4, 8, 16, 32, 128
_LAST_LINE_ENDS = [0x85, 0x2028, 0x2029]
_CLASSES = np.full(0x110000, UNKNOWN, np.uint8)


def _class_of(ch: str) -> int:
    kind = unicodedata.category(ch)
    spaced = kind[0] == "Z" or ch in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85"
    return (
        LETTER * (kind[0] == "L") | WORD * (kind[0] in "LN" or ch == "_") | VOWEL * (ch in VOWELS) | BLANK * spaced
        | GAP * (ch in " \t\n\x0b\f\r") | LOW * ("a" <= ch <= "z")
    )


def classes(codes: np.ndarray) -> np.ndarray:
    """Class bits of code points; a character is looked up when it is seen first."""
    found = _CLASSES[codes]
    new = codes[found == UNKNOWN]
    if len(new):
        for c in np.unique(new).tolist():
            _CLASSES[c] = _class_of(chr(c))
        found = _CLASSES[codes]
    return found


@dataclass
class Texts:
    """Code points of several texts, one after the other; text i is ``offsets[i]`` to ``offsets[i + 1]``."""

    codes: np.ndarray
    offsets: np.ndarray

    def __post_init__(self) -> None:
        self.kinds = classes(self.codes)
        self.begins = self.offsets[:-1][self.offsets[:-1] < len(self.codes)]

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest stretches of ``member`` inside a text."""
        starts, ends = member.copy(), member.copy()
        starts[1:] &= ~member[:-1]
        ends[:-1] &= ~member[1:]
        starts[self.begins] = member[self.begins]
        last = self.begins[self.begins > 0] - 1
        ends[last] = member[last]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def pinned(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where a look-behind first lets a word begin that ends with its run: Java's takes a character beyond U+FFFF for
        no letter, so a word may begin after one."""
        beyond = self.codes > 0xFFFF
        if not beyond.any() or not len(starts):
            return starts
        after = np.r_[0, np.maximum.accumulate(np.where(beyond, np.arange(1, len(beyond) + 1), 0))]
        return np.maximum(starts, after[ends - 1])

    def count(self, places: np.ndarray) -> np.ndarray:
        """Places in each text; places ascend."""
        return np.diff(np.searchsorted(places, self.offsets))

    def of(self, places: np.ndarray) -> np.ndarray:
        """The text of each place."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.count(places))


def slices(texts: pa.Array) -> Iterator[Texts]:
    """Texts of about ``SLICE_BYTES`` at a time; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    filled, at = np.cumsum(lengths), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        strings = texts.slice(at, stop - at).cast(pa.large_binary()).to_pylist()
        decoded = [s.decode("utf-8", "replace") for s in strings]
        codes = np.frombuffer("".join(decoded).encode("utf-32-le"), np.uint32)
        yield Texts(codes, np.cumsum([0, *map(len, decoded)]))
        at = stop


# --- words of a list ----------------------------------------------------------------------------------

FUNCTION, MODAL, VAGUE, BE, DONE, VAGUE_FIRST, VAGUE_SECOND = 1, 2, 4, 8, 16, 32, 64
_COMPOUNDS = [w.split("-") for w in VAGUE_TERMS if "-" in w]
_LISTS = {
    FUNCTION: FUNCTION_WORDS, MODAL: WEAK_MODALS, VAGUE: [w for w in VAGUE_TERMS if "-" not in w], BE: BE_FORMS,
    DONE: IRREGULAR_PARTICIPLES, VAGUE_FIRST: [a for a, _ in _COMPOUNDS], VAGUE_SECOND: [b for _, b in _COMPOUNDS],
}
_LISTED = {w: sum(bit for bit, words in _LISTS.items() if w in words) for words in _LISTS.values() for w in words}
# Letters that one number spells; the few longer words are compared in two numbers.
_SPELLED = 8
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(_SPELLED + 1)], np.uint64)


def _spell(word: str) -> int:
    return int.from_bytes(word.encode("ascii"), "little")


_SHORT = sorted((_spell(w), bits) for w, bits in _LISTED.items() if len(w) <= _SPELLED)
_SHORT_KEYS, _SHORT_BITS = (np.array(x, t) for x, t in zip(zip(*_SHORT), (np.uint64, np.uint8)))
_LONG = [(_spell(w[:_SPELLED]), _spell(w[_SPELLED:]), len(w), bits) for w, bits in _LISTED.items() if len(w) > _SPELLED]


def listed(t: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The lists that have a run as a word, as bits.  Words are ASCII of at most 16 letters."""
    letters = np.zeros(len(t.codes) + 2 * _SPELLED, np.uint8)
    letters[: len(t.codes)] = np.minimum(t.codes, 255)
    eights = np.lib.stride_tricks.sliding_window_view(letters, _SPELLED)

    def keys(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return eights[at].view("<u8").ravel() & _MASKS[np.minimum(lengths, _SPELLED)]

    lengths = ends - starts
    first = keys(starts, lengths)
    place = np.minimum(np.searchsorted(_SHORT_KEYS, first), len(_SHORT_KEYS) - 1)
    found = np.where((lengths <= _SPELLED) & (_SHORT_KEYS[place] == first), _SHORT_BITS[place], 0).astype(np.uint8)
    for head, tail, size, bits in _LONG:
        same = np.flatnonzero((first == head) & (lengths == size))
        found[same[keys(starts[same] + _SPELLED, lengths[same] - _SPELLED) == tail]] = bits
    return found


# --- measures -----------------------------------------------------------------------------------------

MEASURES = ["words", "letter_runs", "syllables", "hard", "tokens", "function_words", "modals", "vague", "sentences", "passive"]


def _has(bits: np.ndarray, bit: int) -> np.ndarray:
    return (bits & bit) != 0


def _ends_in(t: Texts, starts: np.ndarray, ends: np.ndarray, tail: str) -> np.ndarray:
    """Runs of at least one letter more than ``tail``, ending in it."""
    hit = ends - starts > len(tail)
    for i, ch in enumerate(reversed(tail), 1):
        hit &= t.codes[ends - np.minimum(i, ends)] == ord(ch)
    return hit


def _next(flags: np.ndarray) -> np.ndarray:
    """What holds for the run after each; nothing after the last."""
    return np.r_[flags[1:], np.zeros(min(1, len(flags)), flags.dtype)]


def _passive(t: Texts) -> np.ndarray:
    """Places of a form of "to be" followed by a participle, at most an adverb between them, on one line."""
    starts, ends = t.runs(_has(t.kinds, LOW))
    words = listed(t, starts, ends)
    other = np.r_[np.int32(0), np.cumsum(~_has(t.kinds, GAP) | (t.codes == ord("\n")), dtype=np.int32)]
    after, text = _next(starts), t.of(starts)
    spaced = (after > ends) & (other[np.maximum(after, ends)] == other[ends]) & (_next(text) == text)
    done = _next(_ends_in(t, starts, ends, "ed") | _has(words, DONE))
    adverb = _next(_ends_in(t, starts, ends, "ly") & spaced & done)
    return starts[_has(words, BE) & spaced & (done | adverb)]


def _breaks(t: Texts) -> np.ndarray:
    """Characters of sentence breaks: line ends, and marks before white space or the end of the text."""
    starts, ends = t.runs((t.codes == ord(".")) | (t.codes == ord("!")) | (t.codes == ord("?")))
    last = t.offsets[1:][t.of(starts)]
    following = np.minimum(ends, max(len(t.codes) - 1, 0))
    closed = (ends == last) | _has(t.kinds[following], GAP) | ((ends == last - 1) & np.isin(t.codes[following], _LAST_LINE_ENDS))
    edges = np.zeros(len(t.codes) + 1, np.int8)
    edges[starts[closed]] += 1
    edges[ends[closed]] -= 1
    return np.cumsum(edges[:-1], dtype=np.int8).astype(bool) | (t.codes == ord("\n"))


def _stretches(t: Texts, stretch: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of stretches of each text with a place in them."""
    number, text = stretch[places], t.of(places)
    new = np.ones(len(places), bool)
    new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
    return t.count(places[new])


def measure(t: Texts) -> list[np.ndarray]:
    """The ``MEASURES`` of lower-cased texts."""
    blank = _has(t.kinds, BLANK)
    starts, ends = t.runs(_has(t.kinds, LETTER))
    groups, _ = t.runs(_has(t.kinds, VOWEL))
    begun = np.zeros(len(t.codes) + 1, np.int32)
    begun[groups + 1] = 1
    begun = np.cumsum(begun, dtype=np.int32)
    of_run = begun[ends] - begun[starts]
    silent = begun[ends] == begun[t.pinned(starts, ends)]
    tokens, stops = t.runs(_has(t.kinds, WORD))
    pinned = t.pinned(tokens, stops)
    words = listed(t, tokens, stops)
    alone = words if pinned is tokens else listed(t, pinned, stops)
    joined = (_next(pinned) == stops + 1) & (t.codes[np.minimum(stops, len(t.codes) - 1)] == ord("-")) & (_next(t.of(tokens)) == t.of(tokens))
    vague = _has(alone, VAGUE) | (_has(alone, VAGUE_FIRST) & joined & _has(_next(alone), VAGUE_SECOND))
    breaks = _breaks(t)
    stretch = np.cumsum(breaks, dtype=np.int32)
    return [
        t.count(t.runs(~blank)[0]), t.count(starts), t.count(groups) + t.count(starts[silent]), t.count(starts[of_run > 2]),
        t.count(tokens), t.count(tokens[_has(words, FUNCTION)]), t.count(tokens[_has(alone, MODAL)]), t.count(tokens[vague]),
        _stretches(t, stretch, t.runs(~blank & ~breaks)[0]), _stretches(t, stretch, _passive(t)),
    ]


def _by_text(measured: Callable[[Texts], list[np.ndarray]], texts: pa.Array, width: int) -> list[pa.Array]:
    parts = [measured(t) for t in slices(texts)]
    return [pa.array(np.concatenate([p[i] for p in parts] or [[]]).astype(np.int32)) for i in range(width)]


def text_measures(lowered: Column) -> Column:
    """Struct of the ``MEASURES`` of a lower-cased text; a null counts as empty."""

    @arrow_udf(", ".join(f"{m} int" for m in MEASURES))
    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_by_text(measure, texts, len(MEASURES)), MEASURES)

    return run(lowered)


def word_counts(text: Column) -> Column:
    """Words between white space; null for a null, as a pattern gives it."""

    @arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        found = _by_text(lambda t: [t.count(t.runs((t.kinds & BLANK) == 0)[0])], texts, 1)[0]
        return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.int32()), found)

    return run(text)


def lexicon_counts(lowered: Column, lexicons: Mapping[str, Sequence[str]]) -> Column:
    """Struct of the non-overlapping literal occurrences per lexicon; overlapping terms count once each."""
    encoded = [[term.encode() for term in terms] for terms in lexicons.values()]

    @arrow_udf(", ".join(f"{name} int" for name in lexicons))
    def run(texts: pa.Array) -> pa.Array:
        found = [[sum(map(text.count, terms)) for terms in encoded] for text in _bytes(texts)]
        return pa.StructArray.from_arrays([pa.array([row[i] for row in found], pa.int32()) for i in range(len(encoded))], list(lexicons))

    return run(lowered)


def lexicon_hits(lowered: Column, lexicons: Mapping[str, Sequence[str]]) -> Column:
    """Struct of whether a text holds a term of each lexicon; a null holds none."""
    encoded = [[term.lower().encode() for term in terms] for terms in lexicons.values()]

    @arrow_udf(", ".join(f"{name} boolean" for name in lexicons))
    def run(texts: pa.Array) -> pa.Array:
        found = [[any(term in text for term in terms) for terms in encoded] for text in _bytes(texts)]
        return pa.StructArray.from_arrays([pa.array([row[i] for row in found], pa.bool_()) for i in range(len(encoded))], list(lexicons))

    return run(lowered)


def _bytes(texts: pa.Array) -> Iterator[bytes]:
    """One text at a time; a null is an empty text."""
    return (text.as_py() or b"" for text in texts.cast(pa.large_string()).cast(pa.large_binary()))
