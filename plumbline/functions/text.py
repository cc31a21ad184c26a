"""String measures used by cleaning, labeling and feature extraction."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.config import BE_FORMS, BULLET_PATTERN, IRREGULAR_PARTICIPLES, VOWELS

# Unicode white space, spelled out so that every regex engine agrees on it.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD_RUN = f"[^{SPACE}]+"
WORD_CHAR = r"[\p{L}\p{N}_]"
LETTERS = r"\p{L}+"
_CONSONANT = rf"[^\P{{L}}{VOWELS}]"
_VOWEL = f"[{VOWELS}]"
VOWEL_GROUP = f"{_VOWEL}+"
# Words are maximal letter runs; look-arounds pin a match to a whole run.
NO_VOWEL_WORD = rf"(?<!\p{{L}}){_CONSONANT}+(?!\p{{L}})"
COMPLEX_WORD = rf"{_CONSONANT}*({_VOWEL}+{_CONSONANT}+){{2,}}{_VOWEL}\p{{L}}*"
SENTENCE_BREAK = r"[.!?]+(\s|$)|\n+"
PASSIVE = (
    rf"(^|[^a-z])({'|'.join(BE_FORMS)})\s+([a-z]+ly\s+)?([a-z]+ed|{'|'.join(IRREGULAR_PARTICIPLES)})([^a-z]|$)"
)


def quote(term: str) -> str:
    """Escape a literal for use inside a regular expression."""
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in term)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def word_count(text: Column) -> Column:
    """Whitespace separated words; a blank text has none."""
    return matches(text, WORD_RUN)


def bullet_count(text: Column) -> Column:
    return matches(text, BULLET_PATTERN)


def contains_any(lowered: Column, terms: list[str]) -> Column:
    """Substring test against a lexicon.  ``lowered`` must be lower case already."""
    return F.coalesce(reduce(or_, [lowered.contains(t.lower()) for t in terms]), F.lit(False))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping literal occurrences.  Bytes are compared, which need no counting; most texts lack most terms."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))
    return F.when(text.contains(term), removed / F.lit(len(term.encode()))).when(text.isNotNull(), F.lit(0.0))


def total_occurrences(lowered: Column, terms: list[str]) -> Column:
    """Sum over the terms; overlapping terms count once each."""
    return reduce(add, [occurrences(lowered, t) for t in terms])


def whole_word(terms: list[str]) -> str:
    """Pattern for whole words, with Unicode-aware word edges."""
    return rf"(?<!{WORD_CHAR})({'|'.join(quote(t) for t in terms)})(?!{WORD_CHAR})"


def sentences(text: Column) -> Column:
    """Non-blank pieces between sentence ends or line breaks."""
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: s.rlike(WORD_RUN))
