"""Token counts of a unigram tokenizer, without building the tokens.

A document's words (runs of bytes other than ASCII white space), each with the word mark in front, are segmented by
Viterbi.  An Aho-Corasick automaton enumerates the vocabulary pieces that end at each letter; dynamic programming
carries the best score, the number of pieces on the best path and whether its last piece is unknown.  The tie rules are
those of the unigram model of ``tokenizers``: of equal scores the piece that starts first wins; a letter that is no
piece of its own may be an unknown piece, ``UNKNOWN_PENALTY`` below the least score; neighbouring unknown pieces are
one token.

Defined results: null and empty texts have no tokens; words of any length are segmented whole; an empty vocabulary
makes each word one unknown token; repeated documents get equal counts; other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.text_blocks import (
    Memo, appended, fresh, per_document, row_slices, split_words, text_bytes, with_fields, word_hashes,
)

WORD_MARK = "▁"
UNKNOWN_PENALTY = 10.0


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file in their order, with the log probabilities of Zipf's law by rank.

    The file is one of merges, whose scores are ranks and no probabilities; a unigram model needs probabilities.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    whole = math.log(sum(1 / (k + 1) for k in range(len(ordinary))))
    return [(p, -math.log(k + 1) - whole) for k, p in enumerate(ordinary)]


class Counter:
    """Counts the pieces of words."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.pieces = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            self.pieces.add_word(piece, (len(piece), score))
        self.singles = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        if vocabulary:
            self.pieces.make_automaton()

    def count(self, word: str) -> int:
        if not len(self.pieces):
            return int(bool(word))
        n = len(word)
        best, count, open_unknown = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, found in self.pieces.iter(word):
            matches[last + 1].append(found)
        for end in range(1, n + 1):
            top, start, unknown = -math.inf, -1, False
            for length, score in sorted(matches[end], reverse=True):  # the piece that starts first comes first
                if (value := best[end - length] + score) > top:
                    top, start = value, end - length
            if word[end - 1] not in self.singles and (value := best[end - 1] + self.unknown) > top:
                top, start, unknown = value, end - 1, True
            best[end], open_unknown[end] = top, unknown
            count[end] = count[start] + (0 if unknown and open_unknown[start] else 1)
        return count[n]


def with_token_count(docs: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus the number of tokens; the name of that column comes second."""
    name = fresh(docs, "n_tokens")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, memo = Counter(shared.value), Memo(1, np.int64)
        for batch in batches:
            for part in row_slices(batch, text):
                data, offsets = text_bytes(part, text)
                words = split_words(data, offsets)
                words.data = data  # the tokenizer tells upper case from lower case
                found = memo.lookup(word_hashes(words), lambda at: np.array(
                    [[counter.count(WORD_MARK + words.text(i).decode())] for i in at]  # noqa: B023
                ))
                yield appended(part, {name: pa.array(per_document(words, found[:, 0]).astype(np.int64))})

    return docs.mapInArrow(run, with_fields(docs, T.StructField(name, T.LongType()))), name
