import os
import zlib

import numpy as np
import public_tokenizers
import pytest

from plumbline.llm import packing, queries
from tests.llm.conftest import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's they'RE <|endoftext|>foo, a<|startoftext|>b “quoted” 'tis 3rd x²y été ́a, ŉ ıİ ß,ẞ foo\x1cbar a b \x85 'll ×÷ ªº µ",
       "rock'n'roll-100% DON'T ÀÉÎ ÿ", "", " \n", "!!!", "ﬁ ée Ωmega 中文字", "<|endoftext|>", "a" * 3000]


def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def wanted_ids(texts):
    return [[*e.ids, 1] for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_by_word_equals_whole_texts(spark):
    texts = [t.encode() for t in ODD] + [r["text"].encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    word_ids, whole = packing.WordIds(PATH, True), packing.WordIds(PATH, False)
    assert word_ids(texts) == whole(texts)
    packing.MEMO_WORDS, before = 10, packing.MEMO_WORDS
    try:  # forgetting changes nothing
        assert [word_ids([t])[0] for t in texts[:40]] == whole(texts[:40])
    finally:
        packing.MEMO_WORDS = before


def test_by_word_is_refused_for_other_tokenizers():
    with pytest.raises(ValueError, match="by_word"):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"), True)


def test_query_is_an_exact_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([r["doc_id"] for r in docs], wanted_ids([r["text"] for r in docs]), strict=True))
    pieces = queries.op5_packing(spark, DATA).collect()
    covered = {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
        covered.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for k, parts in covered.items():
        assert sum(n for _, n in parts) == len(ids[k]) and len(set(parts)) == len(parts)
    assert set(covered) == set(ids)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or s == max(by_sequence)


def test_sequences_and_edge_cases(spark, edge, empty):
    pieces = packing.pack(edge, PATH, by_word=True)
    rows = packing.sequences(pieces).collect()
    total = sum(len(x) for x in wanted_ids([r["text"] for r in edge.collect()]))
    assert sum(len(r["ids"]) // 4 for r in rows) == total == sum(d["length"] for r in rows for d in r["documents"])
    assert sorted(len(r["ids"]) // 4 for r in rows)[1:] == [2048] * (len(rows) - 1)
    assert packing.pack(empty, PATH, by_word=True).count() == 0
    same = packing.pack(edge.limit(5), PATH, capacity=3)
    assert same.where("length > 3").count() == 0
