import numpy as np
import public_tokenizers
import pytest
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from plumbline.llm import queries, token_counts
from tests.llm.conftest import DATA


def library(vocabulary):
    lowest = min(s for _, s in vocabulary)
    t = Tokenizer(models.Unigram([*vocabulary, ("<unk>", lowest)], unk_id=len(vocabulary), byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex("[\t-\r ]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always")
    ])
    return t


def test_counts_equal_the_tokenizer(spark):
    vocabulary = token_counts.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    reference = library(vocabulary)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {r["doc_id"]: r["n_tokens"] for r in queries.op2_token_counts(spark, DATA).collect()}
    assert found == {k: len(reference.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}


@pytest.mark.parametrize("seed", range(4))
def test_ties_and_unknown_letters(seed):
    rng = np.random.default_rng(seed)
    pieces = {"▁"} | {"".join(rng.choice(list("▁abc"), rng.integers(1, 5))) for _ in range(12)}
    vocabulary = [(p, -float(rng.integers(1, 4))) for p in sorted(pieces)]
    counter, reference = token_counts.Counter(vocabulary), library(vocabulary)
    for _ in range(300):
        word = "".join(rng.choice(list("abcdé"), rng.integers(1, 12)))
        assert counter.count("▁" + word) == len(reference.encode(word, add_special_tokens=False).ids), (word, vocabulary)


def test_edge_cases(edge, empty):
    vocabulary = [("▁", -1.0), ("▁word", -2.0), ("x", -1.0), ("xx", -1.5)]
    counted, name = token_counts.with_token_count(edge, vocabulary)
    assert name == "_n_tokens" and counted.columns[:-1] == edge.columns and counted.count() == edge.count()
    found = {r["doc_id"]: r[name] for r in counted.collect() if (r["doc_id"] or 0) >= 900}
    assert [found[900], found[901], found[902]] == [0, 0, 0]
    assert (found[903], found[905], found[906]) == (2, 75_001, 40_000)
    assert token_counts.with_token_count(empty, vocabulary)[0].count() == 0
    assert token_counts.Counter([]).count("▁ab") == 1
