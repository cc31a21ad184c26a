import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import text_blocks as tb

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n,9z ", max_size=30)), max_size=6)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=100, deadline=None)
@given(texts)
def test_words_are_those_of_the_patterns(rows):
    batch = pa.record_batch({"text": pa.array(rows, pa.string())})
    data, offsets = tb.text_bytes(batch, "text")
    for table, pattern in ((tb.NOT_SPACE, SPACED), (tb.ALNUM, ALNUM)):
        words = tb.split_words(data, offsets, table)
        found = [[words.text(i).decode() for i in range(a, b)] for a, b in zip(words.first, words.first[1:], strict=False)]
        assert found == [pattern.findall(lower(t)) for t in rows]


def test_hashes_tell_words_apart():
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abcdé"), rng.integers(1, 9))) for _ in range(5000)})
    batch = pa.record_batch({"text": pa.array([" ".join(words), " ".join(reversed(words))])})
    w = tb.split_words(*tb.text_bytes(batch, "text"))
    hashes = tb.word_hashes(w)
    assert len(set(hashes.tolist())) == len(words)
    assert hashes[: len(words)].tolist() == hashes[len(words) :][::-1].tolist()


def test_slices_cover_all_rows_in_order():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 100, "", "c"])})
    parts = list(tb.row_slices(batch, "text", 20))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 2]
    assert list(tb.row_slices(batch.slice(0, 0), "text")) == []


@pytest.mark.parametrize("limit", [3, 1000])
def test_memo_gives_what_is_computed(limit):
    memo, asked = tb.Memo(1, np.int64, limit), []
    for keys in ([5, 7, 5], [7, 9, 1, 2], [], [5, 2]):
        keys = np.array(keys, np.uint64)

        def compute(at, keys=keys):
            asked.extend(keys[at].tolist())
            return (keys[at] * 2).astype(np.int64)[:, None]

        assert memo.lookup(keys, compute)[:, 0].tolist() == (keys * 2).tolist()
    assert limit == 3 or sorted(asked) == [1, 2, 5, 7, 9]
