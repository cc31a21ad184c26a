import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import pitman_yor as py
from plumbline.llm import queries
from tests.llm.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "</s>"]


@pytest.mark.parametrize("cached", [py.CACHED, 300])
def test_counts_and_base_equal_brute_force(spark, cached):
    """Words outside the cache take another way to the same numbers."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]
    counts = Counter(t for r in train for t in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    if cached == py.CACHED:
        found = {r["doc_id"]: r for r in queries.op4_pitman_yor(spark, DATA).collect()}
        assert {r["train_tokens"] for r in found.values()} == {n}
    else:
        model, table = py.fit(docs.where("crc32(cast(doc_id AS string)) % 5 <> 1"), cached=cached)
        assert len(model.known.codes) <= cached
        found = {r["id"]: r for r in py.score(docs, model, table, "doc_id").collect()}
    assert len(found) == len(rows)
    held_out = [0.0, 0.0]
    for r in rows:
        got, words = found[r["doc_id"]], tokens(r["text"])
        assert got["n_tokens"] == len(words) and got["n_known"] == sum(counts[w] > 0 for w in words)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert got["base_score"] == pytest.approx(base, rel=1e-9)
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1:
            held_out[0] += base
            held_out[1] += got["score"]
    assert held_out[1] > 0.95 * held_out[0]  # both are negative: the model is the better one


def test_probabilities_of_every_context_add_up(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    model, table = py.fit(docs, dishes=500, cached=5000)
    dish = 10.0 ** model.log_dish.astype(float)
    assert dish.sum(axis=1) == pytest.approx(np.ones(len(dish)), abs=1e-4)
    rare = [r["c"] for r in table.collect() if np.uint64(r["h"] % (1 << 64)) not in model.served.codes]
    assert sum(rare) == model.rare_tokens and len(rare) == model.rare_types
    whole = (10 ** model.log_rare(np.array(rare))).sum() + 10 ** model.log_rare(np.array([0]))[0]
    assert whole == pytest.approx(1, abs=1e-9)


def test_contexts():
    menu = py.Menu(np.arange(10, dtype=np.uint64), np.array([-1, -1, 0, 1, 2, 9, -1, -1, -1, -1]))
    first = np.array([0, 6, 6, 9])
    dishes = np.array([1, 2, 1, 5, 3, 1, 4, 4, 1])
    wanted, near, far = [], py.NEAR, py.FAR
    for a, b in zip(first, first[1:], strict=False):
        marks = []
        for k in range(a, b):
            last = marks[-1] if marks else near
            before = marks[-2] if len(marks) > 1 and marks[-2] < far else far
            wanted.append(last * (far + 1) + before)
            if menu.near[dishes[k]] >= 0:
                marks.append(int(menu.near[dishes[k]]))
    assert menu.contexts(dishes, first).tolist() == wanted


def test_seating_has_the_right_number_of_tables():
    """Against a restaurant seated one customer after the other."""
    customers, parent = np.array([1, 2, 5, 30, 0, 400]), np.array([0.1, 0.2, 0.05, 0.3, 0.05, 0.3])
    rng = np.random.default_rng(0)
    served = np.flatnonzero(customers)
    found = np.mean([py.seat(customers[served], parent[served], rng, moves=200) for _ in range(150)], axis=0)

    def one_by_one():
        order = rng.permutation(np.repeat(np.arange(6), customers))
        tables = [[] for _ in range(6)]
        for w in order:
            sizes = np.array(tables[w], float)
            new = (py.STRENGTH + py.DISCOUNT * sum(map(len, tables))) * parent[w]
            weights = np.r_[sizes - py.DISCOUNT, new]
            k = rng.choice(len(weights), p=weights / weights.sum())
            if k == len(sizes):
                tables[w].append(1)
            else:
                tables[w][k] += 1
        return [len(t) for t in tables]

    sample = np.mean([one_by_one() for _ in range(60)], axis=0)[served]
    assert (found >= 1).all() and (found <= customers[served]).all() and found[0] == 1
    assert found == pytest.approx(sample, rel=0.35)


def test_edge_cases(spark, edge, empty):
    model, counts = py.fit(edge, dishes=50, cached=60)
    rows = py.score(edge, model, counts).collect()
    assert len(rows) == edge.count() and all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    by_id = {r["id"]: r for r in rows if (r["id"] or 0) >= 900}
    assert by_id[900]["n_tokens"] == by_id[901]["n_tokens"] == 1 and by_id[900]["score"] == by_id[901]["score"]
    assert by_id[906]["n_tokens"] == 40_001
    assert py.score(empty, model, counts).count() == 0
    nothing, none = py.fit(empty)
    assert {(r["score"], r["base_score"], r["n_known"]) for r in py.score(edge.limit(3), nothing, none).collect()} <= {(0.0, 0.0, 0)}
    assert py.perplexity(py.score(edge, model, counts)).first()[0] > 1


@pytest.mark.parametrize(("wide", "cached"), [(py.WIDE, py.CACHED), (3, 60)])
def test_every_word_before_has_its_own_restaurant(spark, wide, cached):
    """Pairs of content words count: "kNa" is followed by "kNb" only, whatever the frequent words around them."""
    train = [(k, f"the of the k{k % 90}a k{k % 90}b of the") for k in range(720)]
    model, counts = py.fit(spark.createDataFrame(train, "doc_id long, text string"), cached=cached, wide=wide)
    found = {(r["v"], r["w"]): r for r in model.pairs.collect()}
    wanted = Counter(p for _, text in train for p in zip(["<s>", *tokens(text)], tokens(text), strict=False))
    assert Counter(r["c"] for r in found.values()) == Counter(wanted.values())
    assert all(1 <= r["t"] <= r["c"] for r in found.values())
    docs = spark.createDataFrame([(1, "the of the k7a k7b of the"), (2, "the of the k7a k8b of the"), (3, "zz k7b")], "doc_id long, text string")
    score = {r["id"]: r["score"] for r in py.score(docs, model, counts).collect()}
    assert score[1] > score[2] + 1 and math.isfinite(score[3])
    # All continuations of a context: the seen ones and what is left for the parent add up to 1.
    total = model.restaurants.collect()
    for r in total[:20]:
        own = [x for x in found.values() if x["v"] == r["v"]]
        left = py.STRENGTH + py.DISCOUNT * r["tables"]
        assert sum(x["c"] - py.DISCOUNT * x["t"] for x in own) + left == pytest.approx(py.STRENGTH + r["n"])


def test_pairs_are_stored_in_few_bytes_and_documents_are_dealt(spark):
    """Rows of four numbers took 25 bytes a pair and more; the documents of all tasks do not go to one bucket."""
    rng = np.random.default_rng(0)
    texts = [(k, " ".join(f"w{x}" for x in rng.integers(0, 3000, 400))) for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    model, counts = py.fit(docs)
    stored = sum(len(r["seated"]) for r in model.seated.collect())
    pairs = model.pairs.count()
    assert pairs == len({p for _, text in texts for p in zip(["<s>", *tokens(text)], tokens(text), strict=False)})
    assert stored < 8 * pairs
    asked = docs.mapInArrow(py._score(model.shared, "doc_id", "text"), "bucket int, block binary, chunk long, at long, w long, "
                            f"times long, own double, share double, id long, {py.OWN}")
    assert asked.where("block IS NULL").select("bucket").distinct().count() == 8
    assert py.score(docs, model, counts).count() == 200
