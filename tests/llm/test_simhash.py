import itertools

import numpy as np
import pytest
import xxhash

from plumbline.llm import queries, simhash
from tests.llm.conftest import DATA


def brute_fingerprint(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    codes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(rows, radius=4):
    """(id, code) -> component of each row, by all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    roots = [find(i) for i in range(len(rows))]
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in roots}
    return [least[r] for r in roots]


def test_query_equals_brute_force(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in texts]
    wanted = {(i, f"{c:016x}", g) for (i, c), g in zip(rows, brute_components(rows), strict=True)}
    assert {tuple(r) for r in queries.op10_simhash(spark, DATA).select("doc_id", "fingerprint", "component_id").collect()} == wanted


def clustered(rng, n):
    seeds = rng.integers(0, 1 << 63, max(1, n // 8), dtype=np.uint64)
    codes = rng.choice(seeds, n)
    for _ in range(3):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * rng.integers(0, 2, n, dtype=np.uint64)
    return np.unique(codes)


@pytest.mark.parametrize("tile_rows", [7, 1 << 16])
def test_components_in_tiles(spark, tile_rows):
    codes = clustered(np.random.default_rng(3), 400)
    rows = [(int(k), int(c)) for k, c in enumerate(codes)]
    df = spark.createDataFrame([(i, int(np.uint64(c).astype(np.int64))) for i, c in rows], "id long, code long")
    found = simhash.components(df, "id", "code", tile_rows=tile_rows)
    got = {r["code"]: r["component"] for r in found.collect()}
    assert [got[int(np.uint64(c).astype(np.int64))] for _, c in rows] == brute_components(rows)


@pytest.mark.parametrize("same", [True, False])
def test_no_pair_is_skipped_and_none_doubled(same):
    rng = np.random.default_rng(5)
    left = clustered(rng, 300)
    right = left if same else clustered(rng, 200)
    right = right if same else np.setdiff1d(np.r_[right, left[:40] ^ np.uint64(3)], left)
    found = sorted(tuple(sorted(p) if same else p) for i, j in simhash.near(left, right, 4, same) for p in zip(i.tolist(), j.tolist(), strict=True))
    wanted = [(i, j) for i in range(len(left)) for j in range(len(right))
              if (not same or i < j) and bin(int(left[i]) ^ int(right[j])).count("1") <= 4]
    assert found == wanted


def test_chain_becomes_one_component(spark):
    df = spark.createDataFrame([(k, (1 << k) - 1) for k in range(63)], "id long, code long")
    assert {r["component"] for r in simhash.components(df, "id", "code").collect()} == {0}


def test_keep_one(spark, edge, empty):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    rows = edge.select("doc_id", "text").collect()
    groups = {}
    component = brute_components([(k, brute_fingerprint(r["text"])) for k, r in enumerate(rows)])
    for r, g in zip(rows, component, strict=True):
        groups.setdefault(g, []).append(r["doc_id"])
    least = sorted(str(min(g, key=lambda x: (x is None, x or 0))) for g in groups.values())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == least
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(edge).count() == edge.count()
