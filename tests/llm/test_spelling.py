import re
import zlib
from collections import Counter

from plumbline.llm import queries, spelling
from tests.llm.conftest import DATA


def brute_counts(rows, every=97):
    total = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_forms(counts):
    near = {w: [] for w in counts}
    for a in counts:
        for b in counts:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return rows


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_query_equals_all_pairs(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()][:60]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_spelling(spark, str(tmp_path))
    assert found.columns == COLUMNS
    wanted = brute_forms(brute_counts(rows))
    assert set(map(tuple, found.collect())) == wanted and any(r[1] for r in wanted)


def test_counts_equal_brute_force_on_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = queries.op11_spelling(spark, DATA).select("word", "n").collect()
    assert dict(map(tuple, found)) == brute_counts(rows)


def test_runs_ties_chains_and_chance_words(spark):
    """Doubled letters, equal counts, long chains of forms, every edit of one word, non-ASCII letters."""
    counts = {"aaaaa": 4, "aaaaaa": 9, "aaaaaaa": 40, "aabaaa": 9, "hello": 64, "hellö": 3, "hallo": 31, "hullo": 31, "helo×": 5, "halloo": 15,
              "hallooo": 7, "hallooox": 3, "ÿÿÿÿÿ": 8, "ÿÿÿÿÿÿ": 4, "abcde": 10, "bcdea": 10, "abcdef": 10, "abcd÷": 20}
    counts |= {"hell" + c: 3 for c in "abcdefghijklmn"} | {f"c{'x' * k}hain": 3 * 2**k for k in range(14)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    for long_word in (64, 3, 5, 6):  # all, none and some rotations hashed
        found = spelling.with_roots(spelling.with_forms(words, long_word=long_word)).select(*COLUMNS).collect()
        assert set(map(tuple, found)) == brute_forms(counts), long_word


def test_very_long_words(spark):
    long = "abcdefghij" * 20_000
    counts = {long: 9, long[:-1]: 3, long + "j": 4, "z" + long[1:]: 3, long[:777] + long[778:]: 2, long[:64]: 5, long[:65]: 11, long[:63]: 20}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    found = spelling.with_roots(spelling.with_forms(words)).select(*COLUMNS).collect()
    assert set(map(tuple, found)) == brute_forms(counts)


def test_ranges_are_bounded_by_the_alphabet(spark):
    words = spark.createDataFrame([(f"word{c}", 3) for c in "abcdefghij"] + [("word", 9)], "word string, n long")
    entries = spelling.rotations(words)
    sizes = entries.groupBy("key").count().agg({"count": "max"}).first()[0]
    assert entries.count() == 10 * 11 + 9 and sizes == 11


def test_edge_cases(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    found = spelling.variants(edge, slip_every=97).select(*COLUMNS).collect()
    wanted = brute_counts(rows)
    assert {r["word"]: r["n"] for r in found} == wanted
    assert spelling.variants(empty).count() == 0
    assert {r["word"] for r in spelling.variants(edge, min_count=1).collect()} == set(brute_one(rows))


def brute_one(rows):
    return {w for _, t in rows for w in re.findall("[a-zÀ-ÿ]{5,}", (t or "").encode().lower().decode())}
