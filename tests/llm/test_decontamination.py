import re

from pyspark.sql import functions as F

from plumbline.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=13):
    windows = []
    for name, text in items:
        w = words(text)
        n = min(width, len(w))
        windows += [(name, w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for ident, text in docs:
        w, hit, named = words(text), set(), set()
        for name, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    named |= {name} if name is not None else set()
        out.append((ident, len(w), sorted(hit), sorted(named)))
    return sorted(out, key=str)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ITEMS = [("1", PASSAGE), ("2", "Short item"), ("10", "Short item"), (None, "nameless thing"), ("3", None), ("4", " ,. "), ("2", "Short item")]
DOCS = [
    (1, f"So: {PASSAGE.upper()}! And more."), (2, "a SHORT, item and a nameless-thing"), (3, "shortitem"), (4, None), (5, ""),
    (6, PASSAGE.replace("seven", "siete")), (7, "short item short item item short"), (8, "x " * 3000 + PASSAGE),
    (8, "x " * 3000 + PASSAGE), (None, "short\nitem"), (9, "one two three four five six seven eight nine ten eleven twelve"),
]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")


def test_marks_equal_brute_force_in_any_number_of_blocks(spark):
    docs, bench = frames(spark)
    for block_bytes in (1 << 20, 40):
        marked, (n, at, items) = decontamination.mark(docs, bench, block_bytes=block_bytes)
        found = [(r["doc_id"], r[n], list(r[at]), sorted(r[items])) for r in marked.collect()]
        assert sorted(found, key=str) == brute(DOCS, ITEMS)


def test_documents_and_spans(spark):
    docs, bench = frames(spark)
    kept = decontamination.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 8, 8, 9]
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[1] == "So: " + " " * 13 + "! And more." and cut[4] is None and cut[6] == DOCS[5][1]
    assert words(cut[8]) == ["x"] * 3000


def test_edge_cases(spark, edge, empty):
    _, bench = frames(spark)
    marked, names = decontamination.mark(edge, bench)
    assert names == ("_bench_words", "bench_positions", "_bench_items") and marked.count() == edge.count()
    assert decontamination.decontaminate(edge, bench).columns == edge.columns
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(edge, bench.limit(0)).exceptAll(edge).count() == 0
    assert decontamination.decontaminate(edge, bench.select("text", F.lit(1).alias("item_id"))).count() == edge.count()
