import pytest

DATA = "/root/testdata/sf0.001"
CLASHES = ["toxicity", "simhash", "row", "row_number", "bench_words", "bench_items", "language", "evidence", "code", "id",
           "label", "root", "m", "stratum", "n_tokens", "host", "path", "fold"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns that clash with names used inside."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").limit(20).collect()
    texts = [None, "", " \t\n", "#", "Ünï çödé ñ", "x" * 150_000, "word " * 40_000, base[0]["text"], base[1]["text"]]
    rows = [(900 + k, t, "en", "src1", 1, *["y"] * len(CLASHES)) for k, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], (None, base[2]["text"], None, None, None, *[None] * len(CLASHES)), (None,) * (5 + len(CLASHES))]
    rows += [(b["doc_id"], b["text"], b["lang"], b["source"], b["n_chars"], *["z"] * len(CLASHES)) for b in base]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(d, q, t) for d, q, t in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    rows += [(None, 1, 1), (0, None, None), (10**9, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
