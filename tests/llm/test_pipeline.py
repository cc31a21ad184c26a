import corpus_pipeline
from plumbline.llm import decontamination, language_id, packing, simhash, toxicity
from plumbline.llm.text_blocks import fold
from tests.llm.conftest import DATA
from tests.llm.test_decontamination import brute
from tests.llm.test_packing import wanted_ids
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept[name] = docs, spark.read.parquet(f"{tmp_path}/{k}")
        docs = kept[name][1]

    def ids(df):
        return sorted(r["doc_id"] for r in df.select("doc_id").collect())

    before, after = kept["toxicity"]
    scored, name = toxicity.with_score(before, toxicity.fit(before.where(fold("doc_id", 3) != 1), labels))
    assert ids(after) == ids(scored.where(f"{name} < 0.7")) and 0 < len(ids(after)) < before.count()
    before, after = kept["language"]
    named, (lang, _) = language_id.with_language(before, language_id.fit(before.where(fold("doc_id", 4) != 2)))
    assert set(ids(after)) <= set(ids(named.where(f"{lang} <> 'und'"))) and len(ids(after)) > 0.95 * before.count()
    before, after = kept["near_duplicates"]
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in before.collect()]
    assert ids(after) == sorted(set(brute_components(rows)))
    before, after = kept["decontamination"]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    marks = brute([(r["doc_id"], r["text"]) for r in before.collect()], items)
    assert ids(after) == sorted(d for d, n, hit, _ in marks if not hit or decontamination.MIN_SHARE * len(hit) < n)
    before, after = kept["packing"]
    tokens = dict(zip(*[[*x] for x in zip(*[(r["doc_id"], r["text"]) for r in before.collect()], strict=True)], strict=True))
    wanted = dict(zip(tokens, map(len, wanted_ids(list(tokens.values()))), strict=True))
    found = {}
    for r in after.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == wanted
    assert corpus_pipeline.run(spark, DATA).agg({"length": "sum"}).first()[0] == sum(wanted.values())
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]
    assert packing.CAPACITY == 2048 and simhash.RADIUS == 4


def test_edge_cases_pass_every_stage(spark, edge, empty, tmp_path):
    for name, start in (("edge", edge), ("empty", empty)):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert (docs.count() == 0) == (name == "empty")
