"""The registered queries: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    decontamination, fill_middle, html_text, language_id, packing, pii, pitman_yor, quality_bayes, quality_rules, simhash,
    spelling, token_counts, toxicity,
)
from plumbline.llm.text_blocks import fold
from plumbline.sources.tables import table


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on the labelled documents outside the held-out fold."""
    return toxicity.fit(table(spark, sf_dir, "documents").where(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, name = toxicity.with_score(docs, toxicity_model(spark, sf_dir))
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    counted, name = token_counts.with_token_count(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return counted.select("doc_id", F.col(name).alias("n_tokens"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found, name = html_text.with_main_text(pages)
    return found.select("page_id", "url", F.col(name).alias("text"), F.char_length(name).cast("long").alias("n_chars"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = pitman_yor.fit(docs.where(fold("doc_id", 5) != 1))
    return pitman_yor.score(docs, model, counts).select(
        F.col("id").alias("doc_id"),
        (fold("id", 5) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.known.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_word=True)
    return packing.with_checksum(pieces.withColumnRenamed("id", "doc_id"))


def language_network(spark: SparkSession, sf_dir: str) -> language_id.Network:
    """Trained on the documents outside the held-out fold."""
    return language_id.fit(table(spark, sf_dir, "documents").where(fold("doc_id", 4) != 2))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    named, (lang, score) = language_id.with_language(docs, language_network(spark, sf_dir))
    held_out = (fold("doc_id", 4) == 2).alias("held_out")
    return named.select("doc_id", held_out, F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def op7_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is the host, and its language section the path.  Labels of a fifth of the documents are left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    scored = quality_bayes.score(docs, docs.where(fold("doc_id", 5) != 1), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), (fold("id", 5) == 1).alias("held_out"),
                         "evidence", "host_rate", "path_rate", "posterior", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, (n, at, items) = decontamination.mark(docs, table(spark, sf_dir, "benchmark"))
    hit = F.size(at).cast("long")
    return marked.select(
        "doc_id",
        F.col(n).alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        decontamination.contaminated(F.col(n), hit).alias("contaminated"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(F.col("id").alias("doc_id"), *[F.col(f"m.{c}") for c in counts], "base_failed", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(table(spark, sf_dir, "documents"), slip_every=97)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.count(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.listed(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    return fill_middle.with_digests(made).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_html_text": op3_html_text,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_quality_bayes": op7_quality_bayes,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_pii": op12_pii,
    "op13_fill_middle": op13_fill_middle,
}
