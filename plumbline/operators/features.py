"""The fifteen symbolic text features, as one projection.

No tagger or parser is used.  Readability counts vowel groups as syllables, content words are the
words outside a function-word list, sentences end at ``.!?`` or a line break, and a sentence is passive
when a form of "to be" is followed by a participle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import COMPLEXITY_TERMS, FEATURE_NAMES, SATD_TERMS, SECURITY_TERMS
from plumbline.functions.arrays import ratio
from plumbline.functions.measures import lexicon_counts, text_measures
from plumbline.functions.text import bullet_count, occurrences


def symbolic_features(df: DataFrame, text: str = "full_text") -> DataFrame:
    """Add the fifteen features; a blank or missing text gives fifteen zeros."""
    t, low = F.col("_t"), F.col("_low")
    counted = (
        df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_low", F.lower("_t"))
        # All counts of words and sentences come from one reading; a pattern for each would search the text ten times.
        .withColumn("_m", text_measures(low))
        .withColumn("_x", lexicon_counts(low, {"satd": SATD_TERMS, "security": SECURITY_TERMS, "complexity": COMPLEXITY_TERMS}))
    )
    sent, word = F.col("_m.sentences"), F.col("_m.letter_runs")
    per_sentence = word / sent
    readable = (sent > 0) & (word > 0)
    blank = F.col("_m.words") == 0

    def feature(c: Column) -> Column:
        return F.when(blank, 0.0).otherwise(c.cast("double"))

    values = {
        "flesch_reading_ease": F.when(
            readable, 206.835 - 1.015 * per_sentence - 84.6 * (F.col("_m.syllables") / word)
        ).otherwise(100.0),
        "gunning_fog": F.when(readable, 0.4 * (per_sentence + 100.0 * (F.col("_m.hard") / word))).otherwise(0.0),
        "lexical_density": ratio(F.col("_m.tokens") - F.col("_m.function_words"), F.col("_m.words")),
        "weak_modal_density": F.col("_m.modals") / F.greatest(sent, F.lit(1)),
        "has_vague_quantifiers": F.col("_m.vague") > 0,
        "passive_voice_ratio": F.col("_m.passive") / F.greatest(sent, F.lit(1)),
        "satd_count": F.col("_x.satd"),
        "security_count": F.col("_x.security"),
        "complexity_count": F.col("_x.complexity"),
        "char_count": F.char_length(t),
        "word_count": F.col("_m.words"),
        "sentence_count": sent,
        "question_count": occurrences(t, "?"),
        "code_block_count": F.floor(occurrences(t, "```") / 2),
        "list_item_count": bullet_count(t),
    }
    kept = [c for c in df.columns if c not in FEATURE_NAMES]
    return counted.select(*kept, *[feature(values[name]).alias(name) for name in FEATURE_NAMES])


def story_features(df: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Features of title plus description, from raw or cleaned stories."""
    from plumbline.operators.cleaning import full_text

    return symbolic_features(df.select(*keep, full_text().alias("full_text"))).drop("full_text")
