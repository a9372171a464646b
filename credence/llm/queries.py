"""The operators applied to their whole tables, as named queries, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import (
    alignment,
    decontaminate,
    jaccard,
    line_dedup,
    oracles,
    packing,
    preference,
    prefix_trie,
    quality_votes,
    rules,
    sharding,
    substrings,
    token_counts,
    toxicity,
)
from credence.llm.common import table


def op1_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_votes.report(quality_votes.score(docs, labels))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(
        decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = preference.swapped_answers(table(spark, sf_dir, "conversations"))
    return preference.report(preference.preference_pairs(chosen, rejected))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.report(toxicity.score(docs, labels))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = alignment.align_tokenizers(table(spark, sf_dir, "documents"))
    return alignment.report(scored)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_rows(table(spark, sf_dir, "conversations"))
    return prefix_trie.report(prefix_trie.trie(prefix_trie.shared_heads(turns)))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_votes, op2_decontaminate, op3_line_dedup, op4_sharding, op5_preference, op6_toxicity, op7_jaccard,
        op8_packing, op9_substrings, op10_quality_rules, op11_alignment, op12_prefix_trie, op13_token_counts,
    )
}

#: Without a twin: fitted models (1, 6, 10), hashes that SQL lacks (4), token ids (8, 11, 13), bytes cut by windows (9).
ORACLES: dict[str, str] = {
    "op2_decontaminate": oracles.DECONTAMINATE,
    "op3_line_dedup": oracles.LINE_DEDUP,
    "op5_preference": oracles.PREFERENCE,
    "op7_jaccard": oracles.JACCARD,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
}
