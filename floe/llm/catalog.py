"""Registered queries of the training-data operators (digest columns only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floe.llm import (bitplanes, chat, decontaminate, dedup, itq, katz, mixing, mtree, quality, shard,
                      toxicity, trie, variants)
from floe.llm.common import finished, remainder, table


#: The tokenizer's file; tokenizers come with the installation, not with this repository.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.format_preferences(chat.neighbour_pairs(table(spark, sf_dir, "conversations")))
    return made.select("pair_id", "n_prefix", "prompt", "chosen", "rejected",
                       *[F.array_join(c, ",").alias(c) for c in ("chosen_spans", "rejected_spans")])


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) == 0, order=2)


def op3_mtree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_prefix_filter_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op6_factorisation_machine_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ("n_chars",))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        rates = mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
        return rates.select("doc_id", "tokens", "domain", "p", "rate", mixing.copies_of(
            F.col("rate"), F.lit("mix"), F.col("doc_id"), F.col("h")).alias("copies"))
    return finished(spark, "rates", build)


def op8_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.read_documents(bitplanes.write_files(table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_prefix_trie_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        turns = trie.ordered_turns(table(spark, sf_dir, "conversations"))
        return trie.prefix_trie(*trie.borrow_openings(turns, group=100, most=6))
    return finished(spark, "trie", build)


def op12_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(table(spark, sf_dir, "documents"), slip=199)
    return variants.spelling_variants(words.filter((F.char_length("word") >= 6) & (F.col("n") >= 5)), ratio=5)


def op13_itq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES = {f.__name__: f for f in (
    op1_preference_formatting, op2_katz_backoff, op3_mtree_top5, op4_minimax_shards,
    op5_prefix_filter_decontamination, op6_factorisation_machine_quality,
    op7_soft_membership_mixing, op8_superminhash_dedup, op9_subword_toxicity,
    op10_bitplane_tokens, op11_prefix_trie_collapse, op12_permuterm_variants, op13_itq_near_vectors)}
