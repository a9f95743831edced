"""A training corpus from raw documents: five stages, each on all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``docs``.  Null, empty or repeated rows follow the rules of the
operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floe.llm import decontaminate, dedup, mixing, quality, shard
from floe.llm.common import staged, table

#: Threshold and metadata as in op6.
KEEP_SCORE = 0.7
METADATA = ("n_chars",)
#: Items of fewer words than a shingle occur in clean text: they mark only documents that are mostly such an item.
MIN_ITEM_WORDS = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), KEEP_SCORE, METADATA)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8)."""
    return dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_words=MIN_ITEM_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rate; no domain shrinks."""
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"))


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    return shard.shard_documents(docs, 16)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_copies), ("decontamination", drop_leaks),
          ("mixing", mix), ("sharding", cut_shards)]

#: Fitted models and MinHash have no equal in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
