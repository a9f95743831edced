"""Exact stratified splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floe.functions.text import c
from floe.operators.cells import cell_totals
from floe.operators.ordering import hash_bucket, key_at_or_before, shuffle_key

BIG = "decimal(38,0)"


def quotas_from_counts(counts: DataFrame, label_col: str, test_size: float = 0.3) -> DataFrame:
    """Per-class test quota from a (label, n_class) table -> (label, n_class, n_test_class).

    Total test rows = ceil(test_size * n).  Train rows per class follow the
    largest-remainder rule on n_train = n - n_test (ties: label order),
    computed in exact integer arithmetic; the class keeps the rest for test.
    The class table has one row per class, so its global window is small.
    """
    counts = counts.select(c(label_col).alias("_floe_label"), "n_class")
    everything = Window.partitionBy()
    n = F.sum("n_class").over(everything)
    with_n = counts.select("*", n.alias("_floe_n"))
    n_test = F.ceil(F.col("_floe_n") * F.lit(float(test_size))).cast("long")
    n_train = (F.col("_floe_n") - n_test).cast(BIG)
    prod = F.col("n_class").cast(BIG) * n_train
    staged = with_n.select("*", # the division leaves no remainder, so its rounding can't reach the integer part
                           ((prod - F.pmod(prod, F.col("_floe_n").cast(BIG))) / F.col("_floe_n").cast(BIG)
                            ).cast("long").alias("_floe_floor"),
                           F.pmod(prod, F.col("_floe_n").cast(BIG)).alias("_floe_rem"),
                           (F.col("_floe_n") - n_test).alias("_floe_train_total"))
    need = F.col("_floe_train_total") - F.sum("_floe_floor").over(everything)
    order = Window.partitionBy().orderBy(F.desc("_floe_rem"), F.col("_floe_label"))
    ranked = staged.select("*", need.alias("_floe_need"), F.row_number().over(order).alias("_floe_rank"))
    train_q = F.col("_floe_floor") + F.when(F.col("_floe_rank") <= F.col("_floe_need"), 1).otherwise(0)
    return ranked.select(F.col("_floe_label").alias(label_col), "n_class",
                         (F.col("n_class") - train_q).cast("long").alias("n_test_class"))


def stratified_quotas(df: DataFrame, label_col: str, test_size: float = 0.3) -> DataFrame:
    counts = df.groupBy(c(label_col).alias(label_col)).agg(F.count(F.lit(1)).alias("n_class"))
    return quotas_from_counts(counts, label_col, test_size)


# Hash buckets used to locate each class boundary; the boundary bucket of a
# class holds about n_class / SELECT_BUCKETS rows.
SELECT_BUCKETS = 1 << 16
# Rows of a boundary bucket that one task ranks.
BUCKET_ROWS = 100_000


def stratified_split(df: DataFrame, label_col: str, key_col: str, test_size: float = 0.3,
                     seed: int = 42, split_col: str = "split",
                     num_partitions: int | None = None, buckets: int = SELECT_BUCKETS) -> DataFrame:
    """Exact stratified train/test split, reproducible from ``seed``.

    Within each class, rows are ordered by (md5(seed:0:key), key); the first
    ``n_test_class`` rows are test.  Only the boundary row of each class is
    searched for, by selection over hash buckets:

    1. one aggregating pass counts rows per (class, bucket of the md5
       prefix); class sizes and quotas come from these counts;
    2. running counts over the buckets of a class (at most ``buckets`` rows)
       locate the bucket holding position n_test_class - 1;
    3. only the rows of that one bucket per class are ranked, in cells where a bucket
       holds more than ``BUCKET_ROWS``, so no task grows with the class.

    The boundaries (one row per class) are collected and the split is a
    comparison of (hash, key) against them, so no row is shuffled and
    re-using the split re-reads pruned columns.  A class holding a third
    of the data is handled like any other: its boundary bucket is small.
    ``num_partitions`` is accepted for API symmetry; results do not depend
    on partitioning.
    """
    h = shuffle_key(c(key_col), seed, 0)
    narrow = df.select(c(label_col).alias("_floe_lbl"), h.alias("_floe_h"), c(key_col).alias("_floe_key"),
                       # never null: a join on it needs no null filter, which would hash every row once more
                       F.coalesce(hash_bucket(h, buckets), F.lit(0)).alias("_floe_b"))
    bucket_counts = narrow.groupBy("_floe_lbl", "_floe_b").agg(F.count(F.lit(1)).alias("cnt")).persist()
    class_counts = bucket_counts.groupBy("_floe_lbl").agg(F.sum("cnt").alias("n_class"))
    # per-class tables are broadcast only when the class count is checked small
    few = class_counts.limit(BOUNDS_AS_LITERALS + 1).count() <= BOUNDS_AS_LITERALS
    small = F.broadcast if few else (lambda d: d)
    quotas = quotas_from_counts(class_counts, "_floe_lbl", test_size).select("_floe_lbl", "n_test_class")
    before = Window.partitionBy("_floe_lbl").orderBy("_floe_b").rowsBetween(Window.unboundedPreceding, -1)
    cum = bucket_counts.withColumn("_floe_before", F.coalesce(F.sum("cnt").over(before), F.lit(0)))
    target = (cum.join(small(quotas), cum["_floe_lbl"].eqNullSafe(quotas["_floe_lbl"]))
              .where((F.col("n_test_class") > 0) & (F.col("_floe_before") <= F.col("n_test_class") - 1)
                     & (F.col("n_test_class") - 1 < F.col("_floe_before") + F.col("cnt")))
              .select(cum["_floe_lbl"].alias("_floe_tl"), F.col("_floe_b").alias("_floe_tb"), "cnt",
                      (F.col("n_test_class") - 1 - F.col("_floe_before")).alias("_floe_r")))
    cand = narrow.join(small(target), narrow["_floe_lbl"].eqNullSafe(target["_floe_tl"])
                       & (narrow["_floe_b"] == target["_floe_tb"]))
    if (target.agg(F.max("cnt")).first()[0] or 0) > BUCKET_ROWS:
        # a boundary bucket that has grown with its class is itself cut into cells
        ranked = cell_totals(cand, ["_floe_lbl"], ["_floe_h", "_floe_key"], index_col="_floe_rn")
    else:
        in_bucket = Window.partitionBy("_floe_lbl").orderBy("_floe_h", "_floe_key")
        ranked = cand.withColumn("_floe_rn", F.row_number().over(in_bucket) - 1)
    last = (ranked.where(F.col("_floe_rn") == F.col("_floe_r")).select("_floe_lbl", "_floe_h", "_floe_key"))
    rows = last.limit(BOUNDS_AS_LITERALS + 1).collect()
    if len(rows) <= BOUNDS_AS_LITERALS:
        bucket_counts.unpersist()
        return _assign_by_literals(df, label_col, key_col, h, rows, split_col)
    # very many classes: the boundary table stays distributed (AQE sizes the join)
    b = last.select(F.col("_floe_lbl").alias("_floe_blbl"), F.col("_floe_h").alias("_floe_bh"),
                    F.col("_floe_key").alias("_floe_bkey"))
    joined = df.join(b, c(label_col).eqNullSafe(F.col("_floe_blbl")), "left")
    is_test = F.col("_floe_bh").isNotNull() & key_at_or_before(
        [h, c(key_col)], [F.col("_floe_bh"), F.col("_floe_bkey")])
    return (joined.withColumn(split_col, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("_floe_blbl", "_floe_bh", "_floe_bkey"))


# Up to this many classes the per-class boundaries are inlined as literals.
BOUNDS_AS_LITERALS = 10_000


def _assign_by_literals(df: DataFrame, label_col: str, key_col: str, h, rows, split_col: str) -> DataFrame:
    """Row is test iff (hash, key) <= its class boundary; classes without one are train."""
    if not rows:
        return df.withColumn(split_col, F.lit("train"))
    key_type = dict(df.dtypes)[key_col]
    keyed = [r for r in rows if r["_floe_lbl"] is not None]
    empty = F.create_map().cast(f"map<string,{key_type}>")
    m_h = F.create_map(*[x for r in keyed for x in (F.lit(r["_floe_lbl"]), F.lit(r["_floe_h"]))]) if keyed \
        else F.create_map().cast("map<string,string>")
    m_k = F.create_map(*[x for r in keyed for x in (F.lit(r["_floe_lbl"]), F.lit(r["_floe_key"]).cast(key_type))]) \
        if keyed else empty
    label = c(label_col)
    null_bound = [r for r in rows if r["_floe_lbl"] is None]
    bh = F.element_at(m_h, label) if not null_bound else F.when(
        label.isNull(), F.lit(null_bound[0]["_floe_h"])).otherwise(F.element_at(m_h, label))
    bk = F.element_at(m_k, label) if not null_bound else F.when(
        label.isNull(), F.lit(null_bound[0]["_floe_key"]).cast(key_type)).otherwise(F.element_at(m_k, label))
    is_test = bh.isNotNull() & key_at_or_before([h, c(key_col)], [bh, bk])
    return df.withColumn(split_col, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def stratified_sample(df: DataFrame, label_col: str, key_col: str, fraction: float,
                      seed: int = 42) -> DataFrame:
    """D3: exact stratified down-sample to ``fraction`` of the rows."""
    part = stratified_split(df, label_col, key_col, test_size=fraction, seed=seed, split_col="_floe_s")
    return part.where(F.col("_floe_s") == "test").drop("_floe_s")
