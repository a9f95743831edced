"""Inputs derived from the driver tables (see FIXTURES.md section 3).

The driver tables carry no nulls or dirty text, so dirty values are
derived deterministically from the keys; the SQL oracle builds the same
tables with the same expressions.  Every fixture is a lazy projection or
aggregation of a driver table, so its size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floe.functions.arrays import softmax, softmax_of
from floe.sources.tables import read_table


def _dirty_value(i, value):
    return (F.when(i % 11 == 0, F.lit("?")).when(i % 13 == 0, F.lit("-"))
            .when(i % 17 == 0, F.lit("inf")).when(i % 19 == 0, F.lit("n/a"))
            .otherwise(value.cast("decimal(18,2)").cast("string")))


def flows_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text flow table from ``events`` (row_id, value, flag, proto, empty, label)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"])
    i = F.col("event_id")
    return ev.select(
        i.alias("row_id"),
        _dirty_value(i, F.col("value")).alias("value"),
        F.when(i % 3 == 0, F.lit("TRUE")).when(i % 3 == 1, F.lit("FALSE"))
        .otherwise(F.lit("maybe")).alias("flag"),
        F.when(i % 23 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))).alias("proto"),
        F.lit(None).cast("string").alias("empty"),
        F.when(i % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("label"),
    )


def lineitem_key():
    """Unique text key of a lineitem row (order key, line, part, supplier, cents)."""
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                       F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                       F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))


# The natural order of lineitem rows: numeric columns, unique together.
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_cents"]


def lineitem_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row key and order columns of ``lineitem``."""
    li = read_table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents")
    return li.select(lineitem_key().alias("row_id"), *LINEITEM_ORDER[:-1], cents)


NUM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def flows_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric flow table from ``lineitem``; label ``l_returnflag``, category ``l_linestatus``."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(lineitem_key().alias("row_id"), *NUM_FEATURES, "l_linestatus", "l_returnflag")


EMBEDDING = 64      # elements of an embedding, as the driver makes them


def _elements():
    """The embedding as doubles; one of another length fails the query rather than being cut."""
    e = F.col("embedding").cast("array<double>")
    return F.when(e.isNull() | (F.size(e) == EMBEDDING), e).otherwise(
        F.raise_error(F.concat(F.lit("embedding of other length: "), F.size(e).cast("string"))))


def proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher/student probabilities from ``embeddings`` (10 classes), each from all elements.

    A teacher score is the mean of every tenth element, a student score of a run of six or seven.
    """
    em = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", _elements().alias("e"))

    def means(class_of):
        groups = [[j for j in range(EMBEDDING) if class_of(j) == k] for k in range(10)]
        return F.array(*[sum((F.element_at("e", j + 1) for j in g[1:]), F.element_at("e", g[0] + 1)) / F.lit(float(len(g)))
                         for g in groups])
    return em.select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("y"),
                     softmax(means(lambda j: j % 10)).alias("teacher"),
                     softmax(means(lambda j: j * 10 // EMBEDDING)).alias("student"))


def _cut(arr, rows: int, width: int):
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)),
                       lambda r: F.slice(arr, r * width + 1, width))


def feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher map 16 positions x 4 channels, student map 8 x 8, from ``embeddings``."""
    em = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).select("vec_id", _elements().alias("e"))
    return em.select(F.col("vec_id").alias("row_id"), _cut(F.col("e"), 16, 4).alias("fm_t"),
                     _cut(F.col("e"), 8, 8).alias("fm_s"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return em.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("w"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-history table: run = user, epoch = day (since 1970), metric = mean value."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "value"])
    return (ev.groupBy(F.col("user_id").alias("run"), F.unix_date(F.to_date("ts")).cast("int").alias("epoch"))
            .agg(F.avg("value").alias("metric")))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimizer steps: one per event (step = event_id)."""
    ev = read_table(spark, sf_dir, "events", ["event_id"])
    return ev.select(F.col("event_id").alias("step"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered series per entity: (entity, ts, id, x) from ``events``."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_id", "value"])
    return ev.select(F.col("user_id").alias("entity"), "ts", F.col("event_id").alias("id"),
                     F.col("value").alias("x"))




def proba_big(spark: SparkSession, sf_dir: str, label_codes: DataFrame | None = None) -> DataFrame:
    """Three-class probabilities per ``lineitem`` row (label code of l_returnflag).

    teacher = softmax(l_quantity/50, 10*l_discount, 10*l_tax); the student
    sees the same logits rotated by one position.
    """
    from floe.operators.fitted import LabelEncoder
    li = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity") / 50.0
    d = F.col("l_discount") * 10.0
    t = F.col("l_tax") * 10.0
    base = li.select(lineitem_key().alias("row_id"), "l_returnflag",
                     softmax_of([q, d, t]).alias("teacher"),
                     softmax_of([d, t, q]).alias("student"))
    enc = LabelEncoder("l_returnflag", "y").fit(base)
    return enc.transform(base).select("row_id", "y", "teacher", "student")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tie-heavy score per ``lineitem`` row: the price rounded to units."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(lineitem_key().alias("row_id"), F.col("l_returnflag").alias("y"),
                     F.round("l_extendedprice", 0).alias("score"))
