"""Score a stream of all-text flow files with a fitted model.

The reference evaluates a held-out set in batch; the same fitted
preprocessing (literal projections) and model scoring apply unchanged to a
streaming DataFrame, and the confusion counts (E2) become a small stateful
aggregation with one state row per (true, predicted) class pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from floe.operators.evaluate import with_prediction
from floe.plans.preprocess import PreprocessModel
from floe.sources.csv import CSV_TEXT, normalize_na


def read_flow_stream(spark: SparkSession, path: str, columns: list[str],
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """S1/S2 on a directory that receives CSV files: all-text schema, tokens -> NULL."""
    schema = StructType([StructField(n, StringType(), True) for n in columns])
    reader = spark.readStream.options(**CSV_TEXT).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return normalize_na(reader.csv(path))


def score_stream(stream: DataFrame, prep: PreprocessModel, model, prob_col: str = "probability") -> DataFrame:
    """Preprocess with fitted values, score, add the predicted class."""
    features = prep.transform(stream)
    return with_prediction(model.transform(features, prob_col), prob_col)


def running_confusion(scored: DataFrame) -> DataFrame:
    """E2 over a stream: counts per (y, pred); state is bounded by classes squared."""
    from pyspark.sql import functions as F
    return scored.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))


def start_scored_sink(scored: DataFrame, path: str, checkpoint: str | None = None,
                      available_now: bool = False):
    """Append scored rows as parquet (file sink: exactly-once with its checkpoint).

    The checkpoint defaults to a fresh folder below the session's shared
    ``spark.checkpoint.dir``.
    """
    from floe.session import scratch_path
    spark = scored.sparkSession
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
