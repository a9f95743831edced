"""Row alignment (J1): what the reference does by array position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zip_by_key(left: DataFrame, right: DataFrame, key: str = "row_id", check: bool = True) -> DataFrame:
    """Align two tables row by row on a unique key (inner equi-join).

    With ``check`` a key that repeats or stands on one side only makes the query fail
    (the reference's positional zip requires equal lengths); the check is
    part of the same plan (occurrence numbers and a full outer join with
    ``raise_error``).
    """
    if not check:
        return left.join(right, key, "inner")
    # the key's occurrence number joins along: a repeated key raises and never multiplies;
    # the window needs the same partitioning and order as the join
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
    l2 = left.withColumn("_floe_l", nth)
    r2 = right.withColumn("_floe_r", nth)
    joined = l2.join(r2, key, "full_outer")
    ok = (F.col("_floe_l") == 1) & (F.col("_floe_r") == 1)
    guarded = joined.withColumn("_floe_ok", F.when(ok, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("row key repeated or on one side only: "),
                               F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))))
    return guarded.where(F.col("_floe_ok")).drop("_floe_l", "_floe_r", "_floe_ok")


def training_tuples(x: DataFrame, y: DataFrame, soft: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, x, y, soft) rows from three aligned tables."""
    return zip_by_key(zip_by_key(x, y, key), soft, key)
