"""Column rules (P1, P2, P4, P8-P13) decided at plan time from ``df.columns``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floe.functions.arrays import explode_positions
from floe.functions.text import bool_text, c, fill_missing, to_numeric


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop columns; names that are absent are ignored."""
    gone = set(cols)
    return df.select(*[c(n) for n in df.columns if n not in gone])


def feature_columns(df: DataFrame, label: str, categories: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """features = every column that is not the label, a category or excluded."""
    skip = {label, *categories, *exclude}
    return [n for n in df.columns if n not in skip]


def map_bool_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """TRUE/FALSE text columns -> 1/0 (others NULL), only for columns present."""
    todo = set(cols) & set(df.columns)
    return df.select(*[bool_text(c(n)).alias(n) if n in todo else c(n) for n in df.columns])


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5 + P3: text -> finite double for the named columns (already numeric ones keep their value)."""
    todo = set(cols)
    out = []
    types = dict(df.dtypes)
    for n in df.columns:
        if n in todo:
            if types[n] == "string":
                out.append(to_numeric(c(n)).alias(n))
            else:
                x = c(n).cast("double")
                out.append(F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)
                           .cast("double").alias(n))
        else:
            out.append(c(n))
    return df.select(*out)


def fill_categories(df: DataFrame, cols: list[str]) -> DataFrame:
    """P6 (+P7): NULL -> 'missing' in categories / label, as text."""
    todo = set(cols)
    return df.select(*[fill_missing(c(n)).alias(n) if n in todo else c(n) for n in df.columns])


def common_columns(wanted: list[str], *frames: DataFrame) -> list[str]:
    """The wanted columns present in every frame (in wanted order)."""
    return [n for n in wanted if all(n in f.columns for f in frames)]


def non_empty_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with at least one non-NULL value (one aggregation job)."""
    if not cols:
        return []
    row = df.agg(*[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(cols)]).first()
    return [n for i, n in enumerate(cols) if row[f"n{i}"] > 0]


def non_empty_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """P9 as a table: (feature, non_null) for every column, one pass."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"),
                                                 c(n).isNotNull().cast("long").alias("nn")) for n in cols]))
                     ).groupBy("feature").agg(F.sum("nn").alias("non_null"))


def assemble_array(df: DataFrame, numeric: list[str], onehot: list[str] = (), out: str = "features",
                   keep: list[str] = ()) -> DataFrame:
    """P10: numeric block then one-hot block, as one array<double> column."""
    cols = [c(n).cast("double") for n in [*numeric, *onehot]]
    return df.select(*[c(k) for k in keep], F.array(*cols).alias(out))


def as_sequence(df: DataFrame, col: str = "features", out: str = "sequence") -> DataFrame:
    """[d] -> [d, 1] (every feature is one step with one channel)."""
    return df.withColumn(out, F.transform(c(col), lambda x: F.array(x)))


def sequence_long(df: DataFrame, key: str, col: str = "features") -> DataFrame:
    """P11 long form: (key, pos, x)."""
    return explode_positions(df, [c(key)], c(col), "pos", "x")


def narrow_float(df: DataFrame, cols: list[str]) -> DataFrame:
    """Arrays to float32 elements, scalars to float."""
    types = dict(df.dtypes)
    todo = set(cols)
    out = []
    for n in df.columns:
        if n in todo:
            t = "array<float>" if types[n].startswith("array") else "float"
            out.append(c(n).cast(t).alias(n))
        else:
            out.append(c(n))
    return df.select(*out)


def nest_targets(df: DataFrame, x: str, y: str, soft: str, key: str | None = None) -> DataFrame:
    """(x, y, soft) -> (x, struct(y, soft))."""
    keep = [c(key)] if key else []
    return df.select(*keep, c(x), F.struct(c(y).alias("y"), c(soft).alias("soft")).alias("target"))
