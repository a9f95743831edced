"""All-text CSV scans (S1-S3) and report sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from floe.functions.text import NA_TOKENS, c, na_to_null


# Quotes inside a quoted field are doubled, as in RFC 4180.
CSV_TEXT = {"header": "true", "quote": '"', "escape": '"'}


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line (one small read of the first line)."""
    first = spark.read.options(**CSV_TEXT).option("inferSchema", "false").csv(path)
    return first.columns


CORRUPT = "_floe_corrupt"


def _scan(spark: SparkSession, path: str, columns: list[str] | None, multi_line: bool) -> DataFrame:
    """All-text rows and, in CORRUPT, the record of those with too many or too few fields."""
    names = columns or header_columns(spark, path)
    schema = StructType([StructField(n, StringType(), True) for n in [*names, CORRUPT]])
    # columnPruning=false: a row's fields are counted whichever columns are asked for;
    # enforceSchema=false: a file whose header differs in names or order is refused
    return (spark.read.options(**CSV_TEXT).option("mode", "PERMISSIVE").option("enforceSchema", "false")
            .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", "false")
            .option("multiLine", str(multi_line).lower()).schema(schema).csv(path))


def _any(raw: DataFrame) -> Column:
    """Always true, and names a column: Spark refuses queries, such as a count, on the record alone."""
    first = c(raw.columns[0])
    return first.isNull() | (F.length(first) >= 0)


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                  na_tokens=None, multi_line: bool = False) -> DataFrame:
    """S1 + S2: header CSV with every column as text; missing tokens -> NULL.

    No schema inference (a full extra pass at scale); the schema is the
    header with every column typed ``string``.  A row with more or fewer fields
    than the header fails the query with its text; ``read_csv_with_rejects`` sets
    such rows apart.  ``multi_line`` allows line breaks inside quoted fields, at the
    price that a file is read by one task.
    """
    raw = _scan(spark, path, columns, multi_line)
    whole = F.when(F.col(CORRUPT).isNull(), _any(raw)).otherwise(
        F.raise_error(F.concat(F.lit("malformed CSV row: "), F.col(CORRUPT))).cast("boolean"))
    return normalize_na(raw.where(whole).drop(CORRUPT), na_tokens)


def read_csv_with_rejects(spark: SparkSession, path: str, columns: list[str] | None = None, na_tokens=None,
                          multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """S1 with a rejects table: (rows as ``read_text_csv`` gives them, (record,) of each refused row)."""
    raw = _scan(spark, path, columns, multi_line)
    rows = normalize_na(raw.where(F.col(CORRUPT).isNull() & _any(raw)).drop(CORRUPT), na_tokens)
    refused = raw.where(F.col(CORRUPT).isNotNull() & _any(raw))
    return rows, refused.select(F.col(CORRUPT).alias("record"))


def normalize_na(df: DataFrame, na_tokens=None) -> DataFrame:
    """Every string column: missing-value tokens -> NULL, in one select."""
    tokens = NA_TOKENS if na_tokens is None else list(na_tokens)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            cols.append(na_to_null(c(f.name), tokens).alias(f.name))
        else:
            cols.append(c(f.name))
    return df.select(*cols)


def read_pair(spark: SparkSession, train_path: str, test_path: str,
              prepare: Callable[[DataFrame], DataFrame] | None = None,
              na_tokens=None) -> tuple[DataFrame, DataFrame]:
    """S3: pre-split train/test files through one shared preparation.

    Test columns are resolved by name against the train header: columns
    the test file lacks are added as NULL, extra ones are dropped.
    """
    train = read_text_csv(spark, train_path, na_tokens=na_tokens)
    test = read_text_csv(spark, test_path, na_tokens=na_tokens)
    test = align_columns(test, train.columns)
    if prepare is not None:
        train, test = prepare(train), prepare(test)
    return train, test


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[c(n) if n in have else F.lit(None).cast("string").alias(n) for n in columns])


def write_csv(df: DataFrame, path: str) -> str:
    """Write a table as header CSV (used to stage all-text inputs)."""
    df.write.mode("overwrite").options(**CSV_TEXT).csv(path)
    return path


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Persist a report table (the reference only prints it)."""
    df.write.mode("overwrite").format(fmt).save(path)
    return path
