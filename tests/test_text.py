import math

from pyspark.sql import functions as F

from floe.functions.text import bool_text, fill_missing, to_numeric
from floe.sources.csv import normalize_na


def test_na_tokens_and_numeric(spark):
    vals = ["?", "-", "n/a", "NaN", "", "1.5", " 2 ", "1e3", "inf", "-inf", "nan", "1d", "abc", "+4", ".5", "1e999"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    out = {r["i"]: (r["v"], r["n"]) for r in normalize_na(df).select(
        "i", "v", to_numeric(F.col("v")).alias("n")).collect()}
    for i in range(5):
        assert out[i] == (None, None)               # S2 tokens -> NULL
    assert out[5][1] == 1.5 and out[6][1] == 2.0 and out[7][1] == 1000.0
    for i in (8, 9, 10, 11, 12, 15):                # Z1: inf/nan and junk -> NULL after the cast
        assert out[i][1] is None, vals[i]
    assert out[13][1] == 4.0 and out[14][1] == 0.5


def test_bool_text_and_fill(spark):
    df = spark.createDataFrame([("TRUE",), ("FALSE",), ("true",), (None,)], "b string")
    got = [r[0] for r in df.select(bool_text(F.col("b"))).collect()]
    assert got == [1, 0, None, None]
    got = [r[0] for r in df.select(fill_missing(F.col("b"))).collect()]
    assert got == ["TRUE", "FALSE", "true", "missing"]


def test_no_nan_left(spark):
    df = spark.createDataFrame([("NaN",), ("Infinity",), ("3",)], "v string")
    got = [r[0] for r in df.select(to_numeric(F.col("v"))).collect()]
    assert got[:2] == [None, None] and not any(isinstance(x, float) and math.isnan(x) for x in got)
