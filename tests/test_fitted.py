import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from floe.operators.fitted import (LabelEncoder, MedianImputer, OneHotEncoder, StandardScaler, exact_medians,
                                   label_codes)


def test_exact_median_even_count(spark):
    # Exact median averages the two middle values (2.5, not 2.0)
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (3.0, 5.0), (4.0, 7.0)], "a double, b double")
    got = {r["feature"]: r["median"] for r in exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": 2.5, "b": 5.0}


def test_median_imputer_fills_and_drops_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, e double")
    model = MedianImputer(["a", "e"]).fit(df)
    assert model.dropped == ["e"]
    out = model.transform(df)
    assert out.columns == ["a"]
    assert sorted(r["a"] for r in out.collect()) == [1.0, 2.0, 3.0]


def test_median_matches_builtin_with_many_partitions(spark):
    df = spark.range(0, 10001).select((F.col("id") * 7 % 101).cast("double").alias("x"),
                                      (F.col("id") % 13).cast("double").alias("y"))
    got = {r["feature"]: r["median"] for r in exact_medians(df, ["x", "y"], num_partitions=7).collect()}
    want = df.agg(F.median("x"), F.median("y")).first()
    assert got["x"] == want[0] and got["y"] == want[1]


def test_scaler_population_std_and_zero_variance(spark):
    # Z3: population std; a constant column scales by 1
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, k double")
    m = StandardScaler(["a", "k"]).fit(df)
    assert m.mean == {"a": 2.0, "k": 5.0} and m.scale == {"a": 1.0, "k": 1.0}
    vals = sorted(r["a"] for r in m.transform(df).collect())
    assert vals == [-1.0, 1.0]


def test_label_encoder_sorted_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "l string")
    enc = LabelEncoder("l", "y").fit(df)
    assert enc.classes == ["a", "b", "c"]                      # Z16
    assert [r["y"] for r in enc.transform(df).collect()] == [1, 0, 2, 0]
    test = spark.createDataFrame([("d",)], "l string")
    with pytest.raises(PySparkException):                      # Z15
        enc.transform(test).collect()
    assert [tuple(r) for r in label_codes(df, "l").orderBy("code").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    dec = enc.decode(spark.createDataFrame([(2,)], "p int"), "p", "name")
    assert dec.first()["name"] == "c"


def test_one_hot_unknown_is_zero(spark):
    train = spark.createDataFrame([("x",), ("y",)], "c string")
    test = spark.createDataFrame([("y",), ("z",)], "c string")
    m = OneHotEncoder(["c"]).fit(train)
    assert m.output_names() == ["c=x", "c=y"]
    rows = [tuple(r) for r in m.transform(test).collect()]
    assert rows == [(0.0, 1.0), (0.0, 0.0)]


def test_bracketed_median_equals_full_ranking(spark):
    from floe.operators.fitted import exact_medians_full
    df = spark.range(0, 20001).select(
        (F.col("id") * 7919 % 1013 / 7.0).alias("a"),                      # many distinct values
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 17).cast("double").alias("b"),  # ties, nulls
        (F.col("id") % 2).cast("double").alias("c"))                        # two values, even count
    for acc in (10, 10_000):
        got = {r["feature"]: r["median"] for r in exact_medians(df, ["a", "b", "c"], accuracy=acc).collect()}
        full = {r["feature"]: r["median"] for r in exact_medians_full(df, ["a", "b", "c"]).collect()}
        want = df.agg(F.median("a"), F.median("b"), F.median("c")).first()
        assert got == full
        assert [got["a"], got["b"], got["c"]] == [want[0], want[1], want[2]]
