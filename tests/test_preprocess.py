from pyspark.sql import functions as F

from floe.operators.evaluate import classification_report, confusion, format_report
from floe.plans.presets import X_REDUCED_DROP, preset
from floe.plans.preprocess import Preprocess
from floe.sources import fixtures as fx
from floe.sources.csv import normalize_na

SF = "/root/testdata/sf0.001"


def test_preprocess_fit_on_train_apply_on_test(spark):
    raw = normalize_na(fx.flows_raw(spark, SF))
    train = raw.where(F.col("row_id") % 4 != 0)
    test = raw.where(F.col("row_id") % 4 == 0).drop("flag")
    prep = Preprocess("row_id", "label", drop=["not_there"], bools=["flag"], categories=["proto", "flag"],
                      drop_empty=True).fit(train, test=test)
    # P8: 'flag' is missing from test -> not a category; P9: 'empty' has no value -> not a feature
    assert prep.categories == ["proto"]
    assert prep.numeric == ["value", "flag"]
    names = prep.feature_names
    assert names[0] == "value" and all(n.startswith("proto=") for n in names if "=" in n)
    tr = prep.transform(train)
    stats = tr.agg(*[F.avg(F.col(f"`{n}`")).alias(f"m{i}") for i, n in enumerate(names)],
                   *[F.stddev_pop(F.col(f"`{n}`")).alias(f"s{i}") for i, n in enumerate(names)]).first()
    for i in range(len(names)):
        assert abs(stats[f"m{i}"]) < 1e-9                     # scaled on train: mean 0
        assert abs(stats[f"s{i}"] - 1.0) < 1e-9 or stats[f"s{i}"] == 0.0
    te = prep.transform(test.withColumn("flag", F.lit(None).cast("string")))
    assert te.count() == test.count() and te.where(F.col("y").isNull()).count() == 0


def test_presets():
    p = preset("x_reduced")
    assert "TotalPkts, Std_ldavg_1" in p["drop"] and p["label"] == "class2"
    q = preset("x_reduced", split_joined_names=True)
    assert "TotalPkts" in q["drop"] and "Std_ldavg_1" in q["drop"]
    assert len(X_REDUCED_DROP) == 28
    assert len(preset("wustl_reduced")["drop"]) == 35


def test_report_four_decimal_variant(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, pred int")
    rep = format_report(classification_report(confusion(df, 2), ["a", "b"]), percent=False, digits=4)
    got = {r["class"]: r["precision"] for r in rep.collect()}
    assert got["a"] == "1.0000" and got["b"] == "0.5000" and got["accuracy"] == "0.6667"


def test_transform_unlabelled_frame(spark):
    raw = normalize_na(fx.flows_raw(spark, SF))
    prep = Preprocess("row_id", "label", bools=["flag"], categories=["proto"], drop_empty=True).fit(raw)
    out = prep.transform(raw.drop("label"))
    assert out.count() == raw.count() and out.where(F.col("y").isNotNull()).count() == 0
    assert out.columns[2:] == prep.feature_names
