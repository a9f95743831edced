import random

from pyspark.sql import functions as F

from floe.functions.arrays import temperature_softmax
from floe.operators import distill as K
from floe.operators.evaluate import evaluate


def _keras_stop(values, patience=5, min_delta=1e-4):
    best, best_e, wait = None, None, 0
    last = None
    for e, v in values:
        last = e
        if best is None or v + min_delta < best:
            best, best_e, wait = v, e, 0
        else:
            wait += 1
            if wait >= patience:
                return best_e, best, e
    return best_e, best, last


def test_early_stopping_matches_loop(spark):
    rnd = random.Random(2)
    hist, want = [], {}
    for run in range(30):
        vals = []
        v = 1.0
        for e in range(1, 25):
            v = v - rnd.choice([0.05, 0.00005, -0.01, 0.0])
            vals.append((e, v))
            hist.append((run, e, v))
        want[run] = _keras_stop(vals)
    df = spark.createDataFrame(hist, "run long, epoch int, metric double")
    for r in K.early_stopping(df).collect():
        be, bm, se = want[r["run"]]
        assert (r["best_epoch"], r["stop_epoch"]) == (be, se) and abs(r["best_metric"] - bm) < 1e-12


def _separable(spark, n=600):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        y = i % 3
        rows.append((i, y, y * 3.0 + rnd.gauss(0, 0.5), -y * 2.0 + rnd.gauss(0, 0.5)))
    return spark.createDataFrame(rows, "row_id long, y int, f1 double, f2 double")


def test_centroid_and_mllib_learners(spark):
    df = _separable(spark)
    feats = ["f1", "f2"]
    cm = K.CentroidClassifier(feats).fit(df)
    acc = evaluate(cm.transform(df, "p"), "p").first()["accuracy"]
    assert acc > 0.9                                    # far above the 1/3 majority rate
    teacher = K.fit_teacher(df, feats, "y", kind="forest", num_trees=5, max_depth=4)
    scored = teacher.transform(df, "teacher")
    sums = scored.select(F.aggregate("teacher", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    soft = scored.withColumn("soft", temperature_softmax(F.col("teacher"), 10.0))
    targets = K.distillation_targets(soft, "soft", "y", 0.5, feats)
    w = targets.groupBy().sum("weight").first()[0]
    assert abs(w - df.count()) < 1e-6                   # weights of each row sum to 1
    student = K.fit_distilled_student(soft, feats, "soft", "y", 0.5, max_iter=30)
    acc_s = evaluate(student.transform(df, "p"), "p").first()["accuracy"]
    assert acc_s > 0.9


def test_mlp_teacher_backend(spark):
    df = _separable(spark, 300)
    t = K.fit_teacher(df, ["f1", "f2"], "y", kind="mlp", hidden=(8,), num_classes=3)
    scored = t.transform(df, "p")
    sums = scored.select(F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    assert evaluate(scored, "p").first()["accuracy"] > 0.8


def test_distillation_pipeline_outputs(spark):
    from floe.plans.pipelines import distillation_pipeline
    out = distillation_pipeline(spark, "/root/testdata/sf0.001")
    rep = {r["class"]: r for r in out["student"].collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= set(rep)
    loss = out["losses"].first()
    assert loss["hard"] > 0 and loss["soft"] >= 0
    assert abs(loss["total"] - (0.5 * loss["hard"] + 0.5 * loss["soft"])) < 1e-9
    val = {r["model"]: r for r in out["validation"].collect()}
    assert set(val) == {"teacher", "student"} and all(0 <= r["accuracy"] <= 1 for r in val.values())


def test_early_stopping_validates_metric(spark):
    import pytest
    df = spark.createDataFrame([(1, 1, 0.5)], "run long, epoch int, val_loss double")
    with pytest.raises(ValueError):
        K.early_stopping(df, metric_col="val_student_loss")
    assert K.early_stopping(df, metric_col="val_loss").first()["best_epoch"] == 1
