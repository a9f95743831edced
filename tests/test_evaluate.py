import numpy as np
from pyspark.sql import functions as F

from floe.operators import evaluate as E


def _roc_brute(y, s):
    """Reference ROC: ties grouped, collinear points dropped, origin added."""
    order = np.argsort(-np.asarray(s), kind="mergesort")
    y, s = np.asarray(y)[order], np.asarray(s)[order]
    idx = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    tps, fps, thr = tps[keep], fps[keep], s[idx][keep]
    return list(zip([None, *thr], np.r_[0, fps] / fps[-1], np.r_[0, tps] / tps[-1]))


def test_confusion_report(spark):
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 1)]
    df = spark.createDataFrame(pairs, "y int, pred int")
    conf = E.confusion(df, 3)
    cells = {(r["y"], r["pred"]): r["n"] for r in conf.collect()}
    assert len(cells) == 9 and cells[(2, 2)] == 0 and sum(cells.values()) == 6
    rep = {r["class"]: r for r in E.classification_report(conf, ["a", "b", "c"]).collect()}
    assert abs(rep["a"]["precision"] - 2 / 3) < 1e-12 and abs(rep["a"]["recall"] - 2 / 3) < 1e-12
    assert rep["c"]["precision"] == 0.0 and rep["c"]["f1"] == 0.0 and rep["c"]["support"] == 1
    assert abs(rep["accuracy"]["f1"] - 0.5) < 1e-12 and rep["accuracy"]["support"] == 6
    assert abs(rep["macro avg"]["recall"] - (2 / 3 + 1 / 2 + 0) / 3) < 1e-12
    fmt = {r["class"]: r for r in E.format_report(E.classification_report(conf, ["a", "b", "c"])).collect()}
    assert fmt["a"]["precision"] == "66.67" and fmt["accuracy"]["support"] == 6


def test_roc_auc_against_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 400
    y = rng.integers(0, 2, n)
    s = np.round(rng.random(n) + 0.3 * y, 1)          # many ties
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "row_id long, is_pos int, score double").withColumn("class", F.lit(0))
    roc = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in E.roc_curve(df, num_partitions=5).collect()),
                 key=lambda t: (t[0] is not None, -(t[0] or 0)))
    want = _roc_brute(y, s)
    assert len(roc) == len(want)
    for a, b in zip(roc, want):
        assert (a[0] is None and b[0] is None) or abs(a[0] - b[0]) < 1e-12
        assert abs(a[1] - b[1]) < 1e-12 and abs(a[2] - b[2]) < 1e-12
    auc = E.auc(df).first()["auc"]
    fpr = [w[1] for w in want]
    tpr = [w[2] for w in want]
    assert abs(auc - np.trapezoid(tpr, fpr)) < 1e-12


def test_evaluate_and_compare(spark):
    df = spark.createDataFrame([([0.9, 0.1], [0.4, 0.6], 0), ([0.2, 0.8], [0.3, 0.7], 1)],
                               "a array<double>, b array<double>, y int")
    ev = E.evaluate(df, "a").first()
    assert abs(ev["loss"] - (-np.log(0.9) - np.log(0.8)) / 2) < 1e-12 and ev["accuracy"] == 1.0
    cmp = E.compare_models(df, "b", "a").first()
    assert cmp["acc_before"] == 0.5 and cmp["acc_delta"] == 0.5
    ovr = E.one_vs_rest(df.withColumn("row_id", F.monotonically_increasing_id()), "a")
    assert ovr.count() == 4 and ovr.agg(F.sum("is_pos")).first()[0] == 2
