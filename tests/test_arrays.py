import math

import numpy as np
from pyspark.sql import functions as F

from floe.functions import arrays as A


def _np_softmax(x):
    e = np.exp(np.asarray(x) - np.max(x))
    return e / e.sum()


def test_softmax_family(spark):
    p = [0.7, 0.2, 0.1]
    df = spark.createDataFrame([(p, [0.1, 0.3, 0.6], 0)], "t array<double>, s array<double>, y int")
    r = df.select(A.softmax(F.col("t")).alias("sm"), A.temperature_softmax(F.col("t"), 10.0).alias("k5"),
                  A.log_temperature_softmax(F.col("t"), 10.0).alias("k6"),
                  A.sparse_cross_entropy(F.col("s"), F.col("y")).alias("ce"),
                  A.kl_divergence(F.col("t"), F.col("s")).alias("kl"), A.argmax(F.col("t")).alias("am")).first()
    assert np.allclose(r["sm"], _np_softmax(p)) and abs(sum(r["sm"]) - 1) < 1e-12
    assert np.allclose(r["k5"], _np_softmax(np.array(p) / 10))
    assert np.allclose(r["k6"], _np_softmax(np.log(np.clip(p, 1e-7, 1)) / 10))
    assert math.isclose(r["ce"], -math.log(0.1))
    assert math.isclose(r["kl"], sum(a * math.log(a / b) for a, b in zip(p, [0.1, 0.3, 0.6])))
    assert r["am"] == 0


def test_argmax_first_on_ties_and_ce_clip(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], 2)], "p array<double>, y int")
    r = df.select(A.argmax(F.col("p")).alias("a"), A.sparse_cross_entropy(F.col("p"), F.col("y")).alias("ce")).first()
    assert r["a"] == 0 and math.isclose(r["ce"], -math.log(1e-7))


def test_attention_and_resample(spark):
    fm = [[1.0, 0.0], [2.0, 2.0], [0.0, 1.0]]
    df = spark.createDataFrame([(fm, [0.2, 0.8])], "fm array<array<double>>, a array<double>")
    r = df.select(A.attention_map(F.col("fm")).alias("att"), A.resample_linear(F.col("a"), 4).alias("rs"),
                  A.mean_squared_error(F.col("a"), F.array(F.lit(0.0), F.lit(0.0))).alias("mse")).first()
    e = np.array([1.0, 8.0, 1.0])
    assert np.allclose(r["att"], e / (e.sum() + 1e-8))
    # half-pixel centres: sources -0.25, 0.25, 0.75, 1.25 -> clamp / interpolate
    assert np.allclose(r["rs"], [0.2, 0.35, 0.65, 0.8])
    assert math.isclose(r["mse"], (0.04 + 0.64) / 2)


def test_prune_schedule_and_magnitude(spark):
    df = spark.createDataFrame([(s,) for s in (0, 100, 500, 1000, 1200)], "step long")
    got = [(r[0], r[1]) for r in df.select(A.polynomial_sparsity(F.col("step")), A.prune_step(F.col("step"))).collect()]
    assert math.isclose(got[0][0], 0.0) and math.isclose(got[3][0], 0.5) and math.isclose(got[4][0], 0.5)
    assert math.isclose(got[2][0], 0.5 - 0.5 * 0.5 ** 3)
    assert [g[1] for g in got] == [True, True, True, True, False]
    w = spark.createDataFrame([([0.1, -0.5, 0.3, 0.2, -0.3, 0.05],)], "w array<double>")
    pr = w.select(A.magnitude_prune(F.col("w"), 0.5)).first()[0]
    assert pr == [0.0, -0.5, 0.3, 0.0, -0.3, 0.0]   # keeps the 3 largest magnitudes (ties kept)


def test_magnitude_prune_position_ties(spark):
    w = spark.createDataFrame([([0.3, -0.3, 0.3, 0.1],)], "w array<double>")
    keep = w.select(A.magnitude_prune(F.col("w"), 0.5)).first()[0]
    pos = w.select(A.magnitude_prune(F.col("w"), 0.5, ties="position")).first()[0]
    assert keep == [0.3, -0.3, 0.3, 0.0]          # threshold rule keeps all ties
    assert pos == [0.3, -0.3, 0.0, 0.0]           # exactly k = 2, earlier positions first
