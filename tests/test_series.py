import datetime as dt
import random

import numpy as np

from floe.operators import series as Q


def _series(spark, seed=5):
    rnd = random.Random(seed)
    rows = []
    base = dt.datetime(2024, 1, 1)
    i = 0
    for e, n in ((1, 40), (2, 7), (3, 1), (4, 300)):        # entity 4 is the hot one
        for _ in range(n):
            rows.append((e, base + dt.timedelta(seconds=rnd.randint(0, 50)), i, round(rnd.uniform(-5, 5), 2)))
            i += 1
    df = spark.createDataFrame(rows, "entity long, ts timestamp, id long, x double")
    by = {}
    for e, ts, idx, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(e, []).append((idx, x))
    return df, by


def _causal(xs, w, rate):
    return [sum(wk * (xs[t - k * rate] if t - k * rate >= 0 else 0.0) for k, wk in enumerate(w)) for t in range(len(xs))]


def test_causal_same_multiscale(spark):
    df, by = _series(spark)
    w = [0.5, 0.3, 0.2]
    got = {(r["entity"], r["pos"]): r for r in Q.causal_filter(df, w, rate=2, num_partitions=5).collect()}
    same = {(r["entity"], r["pos"]): r["y"] for r in Q.same_filter(df, (0.25, 0.5, 0.25)).collect()}
    multi = {(r["entity"], r["pos"]): r for r in Q.multi_scale_filter(df, w).collect()}
    for e, items in by.items():
        xs = [x for _, x in items]
        want = _causal(xs, w, 2)
        for t, (idx, x) in enumerate(items):
            assert got[(e, t)]["id"] == idx and abs(got[(e, t)]["y"] - want[t]) < 1e-9
            s = 0.5 * xs[t] + 0.25 * (xs[t - 1] if t > 0 else 0) + 0.25 * (xs[t + 1] if t + 1 < len(xs) else 0)
            assert abs(same[(e, t)] - s) < 1e-9
            for r in (1, 2, 4):
                assert abs(multi[(e, t)][f"y_r{r}"] - _causal(xs, w, r)[t]) < 1e-9


def test_pools_and_norm(spark):
    df, by = _series(spark)
    mp = {(r["entity"], r["window"]): r["x_max"] for r in Q.max_pool(df, 2).collect()}
    assert len(mp) == sum(len(v) // 2 for v in by.values())
    for e, items in by.items():
        xs = [x for _, x in items]
        for j in range(len(xs) // 2):
            assert mp[(e, j)] == max(xs[2 * j], xs[2 * j + 1])
    avg = {r["entity"]: r["x_avg"] for r in Q.global_average_pool(df).collect()}
    att = {r["entity"]: r["x_att"] for r in Q.attention_pool(df, 0.5, 0.1).collect()}
    bn = {r["id"]: r["z"] for r in Q.batch_norm(df, "x", "entity", "z").collect()}
    for e, items in by.items():
        xs = np.array([x for _, x in items])
        assert abs(avg[e] - xs.mean()) < 1e-9
        wts = np.exp(np.tanh(0.5 * xs + 0.1))
        assert abs(att[e] - (xs * wts).sum() / wts.sum()) < 1e-9
        z = (xs - xs.mean()) / np.sqrt(xs.var() + 1e-3)
        for (idx, _), zz in zip(items, z):
            assert abs(bn[idx] - zz) < 1e-9


def test_residual_block(spark):
    df, by = _series(spark)
    got = {(r["entity"], r["pos"]): r["y"] for r in Q.residual_block(df, [0.5, 0.3, 0.2], rate=1).collect()}
    for e, items in by.items():
        xs = np.array([x for _, x in items])
        h = np.maximum(np.array(_causal(list(xs), [0.5, 0.3, 0.2], 1)), 0.0)
        y = xs + (h - h.mean()) / np.sqrt(h.var() + 1e-3)
        for t in range(len(xs)):
            assert abs(got[(e, t)] - y[t]) < 1e-9
