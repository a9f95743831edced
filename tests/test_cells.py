"""Cells: totals, neighbours and bounds against plain loops, with hot, small, null and empty groups."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from floe.operators.cells import CELL, HOT, cell_totals, find_cells, with_neighbours


def _rows(seed=0):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 3, 30)
    rows, i = [], 0
    for g, n in ((None, 70), ("a", 1), ("b", 9), ("hot", 500)):
        for _ in range(n):
            ts = None if rnd.random() < 0.05 else base + dt.timedelta(minutes=rnd.randint(0, 40) * 30)
            rows.append((g, ts, i, rnd.randint(0, 9)))
            i += 1
    rnd.shuffle(rows)
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "`the group` string, ts timestamp, id long, v long").repartition(5)


def _ordered(rows):
    by = {}
    for g, ts, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        by.setdefault(g, []).append((i, v))
    return by


@pytest.mark.parametrize("cells", [None, 1, 3, 40, 1000])
def test_totals_equal_a_loop(spark, cells):
    rows = _rows()
    df = _frame(spark, rows)
    got = {r["id"]: (r["cum"], r["at"], r["n"], r["next"]) for r in cell_totals(
        df, ["the group"], ["ts", "id"], {"cum": F.col("v")}, "at", "n", cells, {"next": F.col("id")}).collect()}
    assert len(got) == len(rows)
    for items in _ordered(rows).values():
        total = 0
        for at, (i, v) in enumerate(items):
            total += v
            assert got[i] == (total, at, len(items), items[at + 1][0] if at + 1 < len(items) else None)


def test_totals_without_groups_and_rows(spark):
    df = spark.range(3_000).select((F.col("id") * 7 % 3_000).alias("k"))
    for cells in (None, 11):
        assert all(r.k == r.at for r in cell_totals(df, [], ["k"], {}, "at", cells=cells).collect())
        assert cell_totals(df.limit(0), [], ["k"], {}, "at", cells=cells).count() == 0


def test_hot_groups_are_cut_evenly(spark):
    df = _frame(spark, _rows())
    found = find_cells(df, ["the group"], ["ts", "id"], 20)
    sizes = found.assign(df).groupBy("the group", CELL, HOT).count().collect()
    assert {r["the group"] for r in sizes if r[HOT]} == {None, "hot"}
    assert max(r["count"] for r in sizes) <= 2 * 580 / 20
    assert find_cells(df, ["the group"], ["ts", "id"]).cuts is None          # small tables stay plain


@pytest.mark.parametrize("cells,before,after", [(None, 3, 2), (9, 3, 0), (9, 0, 4), (300, 5, 5)])
def test_neighbours_reach_over_cells(spark, cells, before, after):
    rows = _rows(3)
    df = _frame(spark, rows)
    found = find_cells(df, ["the group"], ["ts", "id"], cells)
    sent, own = with_neighbours(df, found, before, after)
    w = Window.partitionBy("`the group`", CELL).orderBy("ts", "id")
    got = sent.select("id", F.lag("id", max(before, 1)).over(w).alias("back"), F.lead("id", max(after, 1)).over(w).alias("on"),
                      own.alias("own")).where("own").collect()
    assert len(got) == len(rows)
    want = {i: ([x for x, _ in items], at) for items in _ordered(rows).values() for at, (i, _) in enumerate(items)}
    for r in got:
        line, at = want[r["id"]]
        if before:
            assert r["back"] == (line[at - before] if at >= before else None)
        if after:
            assert r["on"] == (line[at + after] if at + after < len(line) else None)


def test_no_cache_is_left(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    cell_totals(_frame(spark, _rows()), ["the group"], ["ts", "id"], {}, "at", cells=9).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


# -- operators on cells ------------------------------------------------------------

def _stop(values, patience, delta):
    best, best_e, wait, last = None, None, 0, None
    for e, v in values:
        last = e
        if best is None or (v is not None and v + delta < best):
            best, best_e, wait = v, e, 0
        else:
            wait += 1
            if wait >= patience:
                return best_e, best, e
    return best_e, best, last


@pytest.mark.parametrize("cells,patience", [(None, 5), (8, 5), (60, 1), (60, 3), (2_000, 7)])
def test_early_stop_folds_over_cells(spark, cells, patience):
    from floe.operators.distill import early_stopping
    rnd = random.Random(patience)
    rows, want = [], {}
    for run, n, drift in ((1, 400, 0.02), (2, 400, 0.004), (3, 5, 0.0), (4, 300, 0.5), (5, 1, 0.0)):
        v, values = 10.0, []
        for e in range(n):
            v = v - drift + rnd.choice([0.0, 0.00005, 0.01, -0.01])
            values.append((e, None if e and rnd.random() < 0.03 else v))
        want[run] = _stop(values, patience, 1e-4)
        rows += [(run, e, v) for e, v in values]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "run long, epoch int, metric double")
    got = {r.run: (r.best_epoch, r.best_metric, r.stop_epoch)
           for r in early_stopping(df, patience=patience, num_partitions=cells).collect()}
    assert got == want


@pytest.mark.parametrize("cells", [None, 7, 400])
def test_filters_and_norms_do_not_depend_on_cells(spark, cells):
    from floe.operators import series as Q
    rows = [(g or "none", ts, i, float(v) if i % 17 else None) for g, ts, i, v in _rows(5) if ts is not None]
    df = spark.createDataFrame(rows, "entity string, ts timestamp, id long, x double").repartition(3)
    by = {}
    for g, ts, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(g, []).append((i, x))
    w = [0.5, 0.3, 0.2]
    causal = {r.id: (r.pos, r.y) for r in Q.causal_filter(df, w, rate=3, num_partitions=cells).collect()}
    same = {r.id: r.y for r in Q.same_filter(df, (0.2, 0.5, 0.3), num_partitions=cells).collect()}
    multi = {r.id: (r.y_r1, r.y_r4) for r in Q.multi_scale_filter(df, w, num_partitions=cells).collect()}
    norm = {r.id: r.z for r in Q.batch_norm(df, "x", "entity", "z", num_partitions=cells).collect()}
    block = {r.id: r.y for r in Q.residual_block(df, w, num_partitions=cells).collect()}
    pool = {(r.entity, r.window): r.x_max for r in Q.max_pool(df, 2, num_partitions=cells).collect()}
    assert len(causal) == len(same) == len(norm) == len(block) == len(rows)
    for g, items in by.items():
        xs = [x for _, x in items]

        def tap(t):
            return 0.0 if t < 0 or t >= len(xs) or xs[t] is None else xs[t]
        h = [max(sum(a * tap(t - k) for k, a in enumerate(w)), 0.0) for t in range(len(xs))]
        known = [x for x in xs if x is not None]
        mean, var = sum(known) / len(known), sum((x - sum(known) / len(known)) ** 2 for x in known) / len(known)
        h_mean = sum(h) / len(h)
        h_var = sum((v - h_mean) ** 2 for v in h) / len(h)
        for t, (i, x) in enumerate(items):
            assert causal[i][0] == t and causal[i][1] == pytest.approx(sum(a * tap(t - 3 * k) for k, a in enumerate(w)))
            assert same[i] == pytest.approx(0.2 * tap(t - 1) + 0.5 * tap(t) + 0.3 * tap(t + 1))
            assert multi[i] == pytest.approx([sum(a * tap(t - r * k) for k, a in enumerate(w)) for r in (1, 4)])
            assert (norm[i] is None) == (x is None)
            if x is not None:
                assert norm[i] == pytest.approx((x - mean) / (var + 1e-3) ** 0.5)
                assert block[i] == pytest.approx(x + (h[t] - h_mean) / (h_var + 1e-3) ** 0.5)
        for j in range(len(xs) // 2):
            pair = [x for x in xs[2 * j:2 * j + 2] if x is not None]
            assert pool[(g, j)] == (max(pair) if pair else None)


@pytest.mark.parametrize("cells", [None, 6])
def test_curves_of_a_shared_score(spark, cells):
    from floe.operators import evaluate as E
    rnd = random.Random(8)
    rows = [(i, rnd.choice([0, 0, 1, 3]), rnd.choice([0.1 * rnd.randint(0, 9), rnd.random(), float("nan"), float("inf")]))
            for i in range(700)]
    df = spark.createDataFrame(rows, "row_id long, y int, score double")
    ovr = E.one_vs_rest_shared(df, "score", "y", 4)
    for drop in (True, False):
        want = sorted(map(str, E.roc_curve(ovr, drop).collect()))
        assert sorted(map(str, E.roc_curve_shared(df, "score", "y", 4, drop, cells).collect())) == want
        assert sorted(map(str, E.roc_curve(ovr, drop, cells).collect())) == want
    want = {r["class"]: r.auc for r in E.auc(ovr).collect()}
    got = {r["class"]: r.auc for r in E.auc_shared(df, "score", "y", 4, cells).collect()}
    assert got == want and got[2] is None
    assert {r["class"]: r.auc for r in E.auc(ovr, cells).collect()} == want
    assert E.roc_curve_shared(df.limit(0), "score", "y", 4).count() == 0 == E.auc_shared(df.limit(0), "score", "y", 4).count()
    with pytest.raises(Exception, match="is no class code"):
        E.auc_shared(df, "score", "y", 3).collect()


def test_filters_shuffle_the_rows_once(spark):
    from floe.operators import series as Q
    from floe.sources import fixtures as fx

    def plan(df):
        df.write.format("noop").mode("overwrite").save()
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

    ser = fx.series(spark, "/root/testdata/sf0.001")
    for made in (Q.causal_filter(ser, [0.5, 0.3, 0.2], 2), Q.residual_block(ser, [0.5, 0.3, 0.2]),
                 Q.batch_norm(ser, "x", "entity", "z")):
        text = plan(made)
        assert text.count(" Exchange ") == 1 and "Join" not in text and "Generate" not in text


def test_scope_removes_what_was_kept(spark, tmp_path):
    import os

    from floe.operators import evaluate as E
    from floe.session import Scope, shared_dir
    folder = shared_dir(spark).removeprefix("file:")
    df = spark.createDataFrame([(i, i % 2, float(i % 7)) for i in range(50)], "row_id long, y int, score double")
    before = set(os.listdir(folder))
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    with Scope(spark) as kept:
        assert kept.keep(df).count() == 50
        assert E.auc_shared(df, "score", "y", 2).count() == 2
        assert set(os.listdir(folder)) != before
    assert set(os.listdir(folder)) == before
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached


def test_queries_leave_no_cached_dataset(spark):
    from floe.plans.catalog import QUERIES
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("a1_median_impute", "a3_label_mapping", "a8_running_mean_loss", "d1_stratified_split", "d2_tail_validation",
                 "d4_seeded_shuffle", "d6_row_index", "e8_roc_curve", "e9_auc_per_class", "q1_causal_filter", "q4_max_pool",
                 "q8_batch_norm", "k16_early_stopping", "pair_flow_report"):
        QUERIES[name](spark, "/root/testdata/sf0.001").count()
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == before, name


def test_cells_are_found_without_lambdas(spark):
    """The search among the bounds is compiled; nulls come first and the index has no gap."""
    from floe.operators.ordering import row_index
    rows = spark.range(3000).select((F.col("id") * 7 % 3000).alias("k"), F.when(F.col("id") % 100 != 0, F.col("id")).alias("v"))
    got = row_index(rows, ["v", "k"], num_partitions=40)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((r.v is not None, r.v or 0, r.k) for r in rows.collect())
    assert sorted((r.idx, (r.v is not None, r.v or 0, r.k)) for r in got.collect()) == list(enumerate(want))
