import random

from pyspark.sql import functions as F

from floe.operators.ordering import assign_batches, row_index, running_totals, seeded_shuffle, tail_split
from floe.operators.splits import stratified_quotas, stratified_sample, stratified_split


def _rows(n=3000, seed=1):
    rnd = random.Random(seed)
    # one hot class holding most rows (skew), several small ones
    return [(i, "hot" if rnd.random() < 0.7 else f"c{rnd.randint(0, 4)}", rnd.randint(0, 50)) for i in range(n)]


def test_running_totals_match_brute_force(spark):
    data = _rows()
    df = spark.createDataFrame(data, "id long, g string, v long")
    for parts in (1, 8):
        got = {r["id"]: (r["cum"], r["idx"], r["n"]) for r in running_totals(
            df, ["g"], ["v", "id"], {"cum": F.col("v")}, index_col="idx", size_col="n",
            num_partitions=parts).collect()}
        by_g = {}
        for i, g, v in sorted(data, key=lambda t: (t[1], t[2], t[0])):
            by_g.setdefault(g, []).append((i, v))
        for g, items in by_g.items():
            acc = 0
            for pos, (i, v) in enumerate(items):
                acc += v
                assert got[i] == (acc, pos, len(items))


def test_row_index_dense_global(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    rows = row_index(df, ["k"], "idx", num_partitions=6).collect()
    assert all(r["idx"] == r["k"] for r in rows)


def test_stratified_split_exact_and_reproducible(spark):
    data = _rows()
    df = spark.createDataFrame(data, "id long, g string, v long")
    q = {r["g"]: (r["n_class"], r["n_test_class"]) for r in stratified_quotas(df, "g", 0.3).collect()}
    n = len(data)
    assert sum(t for _, t in q.values()) == -(-3 * n // 10)        # ceil(0.3 n)
    for g, (nc, nt) in q.items():
        n_train = n - (-(-3 * n // 10))
        assert abs((nc - nt) - nc * n_train / n) < 1.0               # largest remainder
    a = {r["id"]: r["split"] for r in stratified_split(df, "g", "id", 0.3, 42, num_partitions=1).collect()}
    b = {r["id"]: r["split"] for r in stratified_split(df, "g", "id", 0.3, 42, num_partitions=8).collect()}
    assert a == b and len(a) == n                                    # complete, partition-independent
    for g, (nc, nt) in q.items():
        assert sum(1 for i, gg, _ in data if gg == g and a[i] == "test") == nt
    c = {r["id"]: r["split"] for r in stratified_split(df, "g", "id", 0.3, 7).collect()}
    assert c != a                                                    # seed matters


def test_stratified_sample_fraction(spark):
    df = spark.createDataFrame(_rows(), "id long, g string, v long")
    s = stratified_sample(df, "g", "id", 0.1)
    assert s.count() == 300


def test_tail_split_keeps_last_rows(spark):
    # The validation slice is the last 10 % in row order
    df = spark.range(0, 105).withColumnRenamed("id", "k")
    out = {r["k"]: r["split"] for r in tail_split(df, ["k"], 0.1).collect()}
    assert [k for k, s in out.items() if s == "validation"] == list(range(94, 105))


def test_shuffle_and_batches(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    p1 = {r["k"]: r["pos"] for r in seeded_shuffle(df, "k", 42, 0).collect()}
    p2 = {r["k"]: r["pos"] for r in seeded_shuffle(df, "k", 42, 1).collect()}
    assert sorted(p1.values()) == list(range(1000)) and p1 != p2
    b = assign_batches(df, "k", 256).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in b] == [256, 256, 256, 232]


def test_running_totals_keep_null_groups(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 7), (3, "a", 1), (4, "a", 2)], "id long, g string, v long")
    got = {r["id"]: (r["cum"], r["n"]) for r in running_totals(
        df, ["g"], ["id"], {"cum": F.col("v")}, size_col="n", num_partitions=3).collect()}
    assert got == {1: (5, 2), 2: (12, 2), 3: (1, 2), 4: (3, 2)}


def test_running_totals_without_persist_on_a_scan(spark):
    from floe.sources import fixtures as fx
    ser = fx.series(spark, "/root/testdata/sf0.001")
    a = {r["id"]: r["pos"] for r in running_totals(ser, ["entity"], ["ts", "id"], {}, index_col="pos").collect()}
    b = {r["id"]: r["pos"] for r in running_totals(ser, ["entity"], ["ts", "id"], {}, index_col="pos",
                                                   persist=False).collect()}
    assert a == b and len(a) == ser.count()


def test_running_totals_keep_all_rows_when_ranges_are_coalesced(spark):
    """The two phases read exchanges of different widths, which adaptive execution sizes differently."""
    from pyspark.sql import functions as F

    from floe.operators.ordering import running_totals
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(60_000).select("id", F.md5(F.col("id").cast("string")).alias("wide"), F.lit(2).alias("v"))
        for persist in (True, False):
            got = running_totals(df, [], ["wide", "id"], {"total": F.col("v")}, index_col="at", persist=persist)
            row = got.agg(F.count("*"), F.countDistinct("at"), F.max("total")).first()
            assert tuple(row) == (60_000, 60_000, 120_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.catalog.clearCache()


def test_tail_split_shuffles_one_range(spark, monkeypatch):
    """The boundary is found in cells, without a range shuffle or a cache of all rows."""
    from pyspark.sql import DataFrame
    from floe.operators import cells
    monkeypatch.setattr(cells, "MIN_ROWS", 50)
    monkeypatch.setattr(DataFrame, "repartitionByRange", None)
    monkeypatch.setattr(DataFrame, "persist", None)
    df = spark.range(1000).select(F.format_string("%05d", F.col("id") * 7 % 1000).alias("k"), F.col("id").alias("v"))
    for fraction, train in ((0.1, 900), (0.333, 667), (0.0, 1000), (1.0, 0)):
        got = tail_split(df, ["k", "v"], fraction).collect()
        assert sorted(r.k for r in got if r.split == "train") == [f"{i:05d}" for i in range(train)] and len(got) == 1000
