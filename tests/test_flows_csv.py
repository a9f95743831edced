import random
import tempfile

from floe.plans.pipelines import one_file_flow, pair_flow


def _x_like_rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        cls = ["Normal", "Scan", "DoS"][i % 3]
        rows.append({
            "Date": "2024-01-01", "Timestamp": str(i), "SrcIP": "10.0.0.1", "DstIP": "10.0.0.2",
            "class1": "x", "class3": "y", "class2": cls,
            "Protocol": rnd.choice(["tcp", "udp"]), "Service": rnd.choice(["http", "dns", "-"]),
            "Conn_state": rnd.choice(["SF", "REJ"]),
            "is_syn_only": rnd.choice(["TRUE", "FALSE"]), "FIN or RST": rnd.choice(["TRUE", "FALSE", "?"]),
            "Avg_num_Proc/s": f"{rnd.uniform(0, 5):.3f}", "Duration": f"{rnd.uniform(0, 9):.2f}",
            "read_write_physical.process": str(rnd.randint(0, 3) + (10 if cls == "DoS" else 0)),
            "SrcBytes": str(rnd.randint(0, 100) + (500 if cls == "Scan" else 0)),
            "empty_col": "",
        })
    return rows


def _write(spark, rows, path):
    cols = list(rows[0])
    spark.createDataFrame([[r[c] for c in cols] for r in rows], ", ".join(f"`{c}` string" for c in cols)) \
        .coalesce(1).write.option("header", "true").csv(path)


def test_one_file_and_pair_flows(spark):
    d = tempfile.mkdtemp(prefix="floe-xcsv-")
    _write(spark, _x_like_rows(600, 1), d + "/all")
    model, rep = one_file_flow(spark, d + "/all", "x_full")
    assert set(model.categories) == {"Protocol", "Service", "Conn_state"}
    assert "Date" not in model.numeric and "class1" not in model.numeric
    assert "read_write_physical.process" in model.numeric and "FIN or RST" in model.numeric
    rows = {r["class"]: r for r in rep.collect()}
    assert rows["accuracy"]["support"] == 180 and rows["accuracy"]["precision"] > 0.6
    _write(spark, _x_like_rows(400, 2), d + "/train")
    _write(spark, _x_like_rows(200, 3), d + "/test")
    model2, rep2 = pair_flow(spark, d + "/train", d + "/test", "x_reduced")
    assert "SrcBytes" not in model2.numeric and "Duration" not in model2.numeric   # reduced preset
    assert "empty_col" not in model2.numeric                                       # P9
    rows2 = {r["class"]: r for r in rep2.collect()}
    assert rows2["accuracy"]["support"] == 200


def test_sparse_categories_give_the_dense_report(spark):
    d = tempfile.mkdtemp(prefix="floe-xcsv-")
    rows = _x_like_rows(500, 7)
    _write(spark, rows, d + "/all")
    dense, sparse = (sorted(map(str, one_file_flow(spark, d + "/all", "x_full", sparse=s)[1].collect())) for s in (False, True))
    assert dense == sparse


def test_one_file_flow_with_fifty_thousand_categories(spark):
    d = tempfile.mkdtemp(prefix="floe-xcsv-")
    rows = spark.range(60_000).selectExpr(
        "cast(id as string) Timestamp", "concat('s', id % 50000) Service", "concat('c', id % 2) Conn_state", "'tcp' Protocol",
        "concat('k', id % 2) class2", "cast(id % 97 as string) Duration")
    rows.write.option("header", "true").csv(d + "/all")
    model, report = one_file_flow(spark, d + "/all", "x_full", sparse=True)
    got = {r["class"]: r for r in report.collect()}
    assert got["accuracy"]["support"] == 18_000 and got["accuracy"]["precision"] == 1.0     # Conn_state tells the class
    assert model.categories == ["Protocol", "Service", "Conn_state"] and model.numeric == ["Duration"]
