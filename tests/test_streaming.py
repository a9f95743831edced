import tempfile

from pyspark.sql import functions as F

from floe.operators.distill import CentroidClassifier
from floe.plans.preprocess import Preprocess
from floe.sources import fixtures as fx
from floe.sources.csv import write_csv
from floe.streaming.scoring import read_flow_stream, running_confusion, score_stream

SF = "/root/testdata/sf0.001"


def test_stream_scoring_matches_batch(spark):
    flows = fx.flows_num(spark, SF).select(*[F.col(c).cast("string") for c in
                                             ["row_id", *fx.NUM_FEATURES, "l_linestatus", "l_returnflag"]])
    prep = Preprocess("row_id", "l_returnflag", categories=["l_linestatus"]).fit(flows)
    model = CentroidClassifier(prep.feature_names).fit(prep.transform(flows))
    src = tempfile.mkdtemp(prefix="floe-stream-src-")
    write_csv(flows, src + "/part1")
    stream = read_flow_stream(spark, src + "/part1", flows.columns)
    counts = running_confusion(score_stream(stream, prep, model))
    q = (counts.writeStream.outputMode("complete").format("memory").queryName("floe_conf_test")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="floe-stream-ck-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {(r["y"], r["pred"]): r["n"] for r in spark.table("floe_conf_test").collect()}
    batch = running_confusion(score_stream(flows, prep, model))
    want = {(r["y"], r["pred"]): r["n"] for r in batch.collect()}
    assert got == want and sum(got.values()) == flows.count()


def test_unlabelled_stream_to_parquet_sink(spark):
    from floe.streaming.scoring import start_scored_sink
    flows = fx.flows_num(spark, SF).select(*[F.col(c).cast("string") for c in
                                             ["row_id", *fx.NUM_FEATURES, "l_linestatus", "l_returnflag"]])
    prep = Preprocess("row_id", "l_returnflag", categories=["l_linestatus"]).fit(flows)
    model = CentroidClassifier(prep.feature_names).fit(prep.transform(flows))
    src = tempfile.mkdtemp(prefix="floe-stream-src2-")
    unlabelled = flows.drop("l_returnflag")
    write_csv(unlabelled, src + "/in")
    stream = read_flow_stream(spark, src + "/in", unlabelled.columns)
    out = tempfile.mkdtemp(prefix="floe-stream-out-") + "/scored"
    q = start_scored_sink(score_stream(stream, prep, model).select("row_id", "pred"), out,
                          checkpoint=tempfile.mkdtemp(prefix="floe-stream-ck2-"), available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == flows.count() and got.where(F.col("pred").isNull()).count() == 0
