"""Plan-shape checks for the operators whose scale behaviour matters most."""

from pyspark.sql import functions as F

from floe.operators.ordering import running_totals
from floe.operators.splits import stratified_split
from floe.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()        # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_is_a_projection(spark):
    flows = fx.flows_num(spark, SF)
    split = stratified_split(flows, "l_returnflag", "row_id")
    plan = _plan(split)
    assert "Exchange" not in plan and "Join" not in plan        # rows are never shuffled
    assert "FileScan parquet" in plan or "Scan parquet" in plan


def test_running_totals_never_broadcasts_the_rows(spark):
    df = spark.range(0, 20000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 20000).alias("k"))
    plan = _plan(running_totals(df, ["g"], ["k"], {}, index_col="i"))
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan


def test_parquet_scans_are_pruned(spark):
    from floe.plans.catalog import QUERIES
    plan = _plan(QUERIES["q5_global_average_pool"](spark, SF))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "props" not in scan and "event_type" not in scan   # only the needed columns are read
