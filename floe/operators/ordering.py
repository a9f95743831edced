"""Order-dependent operators without single-task windows.

Spark tables have no implicit row order, so every positional operator of the
reference is rebuilt over an explicit, unique ordering key.  A plain
``row_number().over(Window.orderBy(...))`` (or a window partitioned by a hot
class) moves a whole group into one task.  ``running_totals`` instead works
in two phases over a sampled range partitioning:

1. ``repartitionByRange`` spreads the rows over ``n`` balanced, ordered
   ranges (a hot group is split across many ranges);
2. running sums are computed inside each (range, group) cell, and the totals
   of all earlier ranges of the same group are added as an offset.

The offset table has at most ``n`` rows per group, so it stays small.  The
range-partitioned input is persisted (memory and disk) so both phases see the
same partition assignment, also when a lost block is recomputed.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floe.functions.text import c as quoted
from floe.operators.cells import CELL, cell_totals, find_cells

PID = "_floe_pid"

# Stand-in values for NULL group keys (paired with an is-null flag).
_DEFAULTS = {"string": "", "bigint": 0, "int": 0, "smallint": 0, "tinyint": 0, "double": 0.0,
             "float": 0.0, "boolean": False, "date": "1970-01-01", "timestamp": "1970-01-01 00:00:00",
             "timestamp_ntz": "1970-01-01 00:00:00"}


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def running_totals(df: DataFrame, group_cols: list[str], order_cols: list,
                   values: dict[str, Column] | None = None,
                   index_col: str | None = None, size_col: str | None = None,
                   num_partitions: int | None = None, cached: list | None = None,
                   bucket: Column | None = None, persist: bool = True) -> DataFrame:
    """Inclusive running sums of ``values`` within each group in order.

    ``order_cols`` must make the order unique within a group.  Adds one
    column per ``values`` key, optionally ``index_col`` (0-based position)
    and ``size_col`` (rows in the group).  Pass narrow frames: every input
    column travels through two exchanges.  ``cached`` collects the
    persisted intermediate so a caller that finishes with an action can
    unpersist it.

    ``bucket`` replaces the sampled range partitioning when the caller has
    a deterministic integer expression that is non-decreasing in the order
    within a group and spreads rows evenly (e.g. a prefix of a hash that is
    itself the order key): no sampling job and no cache are needed then.

    ``persist=False`` keeps no cache: the groups are cut into cells at explicit
    bounds (``operators.cells``), which needs the order columns by name.
    """
    if bucket is None and not persist:
        return cell_totals(df, group_cols, order_cols, values, index_col, size_col, num_partitions)
    values = dict(values or {})
    orders = [_as_col(o) for o in order_cols]
    tmp = {k: f"_floe_v_{i}" for i, k in enumerate(values)}
    # Group keys as (is-null flag, value-or-default) pairs: never NULL, so the
    # equi-join with the offsets keeps NULL groups without a null-safe join
    # (which would re-shuffle the large side).
    types = dict(df.dtypes)
    keys, key_cols = [], []
    for i, g in enumerate(group_cols):
        default = _DEFAULTS.get(types[g])
        if default is None:
            keys.append(g)
            continue
        keys += [f"_floe_gn{i}", f"_floe_gv{i}"]
        key_cols += [F.col(g).isNull().alias(f"_floe_gn{i}"),
                     F.coalesce(F.col(g), F.lit(default).cast(types[g])).alias(f"_floe_gv{i}")]
    base = df.select("*", *key_cols, *[v.alias(tmp[k]) for k, v in values.items()],
                     F.lit(1).cast("long").alias("_floe_one"))
    group_cols = keys
    if bucket is not None:
        ranged = base.withColumn(PID, bucket.cast("int"))
    else:
        range_keys = [F.col(g) for g in group_cols] + orders
        # Without an explicit count, adaptive execution may coalesce adjacent
        # ranges; the persisted relation fixes each row's partition index, so
        # both phases still agree.
        by_range = (base.repartitionByRange(int(num_partitions), *range_keys) if num_partitions
                    else base.repartitionByRange(*range_keys))
        ranged = by_range.withColumn(PID, F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
        if cached is not None:
            cached.append(ranged)
    summed = list(tmp.values()) + ["_floe_one"]
    cell = Window.partitionBy(PID, *group_cols).orderBy(*orders).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(s).over(cell).alias(f"{s}_loc") for s in summed])
    totals = ranged.groupBy(PID, *group_cols).agg(*[F.sum(s).alias(f"{s}_tot") for s in summed])
    before = Window.partitionBy(*group_cols).orderBy(PID).rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    offsets = totals.select(
        PID, *group_cols,
        *[F.coalesce(F.sum(f"{s}_tot").over(before), F.lit(0)).alias(f"{s}_off") for s in summed],
        F.sum("_floe_one_tot").over(whole).alias("_floe_size"))
    # Sort-merge join: ``local`` is already hash-partitioned and sorted on
    # (PID, groups) by its window, so only the small offsets table moves.
    # Without the hint, runtime planning may broadcast the large side.
    joined = local.hint("merge").join(offsets, on=[PID, *group_cols], how="inner")
    out = [quoted(name) for name in df.columns]
    for k, s in tmp.items():
        out.append((F.col(f"{s}_loc") + F.col(f"{s}_off")).alias(k))
    if index_col:
        out.append((F.col("_floe_one_loc") + F.col("_floe_one_off") - 1).alias(index_col))
    if size_col:
        out.append(F.col("_floe_size").alias(size_col))
    return joined.select(*out)


def row_index(df: DataFrame, order_cols: list, index_col: str = "idx",
              group_cols: list[str] | None = None, size_col: str | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """0-based positional index in the order of the columns ``order_cols`` (per group), in cells."""
    return cell_totals(df, list(group_cols or []), list(order_cols), {}, index_col=index_col, size_col=size_col,
                       cells=num_partitions)


def shuffle_key(row_key: Column, seed: int = 42, epoch: int = 0) -> Column:
    """Reproducible pseudo-random sort key of a row for a seed and epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), row_key.cast("string")))


def hash_bucket(hex_key: Column, buckets: int) -> Column:
    """Order-preserving bucket of an md5 hex key: its first 32 bits scaled to ``buckets``."""
    top = F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("long")
    return F.floor(top * F.lit(int(buckets)) / F.lit(4294967296)).cast("int")


def seeded_shuffle(df: DataFrame, row_key: str, seed: int = 42, epoch: int = 0,
                   index_col: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Full reproducible shuffle, as a position column (order by md5 key, then row key).

    The md5 key is uniform, so its prefix buckets the rows evenly without a
    sampling pass.
    """
    n = _partitions(df, num_partitions)
    keyed = df.withColumn("_floe_shuffle", shuffle_key(F.col(row_key), seed, epoch))
    return running_totals(keyed, [], ["_floe_shuffle", row_key], {}, index_col=index_col,
                          bucket=hash_bucket(F.col("_floe_shuffle"), n)).drop("_floe_shuffle")


def assign_batches(df: DataFrame, row_key: str, batch_size: int = 256, seed: int = 42,
                   epoch: int = 0) -> DataFrame:
    """Batch id = floor(shuffled position / batch_size)."""
    shuffled = seeded_shuffle(df, row_key, seed, epoch, "_floe_pos")
    return (shuffled.withColumn("batch_id", F.floor(F.col("_floe_pos") / batch_size).cast("long"))
            .drop("_floe_pos"))


def tail_split(df: DataFrame, order_cols: list[str], fraction: float = 0.1,
               split_col: str = "split") -> DataFrame:
    """The last ``fraction`` of rows in order form the validation slice.

    As with a Keras ``validation_split``: the first floor(n * (1 - fraction))
    rows train, the rest validate.  Only the boundary row is located: every row
    finds its range among explicit bounds (``operators.cells``), the ranges are
    counted where the rows lie, and only the range that holds the boundary is
    shuffled and ranked.  The split itself is a comparison against that one key.
    """
    keys = df.select(*order_cols)
    ranged = find_cells(keys, [], order_cols).assign(keys)
    counts = sorted(tuple(r) for r in ranged.groupBy(CELL).count().collect())   # one row a range
    cut = int(math.floor(sum(n for _, n in counts) * (1.0 - float(fraction))))
    before = 0
    for part, rows in counts:
        if cut < before + rows:
            break
        before += rows
    else:
        return df.withColumn(split_col, F.lit("train"))
    if cut <= 0:
        return df.withColumn(split_col, F.lit("validation"))
    place = F.row_number().over(Window.partitionBy(CELL).orderBy(*order_cols))
    first_val = ranged.where(F.col(CELL) == part).withColumn("_floe_idx", place).where(
        F.col("_floe_idx") == cut - before + 1).select(*order_cols).first()
    is_val = key_at_or_after([F.col(o) for o in order_cols], [first_val[o] for o in order_cols])
    return df.withColumn(split_col, F.when(is_val, F.lit("validation")).otherwise(F.lit("train")))


def key_at_or_after(cols: list[Column], values: list) -> Column:
    """Lexicographic (c1, c2, ...) >= (v1, v2, ...) for non-null keys."""
    expr = None
    for col, v in reversed(list(zip(cols, values))):
        lit = F.lit(v)
        expr = (col >= lit) if expr is None else ((col > lit) | ((col == lit) & expr))
    return expr


def key_at_or_before(cols: list[Column], bounds: list[Column]) -> Column:
    """Lexicographic (c1, c2, ...) <= (b1, b2, ...)."""
    expr = None
    for col, b in reversed(list(zip(cols, bounds))):
        expr = (col <= b) if expr is None else ((col < b) | ((col == b) & expr))
    return expr
