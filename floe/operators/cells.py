"""Cells: groups in order, hot ones cut at explicit bounds.

A window over a group moves the group into one task.  Here a group of more rows than a task
should hold is cut into cells at bounds of its order key, and windows run over (group, cell):

1. one aggregation counts the rows of every group;
2. of the groups above the limit, keys chosen by a hash (about ``PER_CELL`` a cell) give the
   bounds.  The limit is at least 1 / ``spark.sql.shuffle.partitions`` of all rows, so hot
   groups, cells and bounds are as many as there are partitions, whatever the data;
3. a row's cell is found by binary search among its group's bounds, which a broadcast table
   holds (one row a hot group).

The cell is a function of the row: no sample, cache or number of a partition has to be the
same in two executions, and a lost executor changes nothing.  Rows are shuffled once, by
(group, cell); tables that connect the cells of a group have one row a cell.  Groups that
are not hot, as a rule nearly all, are plain windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floe.functions.text import c

CELL = "_floe_cell"
HOT = "_floe_hot"
MIN_ROWS = 100_000
PER_CELL = 32


@dataclass
class Cells:
    """Bounds of the hot groups of a table; ``cuts`` is None where no group is hot."""
    groups: list[str]
    orders: list[str]
    cuts: DataFrame | None = None
    steps: int = 0
    names: list[str] = field(default_factory=list)

    @property
    def keys(self) -> list[str]:
        return [*self.groups, CELL]

    def match(self, df: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
        """Join with a table of at most one row a cell, null keys alike; its keys are dropped."""
        renamed = small.select(*[c(n).alias(f"_floe_k{i}") for i, n in enumerate(on)],
                               *[c(n) for n in small.columns if n not in on])
        cond = F.lit(True)
        for i, n in enumerate(on):
            cond = cond & df[f"`{n}`"].eqNullSafe(renamed[f"_floe_k{i}"])
        return df.join(F.broadcast(renamed), cond, how).drop(*[f"_floe_k{i}" for i in range(len(on))])

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns CELL (0 where the group isn't hot) and HOT."""
        if self.cuts is None:
            return df.select("*", F.lit(0).alias(CELL), F.lit(False).alias(HOT))
        key = F.struct(*[c(o).alias(f"o{i}") for i, o in enumerate(self.orders)])
        found = self.match(df, self.cuts, self.groups) if self.groups else df.join(F.broadcast(self.cuts), how="cross")
        found = _ranked(found.withColumn("_floe_key", key), self.steps)
        return found.select(*[c(n) for n in df.columns], CELL, F.col("_floe_cuts").isNotNull().alias(HOT))


def _ranked(df: DataFrame, steps: int) -> DataFrame:
    """CELL: how many of a row's sorted bounds ``_floe_cuts`` are at or below its ``_floe_key``, 0 without bounds.

    A search by halving steps, one projection each: plain expressions that are compiled, where
    a lambda over the bounds would be interpreted for every row and step.
    """
    out = df.withColumn(CELL, F.lit(0))
    for j in reversed(range(steps)):
        reach = F.col(CELL) + F.lit(1 << j)
        out = out.withColumn(CELL, F.when(F.get("_floe_cuts", reach - 1) <= F.col("_floe_key"), reach).otherwise(F.col(CELL)))
    return out


def find_cells(df: DataFrame, groups: list[str], orders: list[str], cells: int | None = None) -> Cells:
    """Bounds for windows over ``groups`` in the order of the columns ``orders``, unique in a group.

    ``cells`` asks for about so many cells in all, whatever their size.
    """
    spark = df.sparkSession
    plain = Cells(list(groups), list(orders))
    sizes = df.groupBy(*[c(g) for g in groups]).agg(F.count(F.lit(1)).alias("_floe_n"))
    total, largest = sizes.agg(F.sum("_floe_n"), F.max("_floe_n")).first()
    if not total:
        return plain
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1, math.ceil(total / cells)) if cells else max(MIN_ROWS, math.ceil(total / parts))
    if largest <= limit:
        return plain
    share = min(1.0, PER_CELL / limit)
    chosen = F.pmod(F.xxhash64(*[c(n) for n in [*groups, *orders]]), F.lit(1 << 30)) < int(share * (1 << 30))
    keys = df.select(*[c(n) for n in [*groups, *orders]]).where(chosen)
    if groups:
        keys = plain.match(keys, sizes.where(F.col("_floe_n") > limit), groups, "inner").drop("_floe_n")
    place = F.row_number().over(Window.partitionBy(*[c(g) for g in groups]).orderBy(*[c(o) for o in orders]))
    step = max(1, int(limit * share))
    bounds = keys.select("*", place.alias("_floe_i")).where(F.col("_floe_i") % step == 0)
    bound = F.struct(*[c(o).alias(f"o{i}") for i, o in enumerate(orders)])
    cuts = bounds.groupBy(*[c(g) for g in groups]).agg(F.sort_array(F.collect_list(bound)).alias("_floe_cuts"))
    table = cuts.toArrow()
    if not table.num_rows:
        return plain
    longest = max(len(row) for row in table.column("_floe_cuts").to_pylist())
    return Cells(list(groups), list(orders), spark.createDataFrame(table, cuts.schema), longest.bit_length())


def cell_totals(df: DataFrame, groups: list[str], orders: list[str], values: dict[str, Column] | None = None,
                index_col: str | None = None, size_col: str | None = None, cells: int | None = None,
                nexts: dict[str, Column] | None = None, prepared: Cells | None = None) -> DataFrame:
    """Inclusive running sums within each group in order, as ``ordering.running_totals``, in cells.

    ``nexts`` adds columns holding a value of the next row in the group (null after the last).
    """
    found = prepared or find_cells(df, groups, orders, cells)
    values, nexts = dict(values or {}), dict(nexts or {})
    base = df.select("*", *[v.alias(f"_floe_v{i}") for i, v in enumerate(values.values())],
                     *[v.alias(f"_floe_x{i}") for i, v in enumerate(nexts.values())], F.lit(1).cast("long").alias("_floe_one"))
    cut = found.assign(base)
    sums = [*[f"_floe_v{i}" for i in range(len(values))], "_floe_one"]
    ahead = [f"_floe_x{i}" for i in range(len(nexts))]
    order = [c(o) for o in orders]
    part = Window.partitionBy(*[c(k) for k in found.keys])
    run = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.select("*", *[F.sum(s).over(run).alias(f"{s}_in") for s in sums], F.count(F.lit(1)).over(part).alias("_floe_size"),
                     *[F.lead(x).over(part.orderBy(*order)).alias(f"{x}_next") for x in ahead])
    add = {s: F.col(f"{s}_in") for s in sums}
    size, after = F.col("_floe_size"), {x: F.col(f"{x}_next") for x in ahead}
    if found.cuts is not None:
        # one row a cell of the hot groups: what lies before it, and the first row of the next one
        key = F.struct(*[c(o).alias(f"o{i}") for i, o in enumerate(orders)])
        per_cell = cut.where(HOT).groupBy(*[c(k) for k in found.keys]).agg(
            *[F.sum(s).alias(f"{s}_all") for s in sums], *[F.min_by(x, key).alias(f"{x}_first") for x in ahead])
        whole = Window.partitionBy(*[c(g) for g in groups])
        before = whole.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
        per_cell = per_cell.select(
            *[c(k) for k in found.keys], *[F.sum(f"{s}_all").over(before).alias(f"{s}_off") for s in sums],
            F.sum("_floe_one_all").over(whole).alias("_floe_whole"),
            *[F.lead(f"{x}_first").over(whole.orderBy(CELL)).alias(f"{x}_far") for x in ahead])
        out = found.match(out, per_cell, found.keys)
        add = {s: v + F.coalesce(F.col(f"{s}_off"), F.lit(0)) for s, v in add.items()}
        size = F.coalesce("_floe_whole", "_floe_size")
        last = F.col("_floe_one_in") == F.col("_floe_size")
        after = {x: F.when(last, F.col(f"{x}_far")).otherwise(v) for x, v in after.items()}
    made = [v.alias(n) for n, v in zip(values, [add[f"_floe_v{i}"] for i in range(len(values))])]
    made += [v.alias(n) for n, v in zip(nexts, after.values())]
    if index_col:
        made.append((add["_floe_one"] - 1).alias(index_col))
    if size_col:
        made.append(size.alias(size_col))
    return out.select(*[c(n) for n in df.columns], *made)


def with_neighbours(df: DataFrame, found: Cells, before: int, after: int) -> tuple[DataFrame, Column]:
    """Rows in cells, each cell with the rows that lie up to ``before`` rows ahead of it and ``after`` behind it.

    Returns (rows with CELL and HOT, flag column of a cell's own rows).  Only the first and
    last rows of the cells of hot groups are sent twice; a rank limit is applied before
    their shuffle, so that is a few rows a task and cell.
    """
    cut = found.assign(df)
    own = F.col("_floe_own")
    if found.cuts is None:
        return cut.select("*", F.lit(True).alias("_floe_own")), own
    hot = cut.where(HOT)
    order = [c(o) for o in found.orders]
    part = Window.partitionBy(*[c(k) for k in found.keys])
    whole = Window.partitionBy(*[c(g) for g in found.groups])
    # per hot group the sizes of its cells, in order
    sizes = hot.groupBy(*[c(k) for k in found.keys]).agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(whole.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[c(k) for k in found.keys], "n", start.alias("start"))
    table = sizes.groupBy(*[c(g) for g in found.groups]).agg(F.sort_array(F.collect_list(
        F.struct(F.col(CELL).alias("cell"), F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi")))).alias("_floe_t"))
    sent = cut.select("*", F.lit(True).alias("_floe_own"))
    for reach, backwards in ((before, True), (after, False)):
        if not reach:
            continue
        rank = F.row_number().over(part.orderBy(*([o.desc() for o in order] if backwards else order)))
        edge = hot.select("*", rank.alias("_floe_r")).where(F.col("_floe_r") <= reach)
        edge = found.match(edge, table, found.groups) if found.groups else edge.join(F.broadcast(table), how="cross")
        mine = F.element_at(F.filter("_floe_t", lambda t: t["cell"] == F.col(CELL)), 1)
        at = (mine["hi"] - F.col("_floe_r")) if backwards else (mine["lo"] + F.col("_floe_r") - 1)
        to = F.filter("_floe_t", lambda t: ((t["cell"] > F.col(CELL)) & (t["lo"] - at <= reach)) if backwards
                      else ((t["cell"] < F.col(CELL)) & (at - t["hi"] < reach)))
        edge = edge.select(*[c(n) for n in cut.columns if n != CELL], F.explode(F.transform(to, lambda t: t["cell"])).alias(CELL),
                           F.lit(False).alias("_floe_own"))
        sent = sent.unionByName(edge)
    return sent, own
