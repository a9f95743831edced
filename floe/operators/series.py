"""Fixed-kernel operators over ordered series per entity (Q1-Q8).

Series are ``(entity, ts, id, x)``; the order inside an entity is
(ts, id).  Rows are shuffled once, by (entity, cell): an entity of more rows
than a task should hold is cut into cells (``operators.cells``), and each cell
also gets the few rows before (or after) it that a filter's taps reach.  Inside
a cell a filter is ``lag`` and ``lead``.  Zero padding: a tap beyond the series,
or on a null, adds nothing.  Group statistics of hot entities come from a table
of one row an entity, those of all others from the window that is there anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floe.functions.text import c
from floe.operators.cells import CELL, HOT, Cells, cell_totals, find_cells, with_neighbours

ORDER = ["ts", "id"]


def positions(df: DataFrame, entity: str = "entity", order=None, num_partitions: int | None = None) -> DataFrame:
    """Dense 0-based position ``pos`` and series length ``n`` per entity."""
    return cell_totals(df, [entity], list(order or ORDER), {}, index_col="pos", size_col="n", cells=num_partitions)


def _taps(df: DataFrame, taps: dict[str, list[tuple[int, float]]], entity: str,
          num_partitions: int | None) -> tuple[DataFrame, Cells]:
    """(entity, pos, ts, id, x, outputs, CELL, HOT): sums of w * x[pos - shift]; taps: out -> [(shift, w)]."""
    rows = df.select(c(entity), *ORDER, "x")
    found = find_cells(rows, [entity], ORDER, num_partitions)
    shifts = [s for pairs in taps.values() for s, _ in pairs]
    sent, own = with_neighbours(rows, found, max([0, *shifts]), -min([0, *shifts]))
    order = Window.partitionBy(c(entity), CELL).orderBy(*ORDER)
    at = {s: F.col("x") if s == 0 else F.lag("x", s).over(order) if s > 0 else F.lead("x", -s).over(order)
          for s in set(shifts)}

    def filtered(pairs: list[tuple[int, float]]) -> Column:
        total = F.lit(0.0)
        for shift, w in pairs:
            total = total + F.coalesce(F.lit(float(w)) * at[shift], F.lit(0.0))
        return total

    place = F.sum(own.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    out = sent.select(c(entity), *ORDER, "x", CELL, HOT, "_floe_own", place.alias("_floe_in"),
                      *[filtered(pairs).alias(name) for name, pairs in taps.items()]).where(own)
    pos = F.col("_floe_in")
    if found.cuts is not None:
        counts = found.assign(rows).where(HOT).groupBy(c(entity), CELL).agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy(c(entity)).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(c(entity), CELL, F.sum("n").over(before).alias("_floe_start"))
        out = found.match(out, starts, [entity, CELL])
        pos = pos + F.coalesce("_floe_start", F.lit(0))
    return out.select(c(entity), pos.alias("pos"), *ORDER, "x", *taps, CELL, HOT), found


def _rows(made: tuple[DataFrame, Cells]) -> DataFrame:
    return made[0].drop(CELL, HOT)


def causal_filter(df: DataFrame, weights: list[float], rate: int = 1, entity: str = "entity",
                  out: str = "y", num_partitions: int | None = None) -> DataFrame:
    """Q1: y[t] = sum_k w_k * x[t - k*rate], zero padded at the start."""
    return _rows(_taps(df, {out: [(k * rate, w) for k, w in enumerate(weights)]}, entity, num_partitions))


def same_filter(df: DataFrame, weights: tuple[float, float, float], entity: str = "entity",
                out: str = "y", num_partitions: int | None = None) -> DataFrame:
    """Q2: centred width-3 filter y[t] = w0*x[t-1] + w1*x[t] + w2*x[t+1]."""
    w0, w1, w2 = weights
    return _rows(_taps(df, {out: [(0, w1), (1, w0), (-1, w2)]}, entity, num_partitions))


def multi_scale_filter(df: DataFrame, weights: list[float], rates=(1, 2, 4), entity: str = "entity",
                       num_partitions: int | None = None) -> DataFrame:
    """Q3: causal filters at several dilation rates side by side (y_r1, y_r2, ...)."""
    taps = {f"y_r{r}": [(k * r, w) for k, w in enumerate(weights)] for r in rates}
    return _rows(_taps(df, taps, entity, num_partitions))


def max_pool(df: DataFrame, size: int = 2, entity: str = "entity", num_partitions: int | None = None) -> DataFrame:
    """Q4: max over non-overlapping windows of ``size``; an incomplete tail is dropped."""
    idx = positions(df, entity, num_partitions=num_partitions)
    g = idx.groupBy(entity, F.floor(F.col("pos") / size).cast("long").alias("window")).agg(
        F.max("x").alias("x_max"), F.count(F.lit(1)).alias("_floe_cnt"))
    return g.where(F.col("_floe_cnt") == size).drop("_floe_cnt")


def global_average_pool(df: DataFrame, entity: str = "entity") -> DataFrame:
    """Q5: mean of the series per entity (partial aggregation, skew-safe)."""
    return df.groupBy(entity).agg(F.avg("x").alias("x_avg"))


def attention_pool(df: DataFrame, a: float = 1.0, b: float = 0.0, entity: str = "entity") -> DataFrame:
    """Q6: softmax-weighted mean with score s = tanh(a*x + b).

    s lies in [-1, 1], so exp(s) cannot overflow and the softmax needs no
    max subtraction: sum(x*exp(s)) / sum(exp(s)) per entity.
    """
    e = F.exp(F.tanh(F.lit(float(a)) * F.col("x") + F.lit(float(b))))
    return df.groupBy(entity).agg((F.sum(F.col("x") * e) / F.sum(e)).alias("x_att"))


def _normed(df: DataFrame, col: str, group: str, part: list[str], hot: Column | None, out: str, eps: float) -> DataFrame:
    """z-scores of ``col``: statistics of a window over ``part``, or for ``hot`` rows of a small table.

    Squares are summed around the window's or table's mean by ``var_pop``, as in a plain aggregation.
    """
    whole = Window.partitionBy(*[c(p) for p in part])
    mean, var = F.avg(c(col)).over(whole), F.var_pop(c(col)).over(whole)
    if hot is not None:
        # as many rows as there are hot groups
        stats = df.where(hot).groupBy(c(group)).agg(F.avg(c(col)).alias("_floe_mu"), F.var_pop(c(col)).alias("_floe_var"))
        small = Cells([group], [])
        df = small.match(df.select("*", mean.alias("_floe_m"), var.alias("_floe_v")), stats, [group])
        mean = F.when(hot, F.col("_floe_mu")).otherwise(F.col("_floe_m"))
        var = F.when(hot, F.col("_floe_var")).otherwise(F.col("_floe_v"))
    made = df.withColumn(out, (c(col) - mean) / F.sqrt(var + F.lit(float(eps))))
    return made.drop("_floe_m", "_floe_v", "_floe_mu", "_floe_var")


def batch_norm(df: DataFrame, col: str, group: str = "entity", out: str | None = None,
               eps: float = 1e-3, num_partitions: int | None = None) -> DataFrame:
    """Q8: (x - mean) / sqrt(var_pop + eps) with the statistics of the group.

    One shuffle of the rows and no join of two large sides: the rows of a hot group are
    dealt into cells by a hash and take their statistics from a table with one row for
    each hot group.  Rows of a null group have no statistics and are left out.
    """
    rows = df.where(c(group).isNotNull())
    key = "_floe_deal"
    dealt = rows.withColumn(key, F.xxhash64(*[c(n) for n in df.columns]))
    found = find_cells(dealt, [group], [key], num_partitions)
    cut = found.assign(dealt)
    hot = F.col(HOT) if found.cuts is not None else None
    return _normed(cut, col, group, [group, CELL], hot, out or col, eps).drop(CELL, HOT, key)


def residual_block(df: DataFrame, weights: list[float], rate: int = 1, entity: str = "entity",
                   eps: float = 1e-3, num_partitions: int | None = None) -> DataFrame:
    """Q7: x + batch_norm(relu(causal_filter(x))) per entity, in the cells of the filter."""
    filt, found = _taps(df, {"h": [(k * rate, w) for k, w in enumerate(weights)]}, entity, num_partitions)
    relu = filt.withColumn("h", F.greatest(F.col("h"), F.lit(0.0)))
    hot = F.col(HOT) if found.cuts is not None else None
    normed = _normed(relu, "h", entity, [entity, CELL], hot, "h_bn", eps)
    return normed.select(c(entity), "pos", "ts", "id", "x", (F.col("x") + F.col("h_bn")).alias("y"))
