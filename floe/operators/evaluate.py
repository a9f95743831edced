"""Evaluation tables (E1-E11, K15): confusion, report, ROC/AUC, timing.

All reports are aggregations over a prediction table
``(y int, pred int, ...)`` or over a one-vs-rest score table; results have
fixed schemas (FIXTURES.md section 4).  ROC points are computed from
per-(class, score) counts with running totals in cells, so no single task
holds a whole class.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floe.functions.arrays import argmax, explode_positions, sparse_cross_entropy
from floe.functions.text import c
from floe.operators.joins import zip_by_key
from floe.operators.cells import cell_totals
from floe.session import stored


def with_prediction(df: DataFrame, prob_col: str, pred_col: str = "pred") -> DataFrame:
    """Predicted class = argmax of the probability array."""
    return df.withColumn(pred_col, argmax(c(prob_col)))


def _class_code(x: Column, name: str, num_classes: int | None) -> Column:
    """A class code; NULL, negative or (when the count is given) too large codes fail the query."""
    ok = x.isNotNull() & (x >= 0)
    if num_classes is not None:
        ok = ok & (x < num_classes)
    return F.when(ok, x).otherwise(F.raise_error(F.concat(
        F.lit(f"{name} is no class code: "), F.coalesce(x.cast("string"), F.lit("NULL"))))).alias(name)


def confusion(df: DataFrame, num_classes: int | None = None, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """(y, pred, n) for every class pair, zero cells kept.

    Without ``num_classes`` the classes are those seen in either column.  No
    row is left out: a NULL code, or one outside 0..num_classes-1, raises.
    """
    counts = df.groupBy(c(y_col).cast("int").alias("y"), c(pred_col).cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("n")).select(
        _class_code(F.col("y"), "y", num_classes), _class_code(F.col("pred"), "pred", num_classes), "n")
    if num_classes is None:
        # one row holding the class codes: as many as the report has rows
        seen = counts.select(F.explode(F.array("y", "pred")).alias("code")).agg(
            F.sort_array(F.collect_set("code")).alias("codes"))
    else:
        seen = df.sparkSession.range(1).select(F.sequence(F.lit(0), F.lit(num_classes - 1)).alias("codes"))
    grid = seen.select(F.explode("codes").alias("y"), "codes").select("y", F.explode("codes").alias("pred"))
    return (grid.join(counts, ["y", "pred"], "full_outer")
            .select("y", "pred", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def confusion_wide(conf: DataFrame, num_classes: int | None = None) -> DataFrame:
    """E2 wide form: one row per true class, one column per predicted class (all seen ones by default)."""
    pivoted = conf.groupBy("y")
    pivoted = pivoted.pivot("pred") if num_classes is None else pivoted.pivot("pred", list(range(num_classes)))
    return pivoted.agg(F.sum("n")).orderBy("y")


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den, F.lit(0)).cast("double")), F.lit(0.0))


def per_class_scores(conf: DataFrame) -> DataFrame:
    """(code, precision, recall, f1, support, tp) per class present in y or pred.

    Each confusion cell adds to its true class (tp, support) and to its
    predicted class (predicted): one aggregation over the k*k cells.
    """
    sent = conf.select(F.inline(F.array(
        F.struct(F.col("y").alias("code"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp"),
                 F.col("n").cast("long").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("pred").alias("code"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"),
                 F.col("n").cast("long").alias("predicted")))))
    joined = sent.groupBy("code").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                      F.sum("predicted").alias("predicted"))
    present = joined.where((F.col("support") > 0) | (F.col("predicted") > 0))
    p = _ratio(F.col("tp"), F.col("predicted"))
    r = _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return present.select("code", p.alias("precision"), r.alias("recall"), f1.alias("f1"),
                          F.col("support").cast("long").alias("support"), "tp")


def classification_report(conf: DataFrame, class_names: list[str] | None = None) -> DataFrame:
    """E3 + E4 + E5: per-class rows, then 'accuracy', 'macro avg', 'weighted avg'.

    Schema: class string, precision double, recall double, f1 double,
    support bigint.  The accuracy row repeats the accuracy in the three
    score columns and carries the total row count as support.  The three
    summary rows come from one aggregation over the per-class table.
    """
    # read by two branches of one plan, which share the exchange of the counts
    scores = per_class_scores(conf)
    if class_names is not None:
        names = F.array(*[F.lit(v) for v in class_names])
        label = F.element_at(names, F.col("code") + 1)
    else:
        label = F.col("code").cast("string")
    per_class = scores.select(label.alias("class"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    summary = scores.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        *[(F.sum(F.col(m) * F.col("support")) / F.nullif(total, F.lit(0))).alias(f"w{m[0]}")
          for m in ("precision", "recall", "f1")],
        total.alias("support"),
        (F.sum("tp").cast("double") / F.nullif(total, F.lit(0))).alias("acc"))
    rows = summary.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.col("acc").alias("precision"), F.col("acc").alias("recall"),
                 F.col("acc").alias("f1"), F.col("support").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("support").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("support").cast("long").alias("support")))))
    return per_class.unionByName(rows)


def accuracy(y_col: str = "y", pred_col: str = "pred") -> Column:
    """E4 as an aggregate expression: avg(y == pred)."""
    return F.avg((c(y_col) == c(pred_col)).cast("double"))


def evaluate(df: DataFrame, prob_col: str, y_col: str = "y") -> DataFrame:
    """(loss, accuracy) of a prediction table in one aggregation."""
    return df.agg(F.avg(sparse_cross_entropy(c(prob_col), c(y_col))).alias("loss"),
                  F.avg((argmax(c(prob_col)) == c(y_col)).cast("double")).alias("accuracy"))


def compare_tables(before: DataFrame, after: DataFrame, prob_col: str = "probability", y_col: str = "y",
                   key_col: str = "row_id") -> DataFrame:
    """E10 on two prediction tables of the same rows, matched by their unique key."""
    left = before.select(c(key_col), c(y_col).alias("_floe_y"), c(prob_col).alias("_floe_before"))
    right = after.select(c(key_col), c(prob_col).alias("_floe_after"))
    return compare_models(zip_by_key(left, right, key_col), "_floe_before", "_floe_after", "_floe_y")


def compare_models(df: DataFrame, before_col: str, after_col: str, y_col: str = "y") -> DataFrame:
    """Loss and accuracy of two models scored on the same rows."""
    b_loss = F.avg(sparse_cross_entropy(c(before_col), c(y_col)))
    a_loss = F.avg(sparse_cross_entropy(c(after_col), c(y_col)))
    b_acc = F.avg((argmax(c(before_col)) == c(y_col)).cast("double"))
    a_acc = F.avg((argmax(c(after_col)) == c(y_col)).cast("double"))
    return df.agg(b_loss.alias("loss_before"), b_acc.alias("acc_before"), a_loss.alias("loss_after"),
                  a_acc.alias("acc_after")).select(
        "*", (F.col("loss_after") - F.col("loss_before")).alias("loss_delta"),
        (F.col("acc_after") - F.col("acc_before")).alias("acc_delta"))


def format_report(report: DataFrame, percent: bool = True, digits: int = 2) -> DataFrame:
    """Scores as fixed-decimal text (x100 when ``percent``), support as bigint.

    Rounding goes through a decimal, so a value is rounded half-up at its
    shortest decimal text, never at a binary artefact.
    """
    scale = 100.0 if percent else 1.0

    def fmt(col):
        d = (F.col(col) * F.lit(scale)).cast("decimal(24,10)")
        return F.round(d, digits).cast(f"decimal({digits + 4},{digits})").cast("string").alias(col)

    return report.select("class", fmt("precision"), fmt("recall"), fmt("f1"),
                         F.col("support").cast("long").alias("support"))


def one_vs_rest(df: DataFrame, prob_col: str, y_col: str = "y", key_col: str = "row_id") -> DataFrame:
    """(row key, class, score, is_pos) - one row per (row, class)."""
    return explode_positions(df, [c(key_col), c(y_col).alias("_floe_y")], c(prob_col), "class", "score"
                             ).select(c(key_col), F.col("class").cast("int").alias("class"),
                              F.col("score").cast("double").alias("score"),
                              (F.col("_floe_y") == F.col("class")).cast("int").alias("is_pos"))


def one_vs_rest_shared(df: DataFrame, score_col: str, y_col: str, num_classes: int,
                       key_col: str = "row_id") -> DataFrame:
    """E7 for one score per row: the same score ranks the row for every class."""
    return df.select(c(key_col), F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1))).alias("class"),
                     c(score_col).cast("double").alias("score"), c(y_col).alias("_floe_y")).select(
        c(key_col), F.col("class").cast("int").alias("class"), "score",
        (F.col("_floe_y") == F.col("class")).cast("int").alias("is_pos"))


def _per_score(ovr: DataFrame) -> DataFrame:
    """(class, score, pos, neg): ties grouped by a map-side combined aggregation."""
    return ovr.groupBy("class", "score").agg(
        F.sum("is_pos").cast("long").alias("pos"),
        (F.count(F.lit(1)) - F.sum("is_pos")).cast("long").alias("neg"))


#: Scores descending as ascending keys: NaN is the largest, null comes last.
DOWN = ["_floe_null", "_floe_number", "_floe_down"]


def _down() -> list[Column]:
    score = F.col("score")
    return [x.alias(n) for x, n in zip((score.isNull(), ~F.isnan(score), -score), DOWN)]


def roc_curve(ovr: DataFrame, drop_intermediate: bool = True,
              num_partitions: int | None = None) -> DataFrame:
    """ROC points (class, threshold, fpr, tpr) per class.

    One point per distinct score (ties grouped) plus the origin (NULL
    threshold).  With ``drop_intermediate``, points whose neighbours make
    them collinear in integer (fp, tp) space are dropped, first and last
    kept.  A point lies one step of its own counts after the one before it, so
    it is collinear where the next score's counts equal its own.
    """
    # written once: the passes of the cells read the distinct scores, not the rows
    counts = stored(_per_score(ovr).select("class", "score", "pos", "neg", *_down()), "scores")
    nexts = {"pos_next": F.col("pos"), "neg_next": F.col("neg")} if drop_intermediate else {}
    pts = cell_totals(counts, ["class"], DOWN, {"tp": F.col("pos"), "fp": F.col("neg")}, index_col="idx",
                      cells=num_partitions, nexts=nexts)
    # one row per class
    totals = counts.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    kept = pts
    if drop_intermediate:
        kept = pts.where((F.col("idx") == 0) | F.col("pos_next").isNull() | (F.col("pos_next") != F.col("pos"))
                         | (F.col("neg_next") != F.col("neg")))
    kept = kept.select("class", "score", "tp", "fp")
    origin = totals.select("class", F.lit(None).cast("double").alias("score"),
                           F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    allp = kept.unionByName(origin).join(F.broadcast(totals), "class")
    return _rates(allp)


def _rates(points: DataFrame) -> DataFrame:
    return points.select(F.col("class").cast("int").alias("class"), F.col("score").alias("threshold"),
                         F.try_divide(F.col("fp").cast("double"), F.col("N").cast("double")).alias("fpr"),
                         F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")).alias("tpr"))


def auc(ovr: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Trapezoidal area under each class's ROC curve.

    Each distinct score adds neg * (tp_before + tp_after) / 2 / (P * N);
    collinear points do not change the area, so no point is dropped.
    """
    counts = stored(_per_score(ovr).select("class", "pos", "neg", *_down()), "scores")
    pts = cell_totals(counts, ["class"], DOWN, {"tp": F.col("pos")}, cells=num_partitions)
    area = pts.groupBy("class").agg(
        F.sum(F.col("neg").cast("double") * (2 * F.col("tp") - F.col("pos")).cast("double") / 2.0).alias("a"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return area.select(F.col("class").cast("int").alias("class"),
                       F.try_divide(F.col("a"), F.col("P").cast("double") * F.col("N").cast("double")).alias("auc"))


# -- one score that ranks the rows for every class: no row is sent once a class -------------

def _class_counts(df: DataFrame, score_col: str, y_col: str, num_classes: int) -> DataFrame:
    """(order keys, score, all, n0..): rows of each class at each distinct score.

    Aggregated by (score, class) first, so at most one row of each pair leaves a task.
    """
    code = _class_code(c(y_col).cast("int"), "_floe_y", num_classes)
    pairs = df.select(c(score_col).cast("double").alias("score"), code).groupBy("score", "_floe_y").agg(
        F.count(F.lit(1)).alias("n"))
    one = [F.sum(F.when(F.col("_floe_y") == k, F.col("n")).otherwise(F.lit(0))).alias(f"n{k}") for k in range(num_classes)]
    counts = pairs.groupBy("score").agg(F.sum("n").alias("all"), *one)
    return stored(counts.select(*_down(), "score", "all", *[f"n{k}" for k in range(num_classes)]),
                  "scores")


def roc_curve_shared(df: DataFrame, score_col: str, y_col: str, num_classes: int, drop_intermediate: bool = True,
                     num_partitions: int | None = None) -> DataFrame:
    """E8 where one score ranks the rows for every class, as ``roc_curve(one_vs_rest_shared(...))``.

    Running counts of every class over the distinct scores; negatives are the rest of all rows.
    Only kept points become rows of a class.
    """
    counts = _class_counts(df, score_col, y_col, num_classes)
    names = [f"n{k}" for k in range(num_classes)]
    nexts = {"all_next": F.col("all"), **{f"{n}_next": F.col(n) for n in names}} if drop_intermediate else {}
    pts = cell_totals(counts, [], DOWN, {"upto": F.col("all"), **{f"{n}_upto": F.col(n) for n in names}},
                      index_col="idx", cells=num_partitions, nexts=nexts)

    def point(k: int) -> Column:
        n, tp = F.col(f"n{k}"), F.col(f"n{k}_upto")
        keep = F.lit(True)
        if drop_intermediate:
            ahead = F.col(f"n{k}_next")
            keep = (F.col("idx") == 0) | ahead.isNull() | (ahead != n) | (F.col("all_next") - ahead != F.col("all") - n)
        return F.when(keep, F.struct(F.lit(k).alias("class"), F.col("score").alias("score"), tp.alias("tp"),
                                     (F.col("upto") - tp).alias("fp")))

    kept = pts.select(F.inline(F.array_compact(F.array(*[point(k) for k in range(num_classes)]))))
    sums = counts.agg(F.sum("all").alias("all"), *[F.sum(n).alias(n) for n in names])       # one row
    totals = sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"n{k}").alias("P"),
                                                     (F.col("all") - F.col(f"n{k}")).alias("N"))
                                            for k in range(num_classes)]))).where(F.col("P") + F.col("N") > 0)
    origin = totals.select("class", F.lit(None).cast("double").alias("score"),
                           F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    return _rates(kept.unionByName(origin).join(F.broadcast(totals), "class"))


def auc_shared(df: DataFrame, score_col: str, y_col: str, num_classes: int,
               num_partitions: int | None = None) -> DataFrame:
    """E9 where one score ranks the rows for every class, as ``auc(one_vs_rest_shared(...))``."""
    counts = _class_counts(df, score_col, y_col, num_classes)
    names = [f"n{k}" for k in range(num_classes)]
    pts = cell_totals(counts, [], DOWN, {f"{n}_upto": F.col(n) for n in names}, cells=num_partitions)
    sums = [F.sum((F.col("all") - F.col(n)).cast("double") * (2 * F.col(f"{n}_upto") - F.col(n)).cast("double") / 2.0)
            .alias(f"a{k}") for k, n in enumerate(names)]
    whole = pts.agg(F.sum("all").alias("all"), *sums, *[F.sum(n).alias(n) for n in names])
    rows = whole.select("all", F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"), F.col(f"a{k}").alias("a"), F.col(n).alias("P")) for k, n in enumerate(names)])))
    rest = (F.col("all") - F.col("P")).cast("double")
    return rows.where(F.col("all") > 0).select("class", F.try_divide(F.col("a"), F.col("P").cast("double") * rest).alias("auc"))


def inference_throughput(scored: DataFrame) -> DataFrame:
    """Rows, seconds and ms per row of one full scoring pass.

    The pass writes to the ``noop`` sink (every row computed, nothing
    stored); the row count is observed during that same pass.
    """
    from pyspark.sql import Observation
    spark = scored.sparkSession
    obs = Observation("floe_inference")
    observed = scored.observe(obs, F.count(F.lit(1)).alias("rows"))
    start = time.perf_counter()
    observed.write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    rows = int(obs.get["rows"])
    ms = seconds * 1000.0 / rows if rows else None
    return spark.createDataFrame([(rows, float(seconds), ms)], "rows bigint, seconds double, ms_per_row double")
