"""Teacher / student models and distillation.

The reference trains neural networks on one machine; here the teachers are MLlib
estimators (distributed ``treeAggregate`` training) or a closed-form centroid
classifier, and the students are convex models fitted by aggregations, so that a
whole pipeline can be checked against an SQL oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floe.functions.arrays import (blend, explode_positions, kl_divergence, let, log_temperature_softmax,
                                   matrix_literal, mean_squared_error, resample_linear, softmax, sparse_cross_entropy,
                                   temperature_softmax)
from floe.functions.text import c
from floe.operators.cells import CELL, HOT, find_cells
from floe.operators.softmax import SoftmaxModel, SoftmaxRegression
from floe.session import stored


# ------------------------------------------------------------ K1 centroid
@dataclass
class CentroidModel:
    """Per-class feature means; scores softmax(-squared distance)."""
    features: list[str]
    centroids: dict[int, list[float]]

    def scores(self):
        """Negative squared distances by class, an array column."""
        k, d = len(self.centroids), len(self.features)
        means = matrix_literal([self.centroids[i] for i in sorted(self.centroids)])
        x = F.array(*[c(f).cast("double") for f in self.features]) if d else F.array().cast("array<double>")

        def negative_distances(v):
            def of_class(i):
                def add(acc, j):
                    gap = F.element_at(v, j) - F.element_at(means, i * d + j)
                    return acc + gap * gap
                return -F.aggregate(F.sequence(F.lit(1), F.lit(d)), F.lit(0.0), add) if d else F.lit(0.0)
            return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), of_class)
        # the features are gathered once a row and the plan has one literal, whatever k and d
        return let(x, negative_distances)

    def probability(self):
        return softmax(self.scores())

    def transform(self, df: DataFrame, prob_col: str = "probability") -> DataFrame:
        return df.withColumn(prob_col, self.probability())


class CentroidClassifier:
    """K1 'centroid' backend: one aggregation pass (per-class means)."""

    def __init__(self, features: list[str], label_col: str = "y"):
        self.features = list(features)
        self.label_col = label_col

    def fit(self, df: DataFrame) -> CentroidModel:
        rows = df.groupBy(c(self.label_col).cast("int").alias("k")).agg(
            *[F.avg(c(f).cast("double")).alias(f"m{i}") for i, f in enumerate(self.features)]).collect()
        cents = {r["k"]: [float(r[f"m{i}"]) for i in range(len(self.features))] for r in rows}
        k = max(cents) + 1 if cents else 0
        for missing in range(k):   # a class absent from the fit frame never wins
            cents.setdefault(missing, [float("inf")] * len(self.features))
        return CentroidModel(self.features, cents)


@dataclass
class SparseCentroidModel:
    """Centroids over numeric columns and standardised one-hot categories that are never made columns.

    A category's one-hot feature is 0 in nearly every row.  Its squared distance to class k
    is (n_kf / n_k)^2 / s_f^2 there, summed over all categories in ``base``; where it is 1
    the difference (1 - 2 n_kf / n_k) / s_f^2 is added, from ``deltas`` (col, value, delta by class).
    """
    numeric: CentroidModel
    categories: list[str]
    base: list[float]
    deltas: DataFrame

    def transform(self, df: DataFrame, prob_col: str = "probability") -> DataFrame:
        """One join a category column; adaptive execution broadcasts a small table or splits a hot category."""
        out, parts = df, []
        for i, name in enumerate(self.categories):
            own = self.deltas.where(F.col("col") == i).select(F.col("value").alias(f"_floe_c{i}"), F.col("delta").alias(f"_floe_d{i}"))
            out = out.join(own, c(name).cast("string") == F.col(f"_floe_c{i}"), "left")
            parts.append(F.col(f"_floe_d{i}"))
        scores = F.zip_with(self.numeric.scores(), matrix_literal([self.base]), lambda z, b: z - b)
        for part in parts:      # an unseen category has no one-hot feature
            scores = F.when(part.isNull(), scores).otherwise(F.zip_with(scores, part, lambda z, d: z - d))
        return out.select(*[c(n) for n in df.columns if n != prob_col], softmax(scores).alias(prob_col))


class SparseCentroidClassifier:
    """K1 'centroid' backend over any number of categories (A4 and A5 from counts).

    The fit counts rows by (column, category, class); mean and deviation of a one-hot feature
    and its class means follow from the counts.  Same model as ``CentroidClassifier`` on the
    scaled dense one-hot columns.
    """

    def __init__(self, features: list[str], categories: list[str], label_col: str = "y"):
        self.features, self.categories, self.label_col = list(features), list(categories), label_col

    def fit(self, df: DataFrame) -> SparseCentroidModel:
        numeric = CentroidClassifier(self.features, self.label_col).fit(df)
        k = len(numeric.centroids)
        y = c(self.label_col).cast("int").alias("k")
        sizes = {r["k"]: r["count"] for r in df.select(y).groupBy("k").count().collect()}      # one row a class
        total = sum(sizes.values())
        values = F.array(*[F.struct(F.lit(i).alias("col"), c(n).cast("string").alias("value"))
                           for i, n in enumerate(self.categories)])
        counts = df.select(y, F.inline(values)).where(F.col("value").isNotNull()).groupBy("col", "value", "k").agg(
            F.count(F.lit(1)).alias("n"))
        # at most one entry a class
        by_class = counts.groupBy("col", "value").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"),
                                                      F.sum("n").alias("n"))
        p = F.col("n") / F.lit(float(total))
        variance = F.when(p < 1, p * (1 - p)).otherwise(F.lit(1.0))
        rates = [F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0))
                 / F.lit(float(max(sizes.get(i, 0), 1))) for i in range(k)]
        table = stored(by_class.select("col", "value", F.array(*[(1 - 2 * r) / variance for r in rates]).alias("delta"),
                                       F.array(*[r * r / variance for r in rates]).alias("zero")), "categories")
        row = table.agg(*[F.sum(F.get("zero", i)) for i in range(k)]).first()
        return SparseCentroidModel(numeric, self.categories, [float(v or 0.0) for v in row], table.drop("zero"))


# ------------------------------------------------------------ MLlib learners
def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


@dataclass
class MLModel:
    model: object
    features: list[str]

    def transform(self, df: DataFrame, prob_col: str = "probability") -> DataFrame:
        """K3: batch scoring -> probability array column."""
        scored = self.model.transform(assemble(df, self.features, "_floe_x"))
        keep = [c(n) for n in df.columns if n != prob_col]
        return scored.select(*keep, vector_to_array(F.col("_floe_p")).alias(prob_col))


def fit_teacher(df: DataFrame, features: list[str], label_col: str = "y", kind: str = "forest",
                seed: int = 42, num_trees: int = 20, max_depth: int = 6,
                hidden: tuple[int, ...] = (32,), num_classes: int | None = None):
    """K1: the larger model.  kind: 'forest', 'mlp' or 'centroid'."""
    if kind == "centroid":
        return CentroidClassifier(features, label_col).fit(df)
    data = assemble(df.select(*[c(f) for f in features], c(label_col).cast("double").alias("_floe_y")),
                    features, "_floe_x")
    if kind == "forest":
        est = RandomForestClassifier(featuresCol="_floe_x", labelCol="_floe_y", probabilityCol="_floe_p",
                                     rawPredictionCol="_floe_raw", predictionCol="_floe_pred",
                                     numTrees=num_trees, maxDepth=max_depth, seed=seed)
    elif kind == "mlp":
        k = num_classes or int(df.agg(F.max(c(label_col))).first()[0]) + 1
        est = MultilayerPerceptronClassifier(featuresCol="_floe_x", labelCol="_floe_y",
                                             probabilityCol="_floe_p", rawPredictionCol="_floe_raw",
                                             predictionCol="_floe_pred", seed=seed, maxIter=50,
                                             layers=[len(features), *hidden, k])
    else:
        raise ValueError(f"unknown teacher kind {kind!r}")
    return MLModel(est.fit(data), list(features))


def fit_student(df: DataFrame, features: list[str], label_col: str = "y", max_iter: int = 30,
                kind: str = "softmax", weight_col: str | None = None, validation: DataFrame | None = None):
    """K2: the smaller model, multinomial logistic regression on the hard labels.

    kind 'softmax' fits by Newton steps over one aggregation each (``operators.softmax``),
    'mllib' by MLlib, which also takes a ``weight_col``.
    """
    if kind == "softmax":
        if weight_col:
            raise ValueError("row weights need kind='mllib'")
        return SoftmaxRegression(list(features), label_col, max_steps=max_iter).fit(df, validation=validation)
    if kind != "mllib":
        raise ValueError(f"unknown student kind {kind!r}")
    cols = [*[c(f) for f in features], c(label_col).cast("double").alias("_floe_y")]
    if weight_col:
        cols.append(c(weight_col).cast("double").alias("_floe_w"))
    data = assemble(df.select(*cols), features, "_floe_x")
    est = LogisticRegression(featuresCol="_floe_x", labelCol="_floe_y", probabilityCol="_floe_p",
                             rawPredictionCol="_floe_raw", predictionCol="_floe_pred",
                             family="multinomial", maxIter=max_iter)
    if weight_col:
        est = est.setWeightCol("_floe_w")
    return MLModel(est.fit(data), list(features))


def distillation_losses(df: DataFrame, teacher_col: str, student_col: str, label_col: str = "y",
                        temperature: float = 10.0, alpha: float = 0.5, t2_scale: bool = False,
                        mode: str = "prob", att_cols: tuple[str, str] | None = None,
                        att_length: int = 16, beta: float = 0.1) -> DataFrame:
    """One row (hard, soft[, att], total) over a table of both models' probabilities.

    ``mode`` says what is softened: the probabilities (``prob``, K5) or their
    clipped logarithms (``logprob``, K6).  ``t2_scale`` multiplies the soft
    term by temperature squared (K9).  ``att_cols`` names the teacher's and
    the student's attention maps; the student's is resampled to ``att_length``.
    """
    soften = {"prob": temperature_softmax, "logprob": log_temperature_softmax}[mode]
    terms = {"hard": sparse_cross_entropy(c(student_col), c(label_col)),
             "soft": kl_divergence(soften(c(teacher_col), temperature), soften(c(student_col), temperature))}
    if att_cols:
        terms["att"] = mean_squared_error(c(att_cols[0]), resample_linear(c(att_cols[1]), att_length))
    means = df.select(*[v.alias(k) for k, v in terms.items()]).agg(*[F.avg(k).alias(k) for k in terms])
    if t2_scale:
        means = means.withColumn("soft", F.col("soft") * float(temperature) ** 2)
    att = F.col("att") if att_cols else None
    return means.withColumn("total", blend(F.col("hard"), F.col("soft"), alpha, att, beta))


def distillation_targets(df: DataFrame, soft_col: str, label_col: str = "y", alpha: float = 0.5,
                         features: list[str] | None = None) -> DataFrame:
    """K4 input: one row per (row, class) with weight alpha*[k=y] + (1-alpha)*soft_k."""
    keep = [c(f) for f in (features or [])]
    exploded = explode_positions(df, [*keep, c(label_col).alias("_floe_true")], c(soft_col),
                                 "_floe_k", "_floe_soft")
    w = (F.lit(float(alpha)) * (F.col("_floe_k") == F.col("_floe_true")).cast("double")
         + F.lit(1.0 - float(alpha)) * F.col("_floe_soft"))
    return exploded.select(*keep, F.col("_floe_k").cast("int").alias("target"), w.alias("weight")).where(
        F.col("weight") > 0)


def fit_distilled_student(df: DataFrame, features: list[str], soft_col: str, label_col: str = "y",
                          alpha: float = 0.5, max_iter: int = 30, temperature: float = 10.0, t2_scale: bool = True,
                          validation: DataFrame | None = None) -> SoftmaxModel:
    """K4: student trained on alpha * hard loss + (1 - alpha) * [T^2] KL of the softened outputs.

    ``soft_col`` holds the teacher's labels at ``temperature``; the student's scores are
    softened alike, as in the loss of K7-K10 with mode ``logprob``.  With ``validation`` the
    fit stops early on its hard loss and keeps the best step.
    """
    est = SoftmaxRegression(list(features), label_col, soft_col, alpha, temperature, t2_scale, max_steps=max_iter)
    return est.fit(df, validation=validation)


# ------------------------------------------------------------ K16 early stop
def early_stopping(history: DataFrame, run_col: str = "run", epoch_col: str = "epoch",
                   metric_col: str = "metric", patience: int = 5, min_delta: float = 1e-4,
                   mode: str = "min", num_partitions: int | None = None) -> DataFrame:
    """Best and stop epoch of every run in a (run, epoch, metric) table.

    An epoch improves when its metric beats the best so far by more than
    ``min_delta``; the run stops at the epoch where ``patience`` epochs in
    a row did not improve (else at its last epoch); the best epoch is the
    last improvement up to the stop.  A null metric is no improvement.

    The rule is sequential, but before the stop its state is only how many epochs
    ago the best one was, fewer than ``patience``.  So a long run is cut into cells
    (``operators.cells``), each cell is folded from every state it may be entered
    in, and a walk over the cells picks the folds that follow each other.  No list
    is longer than a cell.
    """
    # the monitored metric is explicit and must exist (a misspelt name would
    # otherwise never trigger a stop)
    for name in (run_col, epoch_col, metric_col):
        if name not in history.columns:
            raise ValueError(f"early_stopping: no column {name!r}; history has {history.columns}")
    if mode not in ("min", "max"):
        raise ValueError("mode must be 'min' or 'max'")
    sign = 1.0 if mode == "min" else -1.0
    hist = history.select(c(run_col).alias("run"), c(epoch_col).cast("int").alias("e"),
                          (F.lit(sign) * c(metric_col).cast("double")).alias("v"))
    found = find_cells(hist, ["run"], ["e", "v"], num_partitions)
    lists = found.assign(hist).groupBy("run", CELL, HOT).agg(
        F.array_sort(F.collect_list(F.struct("e", "v"))).alias("h"))

    def state(best, best_e, wait, stop, last):
        return F.struct(best.cast("double").alias("best"), best_e.cast("int").alias("best_e"), wait.cast("int").alias("wait"),
                        stop.cast("int").alias("stop"), last.cast("int").alias("last"))

    def step(acc, x):
        better = F.coalesce(acc["best"].isNull() | ((x["v"] + F.lit(min_delta)) < acc["best"]), F.lit(False))
        wait = F.when(better, F.lit(0)).otherwise(acc["wait"] + 1)
        moved = state(F.when(better, x["v"]).otherwise(acc["best"]), F.when(better, x["e"]).otherwise(acc["best_e"]),
                      wait, F.when(~better & (wait >= patience), x["e"]), x["e"])
        return F.when(acc["stop"].isNotNull(), acc).otherwise(moved)

    none = F.lit(None)
    fresh = state(none, none, F.lit(0), none, none)
    folded = lists.where(~F.col(HOT)).select("run", F.aggregate("h", fresh, step).alias("s"))
    if found.cuts is not None:
        # written once: a mean metric may differ in its last bit between two executions
        lists = stored(lists, "epochs")
        folded = lists.where(~F.col(HOT)).select("run", F.aggregate("h", fresh, step).alias("s"))
        # one row a cell of the hot runs; the last epochs before a cell tell the states it may be entered in
        hot = lists.where(HOT)
        earlier = Window.partitionBy("run").orderBy(CELL).rowsBetween(-patience, -1)
        tails = hot.select("run", CELL, F.slice("h", -F.least(F.size("h"), F.lit(patience)), patience).alias("t"))
        tails = tails.select("run", CELL, F.reverse(F.flatten(F.collect_list("t").over(earlier))).alias("t"))
        entries = F.when(F.size("t") == 0, F.array(fresh)).otherwise(F.transform(
            F.slice("t", 1, patience), lambda x, i: state(x["v"], x["e"], i, none, x["e"])))
        walks = hot.join(tails, ["run", CELL]).select("run", CELL, F.aggregate(
            "h", entries, lambda acc, x: F.transform(acc, lambda s: step(s, x))).alias("exits"))
        path = walks.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(F.col(CELL).alias("at"), "exits"))).alias("p"))
        walk = F.aggregate("p", fresh, lambda acc, cell: F.when(acc["stop"].isNotNull(), acc).otherwise(
            F.element_at(cell["exits"], acc["wait"] + 1)))
        folded = folded.union(path.select("run", walk.alias("s")))
    return folded.select(F.col("run").cast("long").alias("run"), F.col("s.best_e").alias("best_epoch"),
                         (F.lit(sign) * F.col("s.best")).alias("best_metric"),
                         F.coalesce(F.col("s.stop"), F.col("s.last")).alias("stop_epoch"))
