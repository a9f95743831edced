"""Fitted statistics (A1-A8) and their application to rows.

Each estimator has ``fit(df) -> model`` and ``model.transform(df)``, the
way Spark ML estimators do.  ``fit`` runs distributed aggregations and keeps
only bounded results on the driver: one value per feature (medians, means,
deviations) or one entry per class / category.  ``transform`` inlines them
as literals, so applying fitted state is a narrow projection (no join, no
shuffle) that also works on streaming frames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floe.functions.text import c
from floe.operators.cells import cell_totals
from floe.operators.ordering import running_totals, row_index

# A vocabulary is kept as literals up to this many entries; above it the
# mapping stays a DataFrame and is applied with a join.
LITERAL_VOCAB_LIMIT = 10_000


# ---------------------------------------------------------------- A1 median
def _long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), c(n).cast("double").alias("value"))
                      for n in cols])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull())


def _medians_from_counts(counts: DataFrame, n: DataFrame, offset_col: str | None,
                         num_partitions: int | None, cached: list | None = None) -> DataFrame:
    """Median from (feature, value, cnt) and (feature, n[, offset]) tables.

    ``offset`` is the number of values below the counted ones (0 if None).
    """
    ranked = running_totals(counts, ["feature"], ["value"], {"cum": F.col("cnt")},
                            num_partitions=num_partitions, cached=cached)
    off = F.col(offset_col) if offset_col else F.lit(0)
    lo = F.floor((F.col("n") - 1) / 2) - off
    hi = F.ceil((F.col("n") - 1) / 2) - off
    first = F.col("cum") - F.col("cnt")
    covers = lambda pos: (first <= pos) & (pos <= F.col("cum") - 1)
    # n: one row per feature -> bounded broadcast
    picked = (ranked.join(F.broadcast(n), "feature")
              .where(covers(lo) | covers(hi))
              .select("feature", F.when(covers(lo), F.col("value")).alias("v_lo"),
                      F.when(covers(hi), F.col("value")).alias("v_hi")))
    return picked.groupBy("feature").agg(((F.max("v_lo") + F.max("v_hi")) / 2).alias("median"))


def exact_medians_full(df: DataFrame, cols: list[str], num_partitions: int | None = None,
                       cached: list | None = None) -> DataFrame:
    """Exact medians by ranking every distinct value (map-side combined counts)."""
    long = _long_form(df, cols)
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    n = counts.groupBy("feature").agg(F.sum("cnt").alias("n"))
    return _medians_from_counts(counts, n, None, num_partitions, cached)


# Bins of a feature's values that one selection pass counts.
MEDIAN_BINS = 4_096


def _binary_scale(x: Column) -> Column:
    """Order-preserving: sign times (log2 |x| + 1080), 0 at 0; covers every finite double in about +-2,104."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log2(F.abs(x)) + F.lit(1080.0)))


def exact_medians(df: DataFrame, cols: list[str], num_partitions: int | None = None,
                  accuracy: int = MEDIAN_BINS, cached: list | None = None) -> DataFrame:
    """Exact median of every column (mean of the two middle values), by radix selection.

    Each pass cuts the range that holds the middle ranks of a feature into ``accuracy``
    bins and counts them, with the smallest and largest value of each; the bin of the
    middle ranks is the next range.  The first pass bins by sign and binary logarithm, so
    it takes any spread of magnitudes; the later ones bin evenly, each fixing twelve more
    bits, so some six passes are enough and columns of few distinct values end in one.
    Both middle ranks are known once they part into two bins or a bin holds one value.

    Tasks combine their counts and send at most ``accuracy`` rows a feature; the rows of
    different features meet in different tasks.  NaN is missing.  Returns (feature,
    median); features without any value are absent.  ``num_partitions`` and ``cached`` are
    not needed any more.
    """
    spark, schema = df.sparkSession, "feature string, median double"
    if not cols:
        return spark.createDataFrame([], schema)
    inf = float("inf")
    values = {n: F.when(~F.isnan(c(n).cast("double")), c(n).cast("double")) for n in cols}
    finite = {n: F.when(F.abs(v) < inf, v) for n, v in values.items()}
    row = df.agg(*[x for n in cols for x in (
        F.count(values[n]), F.count(F.when(values[n] == -inf, 1)), F.min(finite[n]), F.max(finite[n]))]).first()
    middle: dict[str, tuple[float, float]] = {}
    ranges: dict[str, tuple[float, float, int, int]] = {}     # low, high, ranks of the middle values above low
    for i, n in enumerate(cols):
        total, lowest, low, high = row[4 * i:4 * i + 4]
        if not total:
            continue
        at = [(total - 1) // 2 - lowest, total // 2 - lowest]
        if low is not None and at[0] >= 0:
            ranges[n] = (low, high, *at)
        else:
            middle[n] = (-inf if at[0] < 0 else inf, -inf if at[1] < 0 else low if low is not None else inf)
    first = True
    while ranges:
        picked = _middle_bins(df, finite, ranges, accuracy, first)
        todo = {}
        for n, (low, high, lo, hi) in ranges.items():
            found = picked.get(n, [])
            own = [next(((b, e, lo - w, hi - w) for w, k, b, e in found if w <= r < w + k), None) for r in (lo, hi)]
            if own[0] is None or own[1] is None or own[0][:2] != own[1][:2]:
                # apart: the last value of one bin and the first of the next, or an infinity after the last
                middle[n] = (inf if own[0] is None else own[0][1], inf if own[1] is None else own[1][0])
            elif own[0][0] == own[0][1]:
                middle[n] = own[0][:2]
            else:
                todo[n] = own[0]
        ranges, first = todo, False
    return spark.createDataFrame([(n, (a + b) / 2 if a != b else a) for n, (a, b) in middle.items()], schema)


def _middle_bins(df: DataFrame, finite: dict[str, Column], ranges: dict[str, tuple[float, float, int, int]],
                 bins: int, logarithmic: bool) -> dict[str, list[tuple[int, int, float, float]]]:
    """Per feature the bins (values below, count, smallest, largest) that hold its middle ranks."""
    names = list(ranges)
    pairs = F.array(*[F.struct(
        F.lit(i).alias("feature"), F.when(finite[n].between(*ranges[n][:2]), finite[n]).alias("value"),
        F.lit(float(ranges[n][0])).alias("low"), F.lit(float(ranges[n][1])).alias("high")) for i, n in enumerate(names)])
    long = df.select(F.inline(pairs)).where(F.col("value").isNotNull())
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    if logarithmic:
        value, low, high = map(_binary_scale, (value, low, high))
    # halved, so that no difference overflows
    share = F.coalesce(F.try_divide(value / 2 - low / 2, high / 2 - low / 2), F.lit(0.0))
    at = F.least(F.greatest(F.floor(share * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = long.groupBy("feature", at.alias("bin")).agg(
        F.count(F.lit(1)).alias("k"), F.min("value").alias("least"), F.max("value").alias("most"))
    before = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("below", F.sum("k").over(before) - F.col("k"))
    # as many rows as features
    wanted = df.sparkSession.createDataFrame([(i, int(ranges[n][2]), int(ranges[n][3])) for i, n in enumerate(names)],
                                             "feature int, lo long, hi long")
    rows = ranked.join(F.broadcast(wanted), "feature").where(
        (F.col("below") <= F.col("hi")) & (F.col("lo") < F.col("below") + F.col("k"))).collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(names[r.feature], []).append((r.below, r.k, r.least, r.most))
    return out


@dataclass
class MedianImputerModel:
    medians: dict[str, float]
    dropped: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill NULLs with the fitted medians; drop columns that had no value."""
        out = []
        for name in df.columns:
            if name in self.dropped:
                continue
            if name in self.medians:
                out.append(F.coalesce(c(name).cast("double"), F.lit(self.medians[name])).alias(name))
            else:
                out.append(c(name))
        return df.select(*out)

    def params(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in self.medians.items()],
                                     "feature string, median double")


class MedianImputer:
    """A1: median imputation; ``strategy`` 'exact' (distributed) or 'approx'."""

    def __init__(self, cols: list[str], strategy: str = "exact", accuracy: int = 100_000):
        self.cols = list(cols)
        self.strategy = strategy
        self.accuracy = accuracy

    def fit(self, df: DataFrame) -> MedianImputerModel:
        if not self.cols:
            return MedianImputerModel({}, [])
        if self.strategy == "approx":
            row = df.agg(*[F.percentile_approx(c(n).cast("double"), 0.5, self.accuracy).alias(f"m{i}")
                           for i, n in enumerate(self.cols)]).first()
            got = {n: row[f"m{i}"] for i, n in enumerate(self.cols)}
        else:
            got = {r["feature"]: r["median"] for r in exact_medians(df, self.cols).collect()}
        medians = {n: float(got[n]) for n in self.cols if got.get(n) is not None}
        dropped = [n for n in self.cols if n not in medians]
        return MedianImputerModel(medians, dropped)


# ---------------------------------------------------------- A2/A3 labels
class LabelEncoderModel:
    def __init__(self, input_col: str, output_col: str, mapping: DataFrame,
                 classes: list[str] | None, on_unseen: str, literal: bool = True):
        self.input_col = input_col
        self.output_col = output_col
        self.mapping = mapping          # (label string, code int)
        self._classes = classes         # sorted labels; None: collected from the mapping when asked for
        self.literal = literal          # inlined in expressions, or joined
        self.on_unseen = on_unseen

    @property
    def classes(self) -> list[str]:
        """Sorted labels, as many as a report has rows."""
        if self._classes is None:
            self._classes = [r["label"] for r in self.mapping.orderBy("code").collect()]
        return self._classes

    @property
    def num_classes(self) -> int:
        return self.mapping.count() if self._classes is None else len(self._classes)

    def _guard(self, code: Column, label: Column) -> Column:
        if self.on_unseen == "error":
            return F.when(code.isNull(), F.raise_error(
                F.concat(F.lit("unseen label: "), F.coalesce(label, F.lit("NULL"))))).otherwise(code)
        return code

    def encode(self, label: Column) -> Column:
        """J3 as an expression (literal vocabulary)."""
        mapping = F.create_map(*[x for i, v in enumerate(self.classes) for x in (F.lit(v), F.lit(i))])
        return self._guard(F.element_at(mapping, label.cast("string")).cast("int"), label)

    def transform(self, df: DataFrame) -> DataFrame:
        """Label -> code; unseen labels raise (or stay NULL with on_unseen='keep')."""
        if self.literal:
            return df.withColumn(self.output_col, self.encode(c(self.input_col)))
        m = self.mapping.withColumnRenamed("label", "_floe_label").withColumnRenamed("code", "_floe_code")
        joined = df.join(m, c(self.input_col).cast("string") == F.col("_floe_label"), "left")
        return (joined.withColumn(self.output_col, self._guard(F.col("_floe_code"), c(self.input_col)))
                .drop("_floe_label", "_floe_code"))

    def decode(self, df: DataFrame, code_col: str, output_col: str) -> DataFrame:
        """Code -> label text."""
        if self.literal:
            names = F.array(*[F.lit(v) for v in self.classes])
            return df.withColumn(output_col, F.element_at(names, c(code_col) + 1))
        m = self.mapping.select(F.col("code").alias("_floe_code"), F.col("label").alias(output_col))
        return df.join(m, c(code_col) == F.col("_floe_code"), "left").drop("_floe_code")


class LabelEncoder:
    """A2: sorted distinct labels -> codes 0..k-1."""

    def __init__(self, input_col: str, output_col: str = "y", on_unseen: str = "error"):
        self.input_col = input_col
        self.output_col = output_col
        self.on_unseen = on_unseen

    def fit(self, df: DataFrame) -> LabelEncoderModel:
        distinct = df.select(c(self.input_col).cast("string").alias("label")).where(
            F.col("label").isNotNull()).distinct()
        classes = sorted(r["label"] for r in distinct.limit(LITERAL_VOCAB_LIMIT + 1).collect())
        if len(classes) > LITERAL_VOCAB_LIMIT:
            # a large vocabulary stays a table; only a report collects its names
            return LabelEncoderModel(self.input_col, self.output_col, label_codes(df, self.input_col), None,
                                     self.on_unseen, False)
        mapping = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(classes)], "label string, code int")
        return LabelEncoderModel(self.input_col, self.output_col, mapping, classes, self.on_unseen)


def label_codes(df: DataFrame, label_col: str) -> DataFrame:
    """A2/A3 as a table (label, code), computed distributed."""
    distinct = df.select(c(label_col).cast("string").alias("label")).where(
        F.col("label").isNotNull()).distinct()
    return row_index(distinct, ["label"], "code").select("label", F.col("code").cast("int"))


# ---------------------------------------------------------------- A4 one-hot
@dataclass
class OneHotModel:
    vocab: dict[str, list[str]]

    def output_names(self) -> list[str]:
        return [f"{col}={v}" for col, vs in self.vocab.items() for v in vs]

    def columns(self) -> list[Column]:
        """One 0/1 double column per (column, category); unseen -> all zeros."""
        out = []
        for col, vs in self.vocab.items():
            for v in vs:
                out.append(F.when(c(col).cast("string") == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
                           .alias(f"{col}={v}"))
        return out

    def transform(self, df: DataFrame, keep_input: bool = False) -> DataFrame:
        keep = [c(n) for n in df.columns if keep_input or n not in self.vocab]
        return df.select(*keep, *self.columns())


class OneHotEncoder:
    """A4: categories sorted per column; vocabularies must be small (one output per category)."""

    def __init__(self, cols: list[str], max_categories: int = LITERAL_VOCAB_LIMIT):
        self.cols = list(cols)
        self.max_categories = max_categories

    def fit(self, df: DataFrame) -> OneHotModel:
        if not self.cols:
            return OneHotModel({})
        long = df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("col"), c(n).cast("string").alias("v"))
                                           for n in self.cols]))).where(F.col("v").isNotNull()).distinct()
        bound = self.max_categories * len(self.cols)
        head = long.limit(bound + 1).collect()      # bounded: at most max_categories per column
        vocab = {n: [] for n in self.cols}
        for r in head:
            vocab[r["col"]].append(r["v"])
        too_big = {k: len(v) for k, v in vocab.items() if len(v) > self.max_categories}
        if too_big or len(head) > bound:
            raise ValueError(f"one-hot vocabulary larger than {self.max_categories} per column: {too_big}")
        return OneHotModel({k: sorted(v) for k, v in vocab.items()})


@dataclass
class SparseOneHotModel:
    """A4 for vocabularies of any size: the mapping (col, v, index) stays a table."""
    cols: list[str]
    mapping: DataFrame

    def transform(self, df: DataFrame, key_col: str) -> DataFrame:
        """(key, indices): the sorted positions of the ones of every row; unseen and NULL values have none.

        The values travel as (key, column, value) rows; the mapping is joined
        without a hint, so adaptive execution broadcasts a small one and splits
        the rows of a frequent category otherwise.
        """
        values = F.array(*[F.struct(F.lit(n).alias("col"), c(n).cast("string").alias("v")) for n in self.cols])
        long = df.select(c(key_col).alias("_floe_key"), F.inline_outer(values))
        found = long.join(self.mapping, ["col", "v"], "left")
        return found.groupBy("_floe_key").agg(F.sort_array(F.collect_list("index")).alias("indices")).select(
            F.col("_floe_key").alias(key_col), "indices")


class SparseOneHotEncoder:
    """A4 without a limit: indices follow the order (column, category)."""

    def __init__(self, cols: list[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> SparseOneHotModel:
        long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("col"),
                                                     c(n).cast("string").alias("v"))
                                           for i, n in enumerate(self.cols)]))).where(F.col("v").isNotNull()).distinct()
        return SparseOneHotModel(self.cols, row_index(long, ["at", "v"], "index").select("col", "v", "index"))


# ---------------------------------------------------------------- A5 scaler
@dataclass
class StandardScalerModel:
    mean: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """(x - mean) / scale for fitted columns; other columns pass through."""
        out = []
        for name in df.columns:
            if name in self.mean:
                out.append(((c(name).cast("double") - F.lit(self.mean[name])) / F.lit(self.scale[name]))
                           .alias(name))
            else:
                out.append(c(name))
        return df.select(*out)

    def params(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, float(self.mean[k]), float(self.scale[k])) for k in self.mean],
                                     "feature string, mean double, scale double")


class StandardScaler:
    """A5: population standard deviation; a zero deviation scales by 1.  NaN is missing in the fit."""

    def __init__(self, cols: list[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> StandardScalerModel:
        if not self.cols:
            return StandardScalerModel({}, {})
        aggs = []
        for i, n in enumerate(self.cols):
            x = F.when(~F.isnan(c(n).cast("double")), c(n).cast("double"))
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        mean = {n: float(row[f"m{i}"] or 0.0) for i, n in enumerate(self.cols)}
        scale = {}
        for i, n in enumerate(self.cols):
            s = row[f"s{i}"]
            scale[n] = float(s) if s not in (None, 0.0) and s == s else 1.0
        return StandardScalerModel(mean, scale)


def scaler_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """A5 statistics as a table (feature, mean, scale), one distributed agg.  NaN is missing."""
    long = _long_form(df, cols).where(~F.isnan("value"))
    sd = F.stddev_pop("value")
    return long.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd).alias("scale"))


# ------------------------------------------------------------ A6, A7, A8
def class_and_feature_counts(df: DataFrame, label_col: str, features_col: str) -> DataFrame:
    """Number of classes and feature-vector length (num_classes, seq_len)."""
    return df.agg(F.count_distinct(c(label_col)).cast("int").alias("num_classes"),
                  F.max(F.size(c(features_col))).cast("int").alias("seq_len"))


def class_support(df: DataFrame, label_col: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(c(label_col).alias("label")).agg(F.count(F.lit(1)).alias("support"))


def epoch_mean(df: DataFrame, group_cols: list[str], value_col: str, out: str = "mean_loss") -> DataFrame:
    """Mean of a metric per epoch (Mean metric at the end of an epoch)."""
    return df.groupBy(*group_cols).agg(F.avg(c(value_col)).alias(out))


def running_mean(df: DataFrame, group_cols: list[str], order_cols: list, value_col: str,
                 out: str = "running_mean") -> DataFrame:
    """Running mean of a metric in step order (Mean metric after each update)."""
    r = cell_totals(df, group_cols, order_cols, {"_floe_s": c(value_col).cast("double")}, index_col="_floe_i")
    return r.withColumn(out, F.col("_floe_s") / (F.col("_floe_i") + 1)).drop("_floe_s", "_floe_i")


