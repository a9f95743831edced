"""End-to-end pipelines over the flow tables.

``classification_pipeline`` is the flagship: clean -> impute -> encode ->
exact stratified split -> scale -> teacher -> report, all as Spark jobs.
``distillation_pipeline`` adds the MLlib teacher, soft labels and the
distilled student.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floe.functions.arrays import temperature_softmax
from floe.functions.text import c, fill_missing
from floe.operators.distill import (CentroidClassifier, SparseCentroidClassifier, distillation_losses, fit_distilled_student, fit_student,
                                    fit_teacher)
from floe.operators.evaluate import classification_report, confusion, evaluate, with_prediction
from floe.operators.ordering import row_index, tail_split
from floe.operators.splits import stratified_split
from floe.plans.preprocess import Preprocess, PreprocessModel
from floe.session import scratch_path
from floe.sources import fixtures as fx


PART = "_floe_part"


@dataclass
class Prepared:
    model: PreprocessModel
    train: DataFrame
    test: DataFrame


def prepare_flows(flows: DataFrame, key: str, label: str, categories=(), drop=(), bools=(),
                  test_size: float = 0.3, seed: int = 42, fit_on: str = "all",
                  persist_input: bool = False, written: bool = False, sparse: bool = False) -> Prepared:
    """One-file flow: split on the label, fit preprocessing, transform both parts.

    ``fit_on='all'`` fits imputer, one-hot and label encoder on every row (as
    the one-file scripts do); 'train' fits them on the train part only.
    Every fitting pass reads the (column-pruned) source; ``persist_input``
    caches it (memory and disk) for inputs that fit, and the caller
    unpersists it with ``spark.catalog.clearCache()``.  ``written`` stores the
    fitted features once, narrow, in the shared folder for learners that read
    them many times; they come back from there and are scaled on the way.
    """
    labelled = flows.withColumn(label, fill_missing(c(label)))
    if persist_input:
        labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK)
    # the split is a projection with per-class boundary literals over it
    split = stratified_split(labelled, label, key, test_size, seed)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    prep = Preprocess(key, label, drop=drop, bools=bools, categories=categories, sparse=sparse)
    model = prep.fit(train, fit_frame=labelled if fit_on == "all" else None, scale=not written)
    if written:
        # written unscaled: the scaler is fitted on the written train rows, not on one more pass over the split's hashes
        whole = model.transform(split, scale=False, keep=("split",)).withColumnRenamed("split", PART)
        path = scratch_path(flows.sparkSession, "features")
        whole.write.partitionBy(PART).parquet(path)
        rows = flows.sparkSession.read.schema(whole.schema).parquet(path)
        train, test = [rows.where(F.col(PART) == part).drop(PART) for part in ("train", "test")]
        model.fit_scaler(train)
        return Prepared(model, model.scaler.transform(train), model.scaler.transform(test))
    return Prepared(model, model.transform(train), model.transform(test))


def classification_pipeline(spark: SparkSession, sf_dir: str, test_size: float = 0.3,
                            seed: int = 42) -> DataFrame:
    """Flagship: report of the centroid teacher on the flow table of ``lineitem``."""
    flows = fx.flows_num(spark, sf_dir)
    p = prepare_flows(flows, "row_id", "l_returnflag", categories=["l_linestatus"],
                      test_size=test_size, seed=seed)
    teacher = CentroidClassifier(p.model.feature_names, "y").fit(p.train)
    scored = with_prediction(teacher.transform(p.test, "probability"), "probability")
    classes = p.model.labels.classes
    conf = confusion(scored, len(classes))
    return classification_report(conf, classes)


def _written_soft_labels(scored: DataFrame, features: list[str], temperature: float) -> DataFrame:
    """(features, y, soft) with the teacher's labels computed once (Z8) and written to the shared folder."""
    soft = scored.select(*[c(f) for f in features], "y", temperature_softmax(F.col("teacher"), temperature).alias("soft"))
    path = scratch_path(scored.sparkSession, "soft")
    soft.write.parquet(path)
    return scored.sparkSession.read.schema(soft.schema).parquet(path)


def distilled_student(flows: DataFrame, key: str, label: str, categories=(), teacher_kind: str = "centroid",
                      temperature: float = 10.0, alpha: float = 0.5, t2_scale: bool = True):
    """K4: (prepared flows, teacher, student distilled from it)."""
    p = prepare_flows(flows, key, label, categories=categories, written=True)
    teacher = fit_teacher(p.train, p.model.feature_names, "y", kind=teacher_kind, num_trees=10, max_depth=5)
    soft = _written_soft_labels(teacher.transform(p.train, "teacher"), p.model.feature_names, temperature)
    return p, teacher, fit_distilled_student(soft, p.model.feature_names, "soft", "y", alpha,
                                             temperature=temperature, t2_scale=t2_scale)


def _centroid_report(p: Prepared) -> DataFrame:
    """Report of the centroid teacher on the test part, with dense or sparse categories."""
    names = p.model.feature_names
    teacher = (SparseCentroidClassifier(names, p.model.categories) if p.model.sparse else CentroidClassifier(names)).fit(p.train)
    scored = with_prediction(teacher.transform(p.test, "probability"), "probability")
    classes = p.model.labels.classes
    return classification_report(confusion(scored, len(classes)), classes)


def sparse_flow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship with a second category of many values (the part of a ``lineitem`` row), kept sparse."""
    flows = fx.flows_num(spark, sf_dir).withColumn("part", F.get(F.split("row_id", "-"), 2))
    return _centroid_report(prepare_flows(flows, "row_id", "l_returnflag", categories=["l_linestatus", "part"],
                                          written=True, sparse=True))


def distillation_pipeline(spark: SparkSession, sf_dir: str, temperature: float = 10.0,
                          alpha: float = 0.5, teacher_kind: str = "forest",
                          with_baseline: bool = False, t2_scale: bool = True,
                          validation_fraction: float = 0.1) -> dict[str, DataFrame]:
    """Teacher -> soft labels -> distilled student, with reports of both.

    Returns the scored test frames and reports; nothing is collected.
    """
    flows = fx.flows_num(spark, sf_dir)
    p = prepare_flows(flows, "row_id", "l_returnflag", categories=["l_linestatus"], written=True)
    feats = p.model.feature_names
    k = len(p.model.labels.classes)
    # the teacher is fitted with a tail validation slice (last 10 % of the
    # train rows in key order, D2) kept apart for its validation metrics
    parts = tail_split(p.train, ["row_id"], validation_fraction)
    fit_part = parts.where(F.col("split") == "train").drop("split")
    val_part = parts.where(F.col("split") == "validation").drop("split")
    teacher = fit_teacher(fit_part, feats, "y", kind=teacher_kind, num_classes=k, num_trees=10, max_depth=5)
    train_t = teacher.transform(p.train, "teacher")
    soft = _written_soft_labels(train_t, feats, temperature)
    student = fit_distilled_student(soft, feats, "soft", "y", alpha, temperature=temperature, t2_scale=t2_scale)
    models = [("teacher", teacher), ("student", student)]
    if with_baseline:   # the standalone student, trained on hard labels only
        models.append(("baseline", fit_student(p.train, feats, "y")))
    out = {}
    for name, model in models:
        scored = with_prediction(model.transform(p.test, "probability"), "probability")
        out[name] = classification_report(confusion(scored, k), p.model.labels.classes)
        out[name + "_scored"] = scored
    # K7-K10 on the test rows: hard loss of the student, KL between the
    # softened teacher and student outputs (x T^2 when t2_scale), the blend
    both = teacher.transform(student.transform(p.test, "s_prob"), "t_prob")
    out["losses"] = distillation_losses(both, "t_prob", "s_prob", "y", temperature, alpha, t2_scale)
    # K15 on the validation slice for both models
    out["validation"] = (evaluate(teacher.transform(val_part, "p"), "p").withColumn("model", F.lit("teacher"))
                         .unionByName(evaluate(student.transform(val_part, "p"), "p")
                                      .withColumn("model", F.lit("student"))))
    return out


ROW_KEY = "_floe_row"


def _with_row_key(df: DataFrame) -> DataFrame:
    """Row key = hash of all columns and an occurrence number among identical rows.

    It depends on the rows only, not on how the files were cut into scan
    partitions: identical rows are interchangeable, so it doesn't matter which
    of them gets which number.  Numbering is two-phase, a hot row is spread.
    """
    marked = [F.coalesce(F.concat(F.lit("+"), c(n)), F.lit("-")) for n in df.columns]
    hashed = df.withColumn("_floe_rowhash", F.md5(F.to_json(F.array(*marked)))).withColumn(
        "_floe_at", F.monotonically_increasing_id())
    numbered = row_index(hashed, ["_floe_at"], "_floe_nth", group_cols=["_floe_rowhash"])
    return numbered.withColumn(ROW_KEY, F.concat_ws("-", "_floe_rowhash", "_floe_nth")).drop(
        "_floe_rowhash", "_floe_at", "_floe_nth")


def one_file_flow(spark: SparkSession, path: str, preset_name: str, test_size: float = 0.3, seed: int = 42,
                  split_joined_names: bool = False, sparse: bool = False) -> tuple[PreprocessModel, DataFrame]:
    """The one-file flow on a raw all-text CSV: returns (model, report).

    Preset columns are dropped, text booleans mapped, categories one-hot
    encoded; imputer, encoders fitted on all rows, scaler on train; centroid
    teacher; classification report on the test part.  ``sparse`` takes categories of any
    number of values.
    """
    from floe.plans.presets import preset
    from floe.sources.csv import read_text_csv
    spec = preset(preset_name, split_joined_names)
    raw = _with_row_key(read_text_csv(spark, path))
    p = prepare_flows(raw, ROW_KEY, spec["label"], categories=spec["categories"], drop=spec["drop"],
                      bools=spec["bools"], test_size=test_size, seed=seed, sparse=sparse, written=sparse)
    return p.model, _centroid_report(p)


def pair_flow(spark: SparkSession, train_path: str, test_path: str, preset_name: str,
              split_joined_names: bool = False) -> tuple[PreprocessModel, DataFrame]:
    """The pre-split pair flow: everything fitted on the train file, applied to the test file."""
    from floe.plans.presets import preset
    from floe.sources.csv import read_pair
    spec = preset(preset_name, split_joined_names)
    train, test = read_pair(spark, train_path, test_path)
    train, test = _with_row_key(train), _with_row_key(test)
    model = Preprocess(ROW_KEY, spec["label"], drop=spec["drop"], bools=spec["bools"],
                       categories=spec["categories"], drop_empty=True).fit(train, test=test)
    tr, te = model.transform(train), model.transform(test)
    teacher = CentroidClassifier(model.feature_names, "y").fit(tr)
    scored = with_prediction(teacher.transform(te, "probability"), "probability")
    classes = model.labels.classes
    return model, classification_report(confusion(scored, len(classes)), classes)
