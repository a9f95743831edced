"""Registry of runnable queries: one per operator of the inventory.

Every query reads the driver tables (or frames Spark derives from them)
and returns a DataFrame with scalar columns; doubles are rounded to six
decimals so results compare across engines.  ``SQL`` holds the matching
DuckDB oracle for every query that has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from floe.functions import arrays as A
from floe.functions.text import bool_text, c, fill_missing, na_to_null, to_numeric
from floe.operators import columns as P
from floe.operators import distill as K
from floe.operators import evaluate as E
from floe.operators import fitted as FT
from floe.operators import joins as J
from floe.operators import ordering as D
from floe.operators import series as Q
from floe.operators.softmax import predictions
from floe.operators.splits import stratified_sample, stratified_split
from floe.plans import pipelines
from floe.sources import csv as S
from floe.sources import fixtures as fx
from floe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def round6(col):
    """Six decimals through DECIMAL(38,10): a last-bit difference between
    engines cannot move a value across a rounding tie."""
    x = col.cast("double")
    return (F.when(F.isnan(x) | (F.abs(x) == float("inf")), x)
            .otherwise(F.round(x.try_cast("decimal(38,10)"), 6).cast("double")))


def r6(df: DataFrame) -> DataFrame:
    """Round every double/float column to 6 decimals."""
    return df.select(*[round6(c(f.name)).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else c(f.name)
                       for f in df.schema.fields])


def _classes(spark, sf) -> list[str]:
    return FT.LabelEncoder("l_returnflag", "y").fit(fx.flows_num(spark, sf)).classes


def _flows_na(spark, sf):
    return S.normalize_na(fx.flows_raw(spark, sf))


# ------------------------------------------------------------------ flagship
@query("flagship_classification_report")
def q_flagship(spark, sf):
    return r6(pipelines.classification_pipeline(spark, sf))


# ------------------------------------------------------------------ S
@query("s1_csv_scan")
def q_s1(spark, sf):
    path = S.write_csv(fx.flows_raw(spark, sf), scratch_path(spark, "flows-csv"))
    df = S.read_text_csv(spark, path)
    return df.select(c("row_id").cast("bigint").alias("row_id"), "value", "flag", "proto", "empty", "label")


@query("s2_na_tokens")
def q_s2(spark, sf):
    return _flows_na(spark, sf)


@query("s3_paired_scan")
def q_s3(spark, sf):
    raw = fx.flows_raw(spark, sf).withColumn("label", fill_missing(na_to_null(F.col("label"))))
    parts = stratified_split(raw, "label", "row_id", 0.3, 42)
    base = scratch_path(spark, "flows-pair")
    S.write_csv(parts.where("split = 'train'").drop("split"), base + "/train")
    S.write_csv(parts.where("split = 'test'").drop("split"), base + "/test")

    def prepare(df):
        return df.select(c("row_id").cast("bigint").alias("row_id"), to_numeric(c("value")).alias("value"),
                         bool_text(c("flag")).alias("flag"), fill_missing(c("proto")).alias("proto"),
                         fill_missing(c("label")).alias("label"))

    train, test = S.read_pair(spark, base + "/train", base + "/test", prepare)
    return r6(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))))


@query("s4_tuple_source")
def q_s4(spark, sf):
    pb = fx.proba_big(spark, sf)
    x = pb.select("row_id", "teacher")
    y = pb.select("row_id", "y")
    soft = pb.select("row_id", A.temperature_softmax(F.col("student"), 10.0).alias("soft"))
    t = J.training_tuples(x, y, soft)
    return r6(A.explode_positions(t, ["row_id", "y"], F.col("soft"), "class", "soft")
              .select("row_id", "y", F.col("class").cast("int").alias("class"), "soft"))


@query("s5_report_sink")
def q_s5(spark, sf):
    pb = E.with_prediction(fx.proba_big(spark, sf), "teacher")
    rep = E.classification_report(E.confusion(pb), _classes(spark, sf))
    path = S.write_report(rep, scratch_path(spark, "report"))
    return r6(spark.read.parquet(path))


# ------------------------------------------------------------------ P
@query("p1_drop_columns")
def q_p1(spark, sf):
    return P.drop_columns(_flows_na(spark, sf), ["empty", "not_a_column"])


@query("p2_feature_selection")
def q_p2(spark, sf):
    df = _flows_na(spark, sf)
    feats = P.feature_columns(df, "label", ["proto"], ["row_id"])
    return df.select("row_id", *feats)


@query("p3_inf_to_null")
def q_p3(spark, sf):
    df = _flows_na(spark, sf)
    raw = F.trim(F.col("value")).try_cast("double")
    return r6(df.select("row_id", (F.isnan(raw) | (F.abs(raw) == float("inf"))).alias("non_finite"),
                        to_numeric(F.col("value")).alias("value")))


@query("p4_bool_text")
def q_p4(spark, sf):
    return P.map_bool_columns(_flows_na(spark, sf), ["flag", "not_a_column"]).select("row_id", "flag")


@query("p5_to_numeric")
def q_p5(spark, sf):
    df = P.coerce_numeric(_flows_na(spark, sf), ["value", "flag", "proto"])
    return r6(df.select("row_id", "value", "flag", "proto"))


@query("p6_fill_missing")
def q_p6(spark, sf):
    return P.fill_categories(_flows_na(spark, sf), ["proto", "label"]).select("row_id", "proto", "label")


@query("p7_label_text")
def q_p7(spark, sf):
    em = fx.proba(spark, sf)
    return em.select("row_id", F.col("y").cast("string").alias("label"))


@query("p8_common_columns")
def q_p8(spark, sf):
    df = _flows_na(spark, sf)
    train = df.drop("flag")
    test = df
    cats = P.common_columns(["proto", "flag", "label"], train, test)
    return P.fill_categories(test.select("row_id", *cats), cats)


@query("p9_non_empty_columns")
def q_p9(spark, sf):
    df = _flows_na(spark, sf)
    return P.non_empty_counts(df, ["value", "flag", "proto", "empty", "label"])


@query("p10_hstack")
def q_p10(spark, sf):
    df = P.coerce_numeric(P.fill_categories(_flows_na(spark, sf), ["proto"]), ["value"])
    imp = FT.MedianImputer(["value"]).fit(df).transform(df)
    oh = FT.OneHotEncoder(["proto"]).fit(imp)
    wide = oh.transform(imp)
    arr = P.assemble_array(wide, ["value"], oh.output_names(), "features", ["row_id"])
    return r6(P.sequence_long(arr, "row_id", "features").select(
        "row_id", F.col("pos").cast("int").alias("pos"), "x"))


@query("p11_reshape")
def q_p11(spark, sf):
    fn = fx.flows_num(spark, sf)
    arr = P.assemble_array(fn, fx.NUM_FEATURES, [], "features", ["row_id"])
    seq = P.as_sequence(arr, "features", "seq")
    return r6(A.explode_positions(seq, ["row_id"], F.col("seq"), "pos", "step")
              .select("row_id", F.col("pos").cast("int").alias("pos"), F.size("step").alias("channels"),
                      F.col("step")[0].alias("x")))


@query("p12_float32")
def q_p12(spark, sf):
    pb = fx.proba_big(spark, sf)
    n = P.narrow_float(pb, ["teacher"])
    return r6(A.explode_positions(n, ["row_id"], F.col("teacher"), "class", "p")
              .select("row_id", F.col("class").cast("int").alias("class"), F.col("p").cast("double").alias("p")))


@query("p13_nest_targets")
def q_p13(spark, sf):
    pb = fx.proba_big(spark, sf).withColumn("soft", A.temperature_softmax(F.col("teacher"), 10.0))
    n = P.nest_targets(pb, "student", "y", "soft", "row_id")
    return r6(n.select("row_id", F.col("target.y").alias("y"), F.array_max("target.soft").alias("soft_max"),
                       F.size("student").alias("width")))


# ------------------------------------------------------------------ J
@query("j1_zip_rows")
def q_j1(spark, sf):
    pb = fx.proba_big(spark, sf)
    t = pb.select("row_id", "y", A.argmax(F.col("teacher")).alias("pred_t"))
    s = pb.select("row_id", A.argmax(F.col("student")).alias("pred_s"))
    return J.zip_by_key(t, s, "row_id")


@query("j2_apply_params")
def q_j2(spark, sf):
    fn = fx.flows_num(spark, sf)
    model = FT.StandardScaler(fx.NUM_FEATURES).fit(fn)
    return r6(model.transform(fn).select("row_id", *fx.NUM_FEATURES))


@query("j3_label_lookup")
def q_j3(spark, sf):
    df = P.fill_categories(_flows_na(spark, sf), ["label"])
    enc = FT.LabelEncoder("label", "y").fit(df)
    return enc.transform(df).select("row_id", "y")


@query("j4_label_decode")
def q_j4(spark, sf):
    fn = fx.flows_num(spark, sf)
    enc = FT.LabelEncoder("l_returnflag", "y").fit(fn)
    pb = E.with_prediction(fx.proba_big(spark, sf), "teacher")
    return enc.decode(pb, "pred", "pred_label").select("row_id", "pred", "pred_label")


# ------------------------------------------------------------------ A
@query("a1_median_impute")
def q_a1(spark, sf):
    df = P.coerce_numeric(_flows_na(spark, sf), ["value"])
    model = FT.MedianImputer(["value"]).fit(df)
    return r6(model.transform(df).select("row_id", "value"))


@query("a2_label_encoder")
def q_a2(spark, sf):
    df = P.fill_categories(_flows_na(spark, sf), ["label"])
    return FT.label_codes(df, "label")


@query("a3_label_mapping")
def q_a3(spark, sf):
    ev = fx.read_table(spark, sf, "events", ["event_type"])
    return FT.LabelEncoder("event_type", "y").fit(ev).mapping


@query("a4_one_hot")
def q_a4(spark, sf):
    df = P.fill_categories(_flows_na(spark, sf), ["proto", "flag"])
    oh = FT.OneHotEncoder(["proto", "flag"]).fit(df)
    return r6(oh.transform(df).select("row_id", *[c(n) for n in oh.output_names()]))


@query("a4_sparse_flow_report")
def q_a4_sparse(spark, sf):
    """One-hot categories of any number, from counts: report of the centroid teacher with the part as a category."""
    return r6(pipelines.sparse_flow_report(spark, sf))


@query("a5_scaler_stats")
def q_a5(spark, sf):
    return r6(FT.scaler_stats(fx.flows_num(spark, sf), fx.NUM_FEATURES))


@query("a6_class_feature_counts")
def q_a6(spark, sf):
    fn = fx.flows_num(spark, sf)
    arr = P.assemble_array(fn, fx.NUM_FEATURES, [], "features", ["l_returnflag"])
    return FT.class_and_feature_counts(arr, "l_returnflag", "features")


@query("a7_class_support")
def q_a7(spark, sf):
    return FT.class_support(fx.flows_num(spark, sf), "l_returnflag")


@query("a8_running_mean_loss")
def q_a8(spark, sf):
    pb = fx.proba_big(spark, sf).withColumn("loss", A.sparse_cross_entropy(F.col("student"), F.col("y")))
    batches = D.assign_batches(pb, "row_id", 256, 42, 0)
    per_batch = FT.epoch_mean(batches, ["batch_id"], "loss", "batch_loss")
    return r6(FT.running_mean(per_batch, [], ["batch_id"], "batch_loss", "running_mean"))


# ------------------------------------------------------------------ D
@query("d1_stratified_split")
def q_d1(spark, sf):
    return stratified_split(fx.flows_num(spark, sf), "l_returnflag", "row_id", 0.3, 42).select("row_id", "split")


@query("d2_tail_validation")
def q_d2(spark, sf):
    return D.tail_split(fx.lineitem_order(spark, sf), fx.LINEITEM_ORDER, 0.1).select("row_id", "split")


@query("d3_stratified_sample")
def q_d3(spark, sf):
    return stratified_sample(fx.flows_num(spark, sf), "l_returnflag", "row_id", 0.1, 42).select(
        "row_id", "l_returnflag")


@query("d4_seeded_shuffle")
def q_d4(spark, sf):
    return D.seeded_shuffle(fx.flows_num(spark, sf).select("row_id"), "row_id", 42, 1, "pos")


@query("d5_batches")
def q_d5(spark, sf):
    return D.assign_batches(fx.flows_num(spark, sf).select("row_id"), "row_id", 256, 42, 0)


@query("d6_row_index")
def q_d6(spark, sf):
    return D.row_index(fx.lineitem_order(spark, sf), fx.LINEITEM_ORDER, "idx").select("row_id", "idx")


# ------------------------------------------------------------------ K
def _split_frames(spark, sf, **options):
    return pipelines.prepare_flows(fx.flows_num(spark, sf), "row_id", "l_returnflag", categories=["l_linestatus"],
                                   **options)


@query("k1_teacher_centroid")
def q_k1(spark, sf):
    p = _split_frames(spark, sf)
    model = K.CentroidClassifier(p.model.feature_names).fit(p.train)
    scored = E.with_prediction(model.transform(p.test, "probability"), "probability")
    return r6(scored.select("row_id", "y", "pred", F.array_max("probability").alias("p_pred")))


@query("k1_teacher_forest")
def q_k1f(spark, sf):
    p = _split_frames(spark, sf, written=True)
    t = K.fit_teacher(p.train, p.model.feature_names, "y", kind="forest", num_trees=10, max_depth=5)
    return E.with_prediction(t.transform(p.test, "probability"), "probability").select("row_id", "y", "pred")


def r4(df: DataFrame) -> DataFrame:
    """Probabilities of an iterative fit: four decimals."""
    return df.withColumn("p_pred", F.round(F.col("p_pred").cast("decimal(38,10)"), 4).cast("double"))


@query("k2_student")
def q_k2(spark, sf):
    p = _split_frames(spark, sf, written=True)
    return r4(predictions(K.fit_student(p.train, p.model.feature_names, "y"), p.test))


@query("k3_batch_scoring")
def q_k3(spark, sf):
    p = _split_frames(spark, sf)
    model = K.CentroidClassifier(p.model.feature_names).fit(p.train)
    scored = model.transform(p.test, "probability")
    return r6(A.explode_positions(scored, ["row_id"], F.col("probability"), "class", "p").select(
        "row_id", F.col("class").cast("int").alias("class"), "p"))


@query("k4_distillation_targets")
def q_k4_targets(spark, sf):
    """Blended targets (row, class, weight) from the centroid teacher at temperature 10."""
    p = _split_frames(spark, sf)
    model = K.CentroidClassifier(p.model.feature_names).fit(p.train)
    soft = model.transform(p.train, "teacher").withColumn("soft", A.temperature_softmax(F.col("teacher"), 10.0))
    return r6(K.distillation_targets(soft, "soft", "y", 0.5, ["row_id"]))


@query("k4_distilled_student")
def q_k4(spark, sf):
    """Student of the centroid teacher on the blended loss with both sides softened (alpha 0.5, T 10, T^2)."""
    p, _, student = pipelines.distilled_student(fx.flows_num(spark, sf), "row_id", "l_returnflag", ["l_linestatus"])
    return r4(predictions(student, p.test))


@query("k4_distilled_student_forest")
def q_k4_forest(spark, sf):
    """The same student, distilled from the MLlib forest."""
    p, _, student = pipelines.distilled_student(fx.flows_num(spark, sf), "row_id", "l_returnflag", ["l_linestatus"],
                                                teacher_kind="forest")
    return r4(predictions(student, p.test))


def _pb_long(spark, sf, col, fn):
    pb = fx.proba_big(spark, sf).withColumn("v", fn(F.col(col)))
    return r6(A.explode_positions(pb, ["row_id"], F.col("v"), "class", "v")
              .select("row_id", F.col("class").cast("int").alias("class"), F.col("v").alias("soft")))


@query("k5_soft_labels")
def q_k5(spark, sf):
    return _pb_long(spark, sf, "teacher", lambda x: A.temperature_softmax(x, 10.0))


@query("k6_log_soft_labels")
def q_k6(spark, sf):
    return _pb_long(spark, sf, "teacher", lambda x: A.log_temperature_softmax(x, 10.0))


def _losses(spark, sf, **options):
    return K.distillation_losses(fx.proba_big(spark, sf), "teacher", "student", **options)


@query("k7_hard_loss")
def q_k7(spark, sf):
    return r6(_losses(spark, sf).select("hard"))


@query("k8_soft_loss")
def q_k8(spark, sf):
    return r6(_losses(spark, sf).select("soft"))


@query("k9_t2_soft_loss")
def q_k9(spark, sf):
    return r6(_losses(spark, sf, t2_scale=True).select(F.col("soft").alias("soft_t2")))


@query("k10_blended_loss")
def q_k10(spark, sf):
    a = _losses(spark, sf, alpha=0.5, t2_scale=True).select(F.lit("alpha0.5_t2").alias("variant"), "*")
    b = _losses(spark, sf, alpha=0.1).select(F.lit("alpha0.1").alias("variant"), "*")
    return r6(a.unionByName(b))


def _attention(spark, sf):
    fm = fx.feature_map(spark, sf)
    return fm.select("row_id", A.attention_map(F.col("fm_t")).alias("att_t"),
                     A.attention_map(F.col("fm_s")).alias("att_s"))


@query("k11_attention_map")
def q_k11(spark, sf):
    at = _attention(spark, sf)
    return r6(A.explode_positions(at, ["row_id"], F.col("att_t"), "pos", "att")
              .select("row_id", F.col("pos").cast("int").alias("pos"), "att"))


@query("k12_attention_loss")
def q_k12(spark, sf):
    at = _attention(spark, sf)
    res = at.select(A.mean_squared_error(F.col("att_t"), A.resample_linear(F.col("att_s"), 16)).alias("att"))
    return r6(res.agg(F.avg("att").alias("att")))


@query("k13_resample")
def q_k13(spark, sf):
    at = _attention(spark, sf)
    return r6(A.explode_positions(at, ["row_id"], A.resample_linear(F.col("att_s"), 16), "pos", "v")
              .select("row_id", F.col("pos").cast("int").alias("pos"), "v"))


@query("k14_three_term_loss")
def q_k14(spark, sf):
    pr = fx.proba(spark, sf)
    at = _attention(spark, sf)
    both = J.zip_by_key(pr, at, "row_id")
    return r6(K.distillation_losses(both, "teacher", "student", mode="logprob", att_cols=("att_t", "att_s")))


@query("k15_evaluate")
def q_k15(spark, sf):
    return r6(E.evaluate(fx.proba_big(spark, sf), "teacher", "y"))


@query("k16_early_stopping")
def q_k16(spark, sf):
    return r6(K.early_stopping(fx.history(spark, sf)))


@query("k17_sparsity_schedule")
def q_k17(spark, sf):
    st = fx.steps(spark, sf)
    return r6(st.select("step", A.polynomial_sparsity(F.col("step")).alias("sparsity"),
                        A.prune_step(F.col("step")).alias("prune")))


@query("k18_magnitude_prune")
def q_k18(spark, sf):
    v = fx.vectors(spark, sf).withColumn("p", A.magnitude_prune(F.col("w"), 0.5))
    return r6(v.select("row_id", F.size(F.filter("p", lambda x: x != 0)).alias("kept"),
                       A.array_sum(F.col("p")).alias("retained_sum"),
                       A.array_sum(F.transform("p", lambda x: F.abs(x))).alias("retained_l1")))


# ------------------------------------------------------------------ E
def _pb_pred(spark, sf):
    return E.with_prediction(fx.proba_big(spark, sf), "teacher")


@query("e1_argmax")
def q_e1(spark, sf):
    return _pb_pred(spark, sf).select("row_id", "pred")


@query("e2_confusion")
def q_e2(spark, sf):
    return E.confusion(_pb_pred(spark, sf))


@query("e3_per_class_report")
def q_e3(spark, sf):
    rep = E.classification_report(E.confusion(_pb_pred(spark, sf)), _classes(spark, sf))
    return r6(rep.where(~F.col("class").isin("accuracy", "macro avg", "weighted avg")))


@query("e4_accuracy")
def q_e4(spark, sf):
    return r6(_pb_pred(spark, sf).agg(E.accuracy("y", "pred").alias("accuracy")))


@query("e5_average_rows")
def q_e5(spark, sf):
    rep = E.classification_report(E.confusion(_pb_pred(spark, sf)), _classes(spark, sf))
    return r6(rep.where(F.col("class").isin("macro avg", "weighted avg")))


@query("e6_formatted_report")
def q_e6(spark, sf):
    rep = E.classification_report(E.confusion(_pb_pred(spark, sf)), _classes(spark, sf))
    return E.format_report(rep)


@query("e6_report_four_decimals")
def q_e6_four(spark, sf):
    rep = E.classification_report(E.confusion(_pb_pred(spark, sf)), _classes(spark, sf))
    return E.format_report(rep, percent=False, digits=4)


def _class_ovr(spark, sf):
    """One-vs-rest rows of the probability matrix; scores rounded so that ties are the same everywhere."""
    ovr = E.one_vs_rest(fx.proba_big(spark, sf), "teacher")
    return r6(ovr.select("class", "score", "is_pos"))


@query("e8_roc_curve_per_class")
def q_e8_class(spark, sf):
    return r6(E.roc_curve(_class_ovr(spark, sf)))


@query("e9_auc_per_class")
def q_e9_class(spark, sf):
    return r6(E.auc(_class_ovr(spark, sf)))


@query("e7_one_vs_rest")
def q_e7(spark, sf):
    return r6(E.one_vs_rest(fx.proba_big(spark, sf), "teacher"))


def _coded_scores(spark, sf):
    sc = fx.scores(spark, sf)
    enc = FT.LabelEncoder("y", "code").fit(sc)
    return enc.transform(sc), len(enc.classes)


@query("e8_roc_curve")
def q_e8(spark, sf):
    rows, classes = _coded_scores(spark, sf)
    return r6(E.roc_curve_shared(rows, "score", "code", classes))


@query("e9_auc")
def q_e9(spark, sf):
    rows, classes = _coded_scores(spark, sf)
    return r6(E.auc_shared(rows, "score", "code", classes))


@query("e10_compare_models")
def q_e10(spark, sf):
    pb = fx.proba_big(spark, sf)
    before = pb.select("row_id", "y", F.col("student").alias("probability"))
    return r6(E.compare_tables(before, pb.select("row_id", "y", F.col("teacher").alias("probability"))))


@query("e11_inference_throughput")
def q_e11(spark, sf):
    pb = fx.proba_big(spark, sf)
    timed = E.inference_throughput(E.with_prediction(pb, "teacher"))
    return timed.select("rows", (F.col("seconds") > 0).alias("timed"), (F.col("ms_per_row") > 0).alias("per_row"))


# ------------------------------------------------------------------ Q
W3 = [0.5, 0.3, 0.2]


@query("q1_causal_filter")
def q_q1(spark, sf):
    return r6(Q.causal_filter(fx.series(spark, sf), W3, rate=2).select("entity", "pos", "id", "x", "y"))


@query("q2_same_filter")
def q_q2(spark, sf):
    return r6(Q.same_filter(fx.series(spark, sf), (0.25, 0.5, 0.25)).select("entity", "pos", "id", "x", "y"))


@query("q3_multi_scale_filter")
def q_q3(spark, sf):
    return r6(Q.multi_scale_filter(fx.series(spark, sf), W3).select("entity", "pos", "id", "y_r1", "y_r2", "y_r4"))


@query("q4_max_pool")
def q_q4(spark, sf):
    return r6(Q.max_pool(fx.series(spark, sf), 2))


@query("q5_global_average_pool")
def q_q5(spark, sf):
    return r6(Q.global_average_pool(fx.series(spark, sf)))


@query("q6_attention_pool")
def q_q6(spark, sf):
    return r6(Q.attention_pool(fx.series(spark, sf), 0.01, 0.0))


@query("q7_residual_block")
def q_q7(spark, sf):
    return r6(Q.residual_block(fx.series(spark, sf), W3, rate=1).select("entity", "pos", "id", "x", "y"))


@query("q8_batch_norm")
def q_q8(spark, sf):
    return r6(Q.batch_norm(fx.series(spark, sf), "x", "entity", "z").select("entity", "id", "x", "z"))


# ------------------------------------------------------------------ end to end
@query("k4_distillation_report")
def q_k4_report(spark, sf):
    """Teacher forest -> soft labels (T=10) -> distilled student -> report (rows only)."""
    out = pipelines.distillation_pipeline(spark, sf, temperature=10.0, alpha=0.5, teacher_kind="forest")
    return r6(out["student"])


@query("pair_flow_report")
def q_pair_flow(spark, sf):
    """Pre-split pair flow: train/test CSV files, everything fitted on train.

    Staged from the flow table by the exact stratified split; then S1-S3
    reads, P4 bool text, P8 common categories, P9 all-empty columns dropped,
    median / one-hot / label / scaler fitted on train and applied to test,
    centroid teacher, report on test.
    """
    from floe.plans.preprocess import Preprocess
    raw = fx.flows_raw(spark, sf).withColumn("label", fill_missing(na_to_null(F.col("label"))))
    parts = stratified_split(raw, "label", "row_id", 0.3, 42)
    base = scratch_path(spark, "flows-pair-flow")
    S.write_csv(parts.where("split = 'train'").drop("split"), base + "/train")
    S.write_csv(parts.where("split = 'test'").drop("split"), base + "/test")
    train, test = S.read_pair(spark, base + "/train", base + "/test")
    prep = Preprocess("row_id", "label", bools=["flag"], categories=["proto"], drop_empty=True).fit(train, test=test)
    tr, te = prep.transform(train), prep.transform(test)
    model = K.CentroidClassifier(prep.feature_names).fit(tr)
    scored = E.with_prediction(model.transform(te, "probability"), "probability")
    classes = prep.labels.classes
    return r6(E.classification_report(E.confusion(scored, len(classes)), classes))


@query("e2_confusion_wide")
def q_e2_wide(spark, sf):
    """E2 wide form: one row per true class, one column per predicted class."""
    return E.confusion_wide(E.confusion(_pb_pred(spark, sf)))
