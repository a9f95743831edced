import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_flagship(spark):
    mod = _entry()
    df = mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["class", "precision", "recall", "f1", "support"]
    names = [r["class"] for r in rows]
    assert names[-3:] == ["accuracy", "macro avg", "weighted avg"]
    total = [r for r in rows if r["class"] == "accuracy"][0]["support"]
    assert total == sum(r["support"] for r in rows if r["class"] not in ("accuracy", "macro avg", "weighted avg"))


def test_registry_consistent():
    mod = _entry()
    q, sql = mod.queries(), mod.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 70
    # of the library's own queries; the optional training-data queries are held to brute force in tests/llm
    rows_only = {name for name in mod.QUERIES if name not in sql}
    assert rows_only == {"k1_teacher_forest", "k4_distilled_student_forest", "k4_distillation_report"}


def test_some_queries_run_on_smallest_scale(spark):
    mod = _entry()
    q = mod.queries()
    for name in ("e8_roc_curve", "q1_causal_filter", "k16_early_stopping", "a1_median_impute", "s1_csv_scan"):
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0
