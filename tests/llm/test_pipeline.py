"""The pipeline's stages: what they drop and keep, and odd input."""

import pytest

import corpus_pipeline
from floe.llm import catalog, quality
from floe.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.staged(after, f"test-{name}")
        sizes.append(docs.count())
    quality, dedup, leaks = sizes[1:4]
    assert sizes[0] > quality > dedup > leaks > 0.5 * sizes[0]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == sizes[4] and {r.shard for r in out.collect()} <= set(range(16))


def test_quality_stage_keeps_what_the_query_predicts_good(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    good = catalog.op6_factorisation_machine_quality(spark, SF).filter("predicted = 1").select("doc_id")
    want = sorted(r.doc_id for r in good.collect())
    given = {}
    keep = quality.keep_good

    def seen(docs, labels, least, metadata=(), **options):
        given.update(least=least, metadata=metadata)
        return keep(docs, labels, least, metadata, **options)

    monkeypatch.setattr(quality, "keep_good", seen)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()) == want
    assert given == {"least": 0.7, "metadata": ("n_chars",)}


def test_stages_take_odd_and_empty_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, root long, pid string, _n int, _d long, _h long, _kept long"
    rows = [(1, None), (2, ""), (None, "x y"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "word " * 20_000)]
    odd = spark.createDataFrame([(d, t, None, None, None, 1, "p", 2, 3, 4, 5) for d, t in rows], kind)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            assert name == "sharding" or after.columns == docs.columns
            assert after.count() <= 3 * len(rows)


@pytest.mark.parametrize("missing", ["floe.llm", "corpus_pipeline"])
def test_entry_without_the_subpackage(missing):
    import subprocess
    import sys
    code = f"""
import importlib.util as u
find = u.find_spec
u.find_spec = lambda name, *a: None if name == {missing!r} else find(name, *a)
import __spark_entry__ as e
assert not e.WITH_LLM and 'pipeline' not in e.queries() and not any(q.startswith('op') for q in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)
