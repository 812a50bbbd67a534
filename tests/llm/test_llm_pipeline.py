"""The pipeline stage by stage against plain versions, and the query list."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import brute  # noqa: E402

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from tabsight.llm import decontaminate, quality  # noqa: E402
from tabsight.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = [q[0] for q in QUERIES]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "target_weights"]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    one = stages[0](spark, docs, SF).cache()
    assert one.columns == docs.columns
    base = {r[0]: r[6] for r in brute.base_counts([(r.doc_id, r.text) for r in docs.collect()])}
    verdict = {r.doc_id: r for r in quality.judge(docs, labels.filter("quality = 1")).collect()}
    left = {r.doc_id for r in one.collect()}
    assert left == {i for i, r in verdict.items() if r.kept} and not any(base[i] for i in left)

    two = stages[1](spark, one, SF).cache()
    groups = brute.near_groups([(r.doc_id, r.text) for r in one.collect()])
    assert sorted(r.doc_id for r in two.collect()) == sorted({g[2] for g in groups})
    assert set(rows_of(two)) <= set(rows_of(one))

    three = stages[2](spark, two, SF).cache()
    items = [decontaminate.normalise(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {r.doc_id for r in two.collect() if any(x in decontaminate.normalise(r.text.encode()) for x in items)}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - exact

    four = stages[3](spark, three, SF).cache()
    assert four.columns == docs.columns and four.count() == three.count()
    before = {r.doc_id: r for r in three.collect()}
    for r in four.collect():
        spans = [(a, e) for a, _, e, _ in brute.base_spans(before[r.doc_id].text)]
        assert ("[SECRET]" in r.text) == bool(spans) and r.n_chars == len(r.text)
        if not spans:
            assert tuple(r) == tuple(before[r.doc_id])
        assert not brute.base_spans(r.text)

    five = stages[4](spark, four, SF)
    assert five.count() == four.count() and five.filter("rate < 0 or rate is null").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == five.count()


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, k):
    """Null columns, repeats and extra columns pass through every stage."""
    rows = [(i, t, None if n % 3 else "en", None if n % 2 else "s", None) for n, (i, t) in enumerate(brute.EDGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .withColumns({c: F.lit("x") for c in ("rid", "fp", "component_id", "score", "kept", "spans", "rate", "_d", "_r")})
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    if k < 4:
        assert out.columns == docs.columns
    assert out.count() <= len(rows)
    assert stage(spark, docs.filter("false"), SF).count() == 0
