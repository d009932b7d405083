"""The pipeline's stages on a small table, each against what it must keep."""

import corpus_pipeline
import __spark_entry__ as E
from gazette.llm import decontam, nearup, quality
from oracle_compare import compare, duck_connect

import pytest

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = step
        step = stage(spark, before, SF)
        assert step.columns == docs.columns, name
        ids = {r.doc_id for r in step.collect()}
        assert ids <= {r.doc_id for r in before.collect()}
        if name == "quality rules":
            assert ids == {r.doc_id for r in quality.judge(before).collect() if r.kept}
        if name == "near dedup":
            assert ids == {r.doc_id for r in nearup.link(before).collect() if r.kept}
        if name == "decontamination":
            bad = {r.doc_id for r in decontam.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert ids == {r.doc_id for r in before.collect()} - bad
        step = spark.createDataFrame(step.collect(), docs.schema)
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, step, SF).collect()}
    assert packed == {r.doc_id for r in step.collect()}


def test_run_and_empty(spark, empty_docs):
    assert corpus_pipeline.run(spark, SF).count() > 0
    step = empty_docs
    for _, stage in corpus_pipeline.STAGES:
        step = spark.createDataFrame(stage(spark, step, SF).collect(), stage(spark, step, SF).schema)
        assert step.count() == 0


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n.startswith("op") and n[2].isdigit()))
def test_queries_match_their_sql(spark, name):
    assert compare(E.queries()[name](spark, SF), duck_connect(SF), E.oracle_sql()[name])["ok"]


def test_line_dedup_cuts_wherever_own_lines_are_left(spark, docs):
    note = "a long notice that is found on every site"
    texts = [f"own {i}\n{note}" for i in range(8)] + [note]
    rows = [(i, t, "en", f"s{i}", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, df, SF).collect()}
    assert out == {i: (f"own {i}", 5) for i in range(8)} | {8: (note, len(note))}
