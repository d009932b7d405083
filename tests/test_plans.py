"""Plan-shape checks: no Python in the hot path, no cartesian products,
top-k paging, filters pushed into scans, anti-joins on inserts."""

import pytest

from data_paths import SF001

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonMapInArrow",
                "FlatMapGroupsInPandas")
PYTHON_ALLOWED = {"enrich_batch", "failed_jobs", "surrogate_ids", "stream_ack"}
BUILD_ONLY = {"stream_jobs", "stream_poison", "stream_ack", "stream_gate", "stream_fanout",
              "stream_feed_ingest", "site_rules_csv", "table_scan", "table_rebuild",
              "article_text_layout"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    # the entry module's other queries have their own tests
    from gazette.plans.registry import QUERIES, load_all

    load_all()
    return {n: plan_of(f(spark, SF001)) for n, f in QUERIES.items() if n not in BUILD_ONLY}


def test_no_python_outside_enrichment(plans):
    for n, p in plans.items():
        if n not in PYTHON_ALLOWED:
            assert not any(x in p for x in PYTHON_NODES), n


def test_no_cartesian_products(plans):
    for n, p in plans.items():
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, n


def test_paging_is_topk(plans):
    for n in ("timeline_page", "timeline_page_all_langs", "timeline_paging"):
        assert "TakeOrderedAndProject" in plans[n], n


def test_user_filter_reaches_scan(spark, registry):
    q, _ = registry
    df = q["timeline_page"](spark, SF001)
    p = plan_of(df)
    assert "EqualTo(user_id,8)" in p


def test_inserts_anti_join(plans):
    assert "LeftAnti" in plans["insert_new_articles"]
    assert "LeftAnti" in plans["deliveries_idempotent"]
    assert "LeftAnti" in plans["insert_translation"]


def test_extraction_single_stage(plans):
    p = plans["extract_articles"]
    assert "Exchange" not in p and "FileScan parquet" in p
    assert "html" in p


def test_column_pruning(plans):
    # gate and fan-out never read the text or html columns
    for n in ("completeness_gate", "subscription_fanout", "subscription_fanout_all_langs"):
        assert "text#" not in plans[n] and "html#" not in plans[n], n


def test_idempotent_append_reads_touched_buckets_only(spark):
    import os

    from pyspark.sql import functions as F

    from gazette.session import scratch_path
    from gazette.sources import sinks

    path = os.path.join(scratch_path(spark, "test-append"), "t")
    sinks.append_new(spark.range(5000).select(F.col("id").alias("k")), path, ["k"])
    batch = spark.range(4990, 5010).select(F.col("id").alias("k"))
    sinks.append_new(batch, path, ["k"])
    sinks.append_new(batch, path, ["k"])                     # replay adds nothing
    got = sinks.read_bucketed(spark, path)
    assert got.count() == got.distinct().count() == 5010
    b = batch.withColumn("_bucket", F.pmod(F.xxhash64("k"), F.lit(sinks.BUCKETS)).cast("int"))
    touched = [r[0] for r in b.select("_bucket").distinct().collect()]
    scan = spark.read.parquet(path).where(F.col("_bucket").isin(touched))
    import re
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan_of(scan)).group(1)
    assert "_bucket" in filters and ("INSET" in filters or " IN (" in filters), filters
