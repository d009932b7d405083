"""The gate whose unfinished pairs are a stored table."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gazette.operators.deliver import REQUIRED_KINDS, completeness_gate
from gazette.session import scratch_path
from gazette.sources.sinks import append_new, read_table_or_empty
from gazette.streaming import worker

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, article_id long, lang string, kind string, ts timestamp_ntz"


def step(spark, root, rows, ttl=None, record=True):
    """One micro-batch: (completed pairs, pairs left in the table)."""
    df = spark.createDataFrame([(i, a, "en", k, DAY + dt.timedelta(days=d)) for i, (a, k, d) in enumerate(rows)], SCHEMA)
    ready, pending = os.path.join(root, "ready"), os.path.join(root, "pending")
    done, recorded = worker.gate_batch(df, ready, pending, ttl)
    out = sorted(r.article_id for r in done.collect())
    if record:
        append_new(done, ready, ["article_id", "lang"])
        recorded()
    left = {r.article_id: (r.has0, r.has1, r.has2) for r in read_table_or_empty(spark, pending, worker.PENDING).collect()}
    return out, left


def test_pairs_complete_and_leave(spark):
    t, s, a = REQUIRED_KINDS
    root = scratch_path(spark, "gate")
    assert step(spark, root, [(1, t, 0), (1, s, 0), (2, t, 0), (3, t, 0), (3, s, 0), (3, a, 0), (4, "thumbnail.webp", 0)]) == (
        [3], {1: (True, True, False), 2: (True, False, False)})
    assert step(spark, root, [(1, a, 1), (3, t, 1)]) == ([1], {2: (True, False, False)})       # 3 is late: nothing
    assert step(spark, root, [(2, s, 2), (2, a, 2), (2, t, 2)]) == ([2], {})


def test_replay_before_and_after_recording(spark):
    t, s, a = REQUIRED_KINDS
    root = scratch_path(spark, "gate")
    step(spark, root, [(1, t, 0), (1, s, 0)])
    batch = [(1, a, 1), (5, t, 1)]
    assert step(spark, root, batch, record=False)[0] == [1]
    assert step(spark, root, batch) == ([1], {5: (True, False, False)})
    assert step(spark, root, batch) == ([], {5: (True, False, False)})


def test_abandoned_pairs_are_given_up(spark):
    t, s, a = REQUIRED_KINDS
    root = scratch_path(spark, "gate")
    # pairs of one article share a folder; 1 is touched again late, in another language's place
    step(spark, root, [(1, t, 0)], ttl="10 days")
    assert step(spark, root, [(1, s, 5)], ttl="10 days") == ([], {1: (True, True, False)})
    other = spark.createDataFrame([(9, 1, "fr", t, DAY + dt.timedelta(days=30))], SCHEMA)
    done, recorded = worker.gate_batch(other, os.path.join(root, "ready"), os.path.join(root, "pending"), "10 days")
    recorded()
    left = {(r.article_id, r.lang) for r in read_table_or_empty(spark, os.path.join(root, "pending"), worker.PENDING).collect()}
    assert done.isEmpty() and left == {(1, "fr")}
    assert step(spark, root, [(1, a, 31)], ttl="10 days")[0] == []      # begun anew


@pytest.mark.parametrize("files", [4])
def test_stream_equals_batch(spark, files):
    root = scratch_path(spark, "gate-stream")
    rows = spark.range(900).select(
        F.col("id").alias("event_id"), (F.col("id") * 7 % 90).alias("article_id"), F.lit("en").alias("lang"),
        F.element_at(F.array(*[F.lit(k) for k in (*REQUIRED_KINDS, "thumbnail.webp")]), (F.hash("id") % 4 + 4).cast("int") % 4 + 1).alias("kind"),
        F.lit(DAY).cast("timestamp_ntz").alias("ts"))
    src = os.path.join(root, "src")
    rows.repartition(files).write.parquet(src)
    article = spark.range(90).select("id", F.lit(1).cast("long").alias("media_id"))
    um = spark.createDataFrame([(1, 1, "en"), (2, 1, "fr")], "user_id long, media_id long, lang string")
    p = worker.run_gate_fanout(spark, src, article, um, os.path.join(root, "out"), os.path.join(root, "chk"), state="table",
                               source_options={"maxFilesPerTrigger": "1"})
    want = {r.article_id for r in completeness_gate(rows).collect()}
    assert {r.article_id for r in worker.read_bucketed(spark, p["ready"]).collect()} == want != set()
    pending = {r.article_id for r in read_table_or_empty(spark, os.path.join(root, "out", "pending"), worker.PENDING).collect()}
    begun = {r.article_id for r in rows.where(F.col("kind").isin(*REQUIRED_KINDS)).collect()}
    assert pending == begun - want
    assert {(r.user_id, r.article_id) for r in worker.read_bucketed(spark, p["deliveries"]).collect()} == {(1, a) for a in want}
