"""Streams: restart from the checkpoint adds nothing; a replay of every epoch
into the same sink (lost checkpoint) adds nothing either."""

import os

from data_paths import SF001
from gazette.session import scratch_path
from gazette.sources.model import Model
from gazette.streaming import worker


def _src(m, tmp):
    src = os.path.join(tmp, "artifacts")
    m.artifact().repartitionByRange(3, "event_id").write.parquet(src)
    return src


def test_gate_fanout_restart_and_replay(spark):
    m = Model(spark, SF001)
    tmp = scratch_path(spark, "test-gate")
    src = _src(m, tmp)
    out, chk = os.path.join(tmp, "out"), os.path.join(tmp, "chk")
    p = worker.run_gate_fanout(spark, src, m.article(), m.user_media(), out, chk)
    n1 = worker.read_bucketed(spark, p["deliveries"]).count()
    batch = m.user_article().count()
    assert n1 == batch
    worker.run_gate_fanout(spark, src, m.article(), m.user_media(), out, chk)   # restart
    assert worker.read_bucketed(spark, p["deliveries"]).count() == n1
    worker.run_gate_fanout(spark, src, m.article(), m.user_media(), out, chk + "-new")  # replay
    d = worker.read_bucketed(spark, p["deliveries"])
    assert d.count() == n1 and d.dropDuplicates().count() == n1


def test_feed_stream_twice(spark):
    m = Model(spark, SF001)
    from gazette.plans.ingest import feed_items, stored
    tmp = scratch_path(spark, "test-feed")
    src = os.path.join(tmp, "items")
    feed_items(m).repartition(3).write.parquet(src)
    out = os.path.join(tmp, "out")
    p = worker.run_feed_ingest(spark, src, m.media(), stored(m), out, os.path.join(tmp, "c1"))
    n1 = worker.read_bucketed(spark, p["article"]).count()
    worker.run_feed_ingest(spark, src, m.media(), stored(m), out, os.path.join(tmp, "c2"))
    assert worker.read_bucketed(spark, p["article"]).count() == n1 > 0


def test_feed_stream_watermark_dedup(spark):
    m = Model(spark, SF001)
    from gazette.plans.ingest import feed_items, stored
    tmp = scratch_path(spark, "test-feed-wm")
    src = os.path.join(tmp, "items")
    items = feed_items(m)
    items.unionByName(items).repartition(3).write.parquet(src)      # every link twice
    p = worker.run_feed_ingest(spark, src, m.media(), stored(m), os.path.join(tmp, "out"),
                               os.path.join(tmp, "c"), dedup_state="3650 days")
    got = worker.read_bucketed(spark, p["article"])
    assert got.count() == got.select("link_url").distinct().count() == \
        m.article().where("s3_prefix = ''").count()


def test_worker_redelivers_failed_jobs(spark):
    """A model that fails some requests: those jobs land in the retry table,
    are re-queued, and succeed on the next run; nothing is written twice."""
    import pandas as pd
    from pyspark.sql import functions as F

    from gazette.operators import enrich
    from gazette.plans.enrichment import stored_texts

    m = Model(spark, SF001)
    tmp = scratch_path(spark, "test-worker")
    src = os.path.join(tmp, "messages")
    msgs = m.job_message()
    msgs.repartitionByRange(3, "event_id").write.parquet(src)
    out = os.path.join(tmp, "out")

    def flaky(batch):
        ok = enrich.echo_model(batch)
        ok.loc[batch["event_id"] % 2 == 0, "status"] = 500
        return ok

    p = worker.run_worker(spark, src, stored_texts(m), out, os.path.join(tmp, "c"), flaky)
    n_failed = worker.pending_retries(spark, p).count()
    assert n_failed > 0
    assert worker.requeue_failed(spark, p, src) == n_failed
    worker.run_worker(spark, src, stored_texts(m), out, os.path.join(tmp, "c"), enrich.echo_model)
    # what still fails now is only what can never succeed (no stored text)
    good, failed = enrich.enrich_batch(
        __import__("gazette.plans.enrichment", fromlist=["parsed_jobs"]).parsed_jobs(m), stored_texts(m))
    arts = worker.read_bucketed(spark, p["artifacts"])
    assert arts.count() == arts.select("event_id").distinct().count() == good.count()
    assert worker.pending_retries(spark, p).count() == failed.count()


def test_stateful_gate_keeps_less_state(spark):
    """The custom-state gate gives the same pairs and holds state only for
    pairs not (or no longer) complete; the aggregate keeps every pair."""
    m = Model(spark, SF001)
    tmp = scratch_path(spark, "test-gate-state")
    src = _src(m, tmp)
    rows = {}
    states = {}
    for mode in ("aggregate", "pandas"):
        out, chk = os.path.join(tmp, mode, "out"), os.path.join(tmp, mode, "chk")
        p = worker.run_gate_fanout(spark, src, m.article(), m.user_media(), out, chk, state=mode)
        rows[mode] = sorted(map(tuple, worker.read_bucketed(spark, p["ready"]).collect()))
        states[mode] = spark.read.format("statestore").load(chk).count()
    assert rows["aggregate"] == rows["pandas"] == sorted(map(tuple, m.ready().collect()))
    assert states["pandas"] < states["aggregate"]


def test_feed_stream_duplicates_across_feeds(spark):
    """A link carried by two feeds in one batch is inserted once, with the
    item of the lowest feed url, with and without stream state."""
    from pyspark.sql import functions as F

    m = Model(spark, SF001)
    from gazette.plans.ingest import feed_items, stored
    tmp = scratch_path(spark, "test-feed-dup")
    src = os.path.join(tmp, "items")
    items = feed_items(m)
    other = items.withColumn("feed_url", F.concat(F.col("feed_url"), F.lit("-b")))
    items.unionByName(other).repartition(3, "link").write.parquet(src)   # copies share a batch
    media = m.media().unionByName(m.media().select(
        (F.col("id") + 100).alias("id"), "name", "base_url",
        F.concat(F.col("rss_url"), F.lit("-b")).alias("rss_url")))
    for mode in (None, "all"):
        p = worker.run_feed_ingest(spark, src, media, stored(m), os.path.join(tmp, f"out-{mode}"),
                                   os.path.join(tmp, f"c-{mode}"), dedup_state=mode)
        got = worker.read_bucketed(spark, p["article"])
        assert got.count() == got.select("link_url").distinct().count() == \
            m.article().where("s3_prefix = ''").count()
        if mode is None:
            assert got.where("media_id >= 100").count() == 0     # lowest feed url kept


def test_stream_accepts_streaming_dataframe(spark):
    """A caller-built streaming source (e.g. a message bus) instead of a folder."""
    m = Model(spark, SF001)
    tmp = scratch_path(spark, "test-stream-df")
    src = os.path.join(tmp, "messages")
    m.job_message().repartition(2).write.parquet(src)
    source = spark.readStream.schema(worker.MESSAGE).option("maxFilesPerTrigger", 1).parquet(src)
    p = worker.run_parse(spark, source, os.path.join(tmp, "out"), os.path.join(tmp, "chk"))
    n_jobs = worker.read_bucketed(spark, p["jobs"]).count()
    n_rej = worker.read_bucketed(spark, p["rejects"]).count()
    assert n_jobs + n_rej == m.job_message().count() and n_rej > 0
