"""Rules the fixture tables don't reach: lenient URLs, whole paragraphs, date
ends, required message fields, keyed appends and repeated re-queueing."""

import json
import os

from pyspark.sql import functions as F

from data_paths import SF001
from gazette.functions import image_link_eligible, parse_feed_date, url_host, url_path_lower
from gazette.operators import checks, enrich, extract, jobs
from gazette.plans.enrichment import stored_texts
from gazette.session import scratch_path
from gazette.sources import sinks
from gazette.sources.model import Model
from gazette.streaming import worker


def test_urls_are_split_leniently(spark):
    rows = [("https://x.com/a b.jpg", "x.com", "/a b.jpg", True), ("https://x.com/a|b.jpg", "x.com", "/a|b.jpg", True),
            ("https://x.com/a[1].png", "x.com", "/a[1].png", True), ("http://my_host.com/P.GIF?q=1#f", "my_host.com", "/p.gif", True),
            ("http://u:p@Host.com:8080/x", "host.com", "/x", False), ("no url", None, None, False), (None, None, None, False)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, u string")
    got = df.select(url_host(F.col("u")), url_path_lower(F.col("u")), image_link_eligible(F.col("u"))).orderBy("i").collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_date_with_a_newline_is_no_date(spark):
    ok = "Mon, 01 Jan 2024 10:00:00 +0000"
    df = spark.createDataFrame([(ok,), (ok + "\n",)], "d string")
    assert [r[0].year for r in df.select(parse_feed_date(F.col("d"))).collect()] == [2024, 1970]


def test_paragraphs_keep_marked_up_text(spark):
    html = '<p>one</p><p>two <b>bold</b> words</p>\n<p class="x">th\nree</p><pre>no</pre>'
    df = spark.createDataFrame([(1, "https://x.com/", html)], "page_id long, url string, html string")
    assert extract.tier_values(df).first().content_2 == "onetwo bold wordsth\nree"


def test_messages_need_all_required_fields(spark):
    full = {"media_id": 1, "article_id": 2, "title": "t", "s3_prefix": "p"}
    bodies = [full] + [{k: v for k, v in full.items() if k != gone} for gone in full]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "event_id long, body string")
    good, bad = jobs.parse_job_messages(df)
    assert good.count() == 1 and bad.count() == 4


def test_append_keeps_one_row_per_key(spark):
    path = scratch_path(spark, "test-append")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    for _ in range(2):
        sinks.append_new(df, path, ["k"])
    assert sinks.read_bucketed(spark, path).count() == 2


def test_ids_follow_the_order_without_gaps(spark):
    rows = spark.range(1000).select(F.concat(F.lit("l"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("link"))
    got = checks.surrogate_ids(rows.repartition(7), spark.createDataFrame([(41,)], "id long"), ["link"]).orderBy("link").collect()
    assert [r.id for r in got] == list(range(42, 1042))


def test_requeue_twice_adds_nothing_and_unknown_types_are_kept(spark):
    m = Model(spark, SF001)
    tmp = scratch_path(spark, "test-requeue")
    src = os.path.join(tmp, "messages")
    odd = json.dumps({"media_id": 1, "article_id": 2, "title": "t", "s3_prefix": "p", "job_type": "make_podcast"})
    extra = spark.createDataFrame([(10 ** 9, odd)], "event_id long, body string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    messages = m.job_message().select("event_id", "ts", "body").unionByName(extra)
    messages.write.parquet(src)

    def refuse(batch):
        out = enrich.echo_model(batch)
        out["status"] = 500
        return out

    args = (spark, src, stored_texts(m), os.path.join(tmp, "out"), os.path.join(tmp, "c"))
    p = worker.run_worker(*args, refuse)
    assert worker.read_bucketed(spark, p["rejects"]).where("event_id = 1000000000").count() == 1
    n = worker.requeue_failed(spark, p, src)
    assert n > 0 and worker.requeue_failed(spark, p, src) == 0
    assert spark.read.parquet(src).count() == messages.count() + n
    worker.run_worker(*args, refuse)  # fails again: due once more
    assert worker.requeue_failed(spark, p, src) == n
