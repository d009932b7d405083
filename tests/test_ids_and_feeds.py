"""Id blocks shared by batch and stream, and feeds that are broken in places."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from data_paths import SF001
from gazette import app
from gazette.plans.ingest import broken_feed_documents
from gazette.session import scratch_path
from gazette.sources import feeds, seed
from gazette.sources.ids import IdBlocks, with_reserved_ids
from gazette.sources.model import Model
from gazette.streaming import worker


def test_blocks_are_disjoint_and_kept_by_name(spark):
    path = scratch_path(spark, "ids")
    a, b = IdBlocks(spark, path), IdBlocks(spark, path)
    assert a.reserve("one", 10) == 1
    assert b.reserve("two", 5) == 11
    assert b.reserve("one", 10) == 1 and a.reserve("one", 7) == 1
    assert a.reserve("three", 1, above=100) == 101 and b.reserve("four", 3) == 102
    with pytest.raises(ValueError):
        a.reserve("two", 6)


def test_a_taken_number_is_tried_again(spark, monkeypatch):
    """A writer that saw the log before another one wrote takes the next block."""
    path = scratch_path(spark, "ids")
    a, b = IdBlocks(spark, path), IdBlocks(spark, path)
    real, stale = a._last, iter([(0, 0)])
    monkeypatch.setattr(a, "_last", lambda: next(stale, None) or real())
    assert b.reserve("b", 4) == 1 and a.reserve("a", 2) == 5
    assert IdBlocks(spark, path)._read("log/1")["owner"] == "b"


def test_repeated_run_numbers_alike(spark):
    blocks = IdBlocks(spark, scratch_path(spark, "ids"))
    rows = spark.range(500).select(F.concat(F.lit("u"), "id").alias("link"))
    first = {r.link: r.id for r in with_reserved_ids(rows, blocks, "run", ["link"]).collect()}
    blocks.reserve("another", 50)
    again = {r.link: r.id for r in with_reserved_ids(rows.orderBy(F.desc("link")), blocks, "run", ["link"]).collect()}
    assert again == first and sorted(first.values()) == list(range(1, 501))
    assert with_reserved_ids(rows.limit(0), blocks, "none", ["link"]).isEmpty()


def application(spark, name):
    m = Model(spark, SF001)
    root = scratch_path(spark, name)
    app.seed(spark, root, seed.media_with_rules(m.media()), m.user_media())
    return m, root, feeds.feed_items_from_articles(m.article(), m.media())


def items_of(rows):
    return rows.select("link", "title", F.lit(dt.datetime(2024, 1, 5)).cast("timestamp_ntz").alias("pub_date"), "feed_url")


def test_stream_and_batch_ids_never_meet(spark, monkeypatch):
    m, root, rows = application(spark, "test-app-ids")
    first, second, third = (rows.where(f"seq % 3 = {k}") for k in range(3))
    n1 = app.ingest(spark, root, feeds.render_feed_documents(first))
    src = scratch_path(spark, "items")
    items_of(second).coalesce(1).write.parquet(src)

    # the epoch fails after its ids were given; its replay gives them again
    seen, real = [], worker.append_new

    def failing(df, path, key, **kw):
        if path.endswith("/article"):
            seen.append({r.link_url: r.id for r in df.collect()})
            if len(seen) == 1:
                raise RuntimeError("lost")
        return real(df, path, key, **kw)

    monkeypatch.setattr(worker, "append_new", failing)
    with pytest.raises(Exception, match="lost"):
        app.ingest_stream(spark, root, src)
    n_between = app.ingest(spark, root, feeds.render_feed_documents(third))
    app.ingest_stream(spark, root, src)
    assert seen[0] == seen[1] and len(seen) == 2
    arts = app.articles(spark, root)
    streamed = {r.link_url: r.id for r in arts.collect() if r.link_url in seen[0]}
    assert streamed == seen[0]
    assert arts.count() == n1 + n_between + len(streamed) == rows.count()
    assert arts.select("id").distinct().count() == arts.count()
    # streamed rows go through the rest of the application
    pages = arts.where(F.col("link_url").isin(list(streamed))).select(
        F.col("link_url").alias("url"), F.lit("<article>text</article>").alias("html"))
    assert app.crawl(spark, root, pages, dt.datetime(2024, 2, 1)) == len(streamed)


def test_items_and_rejects_are_the_input(spark):
    m = Model(spark, SF001)
    items, rejects = feeds.parse_feed_documents(broken_feed_documents(m, per_doc=9))
    n = m.article().join(m.media().select(F.col("id").alias("media_id")), "media_id").count()
    assert items.count() + rejects.count() == n and rejects.count() > 0


def test_broken_places(spark):
    one = "<item><title>{0}</title><link>http://x/{0}</link></item>"
    docs = [
        ("cut", "<rss><channel>" + one.format(1) + one.format(2) + "<item><title>3</title><li"),
        ("cdata", "<rss><channel><item rdf:about='1'><title><![CDATA[<b>bold</b> & more]]></title><link>l</link></item></channel></rss>"),
        ("middle", one.format(1) + "<item><title>a</b></title></item>" + one.format(3)),
        ("empty", "<rss><channel></channel></rss>"), ("blank", ""), ("null", None),
        ("other", "<items><itemised/></items>" + one.format(4).replace("<item>", "<item\n>")),
        ("self", "<rss><item/>" + one.format(5) + "</rss>")]
    items, rejects = feeds.parse_feed_documents(spark.createDataFrame(docs, "feed_url string, body string"))
    assert {(r.feed_url, r.title) for r in items.collect()} == {
        ("cut", "1"), ("cut", "2"), ("cdata", "<b>bold</b> & more"), ("middle", "1"), ("middle", "3"), ("other", "4"), ("self", "5")}
    assert {(r.feed_url, r.position, r.reason) for r in rejects.collect()} == {
        ("cut", 2, feeds.NOT_CLOSED), ("middle", 1, feeds.NOT_XML), ("empty", None, feeds.NO_ITEMS), ("blank", None, feeds.NO_ITEMS),
        ("null", None, feeds.NO_ITEMS), ("self", 0, feeds.NOT_CLOSED)}


def test_application_keeps_rejects(spark):
    m, root, rows = application(spark, "test-app-rejects")
    docs = feeds.render_feed_documents(rows.limit(20)).select("feed_url", "body").unionByName(spark.createDataFrame(
        [("https://nobody.example.com/rss", "<item><title>t</title><link>l</link></item>"), ("x", "<item><title>t</title></item>"),
         ("x", "<item><title>t & u</title></item>")], "feed_url string, body string"))
    assert app.ingest(spark, root, docs) == 20
    app.ingest(spark, root, docs)
    got = spark.read.parquet(f"{root}/feed_rejects")
    assert sorted(r.reason for r in got.collect()) == sorted([feeds.UNKNOWN_FEED, feeds.NO_LINK_OR_TITLE, feeds.NOT_XML])
