"""End to end over stored tables: seed -> ingest feeds -> crawl pages ->
worker (batch and stream) -> gate and delivery -> timeline and detail."""

import datetime as dt

from pyspark.sql import functions as F

from data_paths import SF001
from gazette import app
from gazette.session import scratch_path
from gazette.sources import feeds, seed
from gazette.sources.model import Model

RUN = dt.datetime(2024, 2, 1)


def test_pipeline_end_to_end(spark):
    m = Model(spark, SF001)
    root = scratch_path(spark, "test-app")
    app.seed(spark, root, seed.media_with_rules(m.media()), m.user_media())
    docs = feeds.render_feed_documents(feeds.feed_items_from_articles(m.article(), m.media()))
    n_articles = m.article().count()
    assert app.ingest(spark, root, docs) == n_articles
    assert app.ingest(spark, root, docs) == 0                       # links already stored
    arts = app.articles(spark, root)
    assert arts.count() == n_articles
    assert sorted(r.id for r in arts.select("id").collect()) == list(range(1, n_articles + 1))

    # the page fetched for a link: fixture page with the same id as the model article
    link_of = m.article().select(F.col("id").alias("page_id"), F.col("link_url").alias("url"))
    fetched = m.t.pages.select("page_id", "html").join(link_of, "page_id")
    n_pages = fetched.count()
    crawled = app.crawl(spark, root, fetched, RUN, target_lang="en")
    assert crawled == n_pages
    assert app.articles(spark, root).where("s3_prefix <> ''").count() == n_pages
    assert app.crawl(spark, root, fetched, RUN, target_lang="en") == 0   # nothing pending left

    app.work(spark, root)
    text_jobs = 3 * n_pages
    assert spark.read.parquet(f"{root}/artifacts").count() == text_jobs
    queued = spark.read.parquet(f"{root}/queue").count()
    assert spark.read.parquet(f"{root}/acked").count() == queued      # text + image jobs
    app.work(spark, root)                                            # nothing left to take
    assert spark.read.parquet(f"{root}/acked").count() == queued
    app.work(spark, root, stream=True)                               # stream finds nothing new
    assert spark.read.parquet(f"{root}/artifacts").count() == text_jobs

    app.deliver(spark, root)
    ready = spark.read.parquet(f"{root}/ready")
    assert ready.count() == n_pages and ready.select("lang").distinct().first().lang == "en"
    app.deliver(spark, root)                                         # gate fires again: nothing new
    ua = spark.read.parquet(f"{root}/user_article").drop("_bucket")
    n_deliveries = ua.count()
    assert n_deliveries == ua.distinct().count() > 0
    um = m.user_media().where("lang = 'en'")
    media_of = app.articles(spark, root).where("s3_prefix <> ''").select(
        F.col("id").alias("article_id"), "media_id")
    assert n_deliveries == um.join(media_of, "media_id").count()

    user = ua.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first().user_id
    page = app.timeline(spark, root, user, 0, "en").collect()
    assert 0 < len(page) <= 10
    assert [r.publishDate for r in page] == sorted((r.publishDate for r in page), reverse=True)
    d = app.detail(spark, root, page[0].articleId, "en").collect()
    assert len(d) == 1 and d[0].translate_article and d[0].summary


def test_command_line(spark):
    """The stages through ``python -m gazette`` (in-process, shared session)."""
    import os

    from gazette.__main__ import main

    m = Model(spark, SF001)
    root = scratch_path(spark, "test-cli")
    inp = scratch_path(spark, "test-cli-in")
    seed.media_with_rules(m.media()).write.parquet(os.path.join(inp, "media"))
    m.user_media().write.parquet(os.path.join(inp, "um"))
    feeds.render_feed_documents(feeds.feed_items_from_articles(m.article(), m.media())) \
        .write.parquet(os.path.join(inp, "feeds"))
    link_of = m.article().select(F.col("id").alias("page_id"), F.col("link_url").alias("url"))
    m.t.pages.select("page_id", "html").join(link_of, "page_id").select("url", "html") \
        .write.parquet(os.path.join(inp, "pages"))
    main(["seed", "--root", root, "--media", os.path.join(inp, "media"),
          "--user-media", os.path.join(inp, "um")], spark)
    main(["ingest", "--root", root, "--feeds", os.path.join(inp, "feeds")], spark)
    main(["crawl", "--root", root, "--pages", os.path.join(inp, "pages"),
          "--run-ts", "2024-02-01T00:00:00", "--target-lang", "en"], spark)
    main(["work", "--root", root], spark)
    main(["deliver", "--root", root], spark)
    ua = spark.read.parquet(f"{root}/user_article")
    user = ua.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first().user_id
    page = main(["timeline", "--root", root, "--user", str(user)], spark).collect()
    assert 0 < len(page) <= 10
    d = main(["detail", "--root", root, "--article", str(page[0].articleId), "--lang", "en"], spark)
    assert d.count() == 1
