"""Feed files: full documents from feeds whose numbers are thinly spread."""

from pyspark.sql import functions as F

from gazette.session import scratch_path
from gazette.sources import feeds


def test_documents_are_full(spark):
    items = spark.range(600).select(
        F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("feed_url"), (F.col("id") * 17).alias("seq"),
        F.lit("t").alias("title"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("link"),
        F.lit("Mon, 01 Jan 2024 00:00:07 -0400").alias("pubDate"))
    docs = feeds.render_feed_documents(feeds.numbered_densely(items))
    path = scratch_path(spark, "feeds")
    manifest = feeds.write_feed_files(docs, path)
    assert manifest.count() <= 600 // 50 + 3      # a feed may begin and end inside a document
    got = feeds.read_feed_files(spark, path, manifest).select("feed_url", "link").collect()
    assert sorted(map(tuple, got)) == sorted((f"f{i % 3}", f"l{i}") for i in range(600))
