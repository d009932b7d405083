"""Feed ingest: new-link detection, feed -> media, new article rows.

Known links are found with a semi/anti join against the article table (never a
literal IN list); the media of each item comes from one join on the feed url
(never a lookup per item).  Items whose feed is unknown, or whose link/title
is missing, go to a reject frame instead of failing the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_links(items: DataFrame, article: DataFrame) -> DataFrame:
    """Items whose link is already stored (case-sensitive compare).

    A link repeated across a large share of the items (copies of one story)
    makes an oversized partition of the left side, which AQE splits.
    """
    a = article.select(F.col("link_url").alias("link"))
    return items.join(a, ["link"], "left_semi")


def new_links(items: DataFrame, article: DataFrame) -> DataFrame:
    """Items whose link is not stored yet; duplicates within the batch are kept."""
    a = article.select(F.col("link_url").alias("link"))
    return items.join(a, ["link"], "left_anti")


def feed_to_media(items: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, rejects): each item gets the id of the media owning its feed url.

    The media table is per site; AQE broadcasts it from its measured size
    (it comes out of an aggregate).  Several media sharing one feed url resolve
    to the lowest id.
    """
    m = (media.groupBy(F.col("rss_url").alias("feed_url"))
         .agg(F.min("id").alias("media_id")))
    matched = items.join(m, "feed_url")
    rejects = items.join(m, "feed_url", "left_anti")
    return matched, rejects


def article_defaults(items: DataFrame) -> DataFrame:
    """New article rows with '' sentinels for the fields the crawler fills later."""
    return items.select(
        "media_id", "title", F.lit("").alias("author"), F.col("link").alias("link_url"),
        F.lit("").alias("s3_prefix"), F.lit("").alias("image_link"),
        F.col("pub_date").alias("publish_date"))


def insert_new_articles(items: DataFrame, media: DataFrame, article: DataFrame,
                        dedup: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejects) for one ingest run.

    ``dedup=True`` also collapses a link that appears in several feeds of the
    same batch (by default it is inserted once per feed); the item of the
    lowest feed url is kept, so the choice is repeatable.
    """
    valid = F.col("link").isNotNull() & F.col("title").isNotNull()
    bad = items.where(~valid)
    fresh = new_links(items.where(valid), article)
    if dedup:
        others = [c for c in fresh.columns if c != "link"]
        firsts = fresh.groupBy("link").agg(
            F.min_by(F.struct(*others), F.struct("feed_url", "title")).alias("_r"))
        fresh = firsts.select("link", *[F.col(f"_r.{c}").alias(c) for c in others])
    matched, unknown = feed_to_media(fresh, media)
    return article_defaults(matched), bad.unionByName(unknown, allowMissingColumns=True)
