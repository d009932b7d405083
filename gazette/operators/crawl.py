"""Crawl step: pending articles + fetched pages -> fixed-up article rows.

Only fields still holding their sentinel are filled; a row date wins over an
extracted date, which wins over the run time.  Articles with non-empty content
get their storage prefix (which marks them crawled); the others stay pending.
Pages are matched to articles by article id (the fetched page of its link).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import resolve_publish_date, s3_prefix_build, url_host
from .extract import extract_articles


def media_of_host(media: DataFrame) -> DataFrame:
    """``(host, media_id, media_name)``: the first media (lowest id) of each
    base url, compared case-insensitively."""
    m = media.select(F.lower("base_url").alias("host"), F.col("id").alias("media_id"),
                     F.col("name").alias("media_name"))
    first = m.groupBy("host").agg(F.min_by(F.struct("media_id", "media_name"), "media_id").alias("_m"))
    return first.select("host", "_m.media_id", "_m.media_name")


def crawl_pending(article: DataFrame, pages: DataFrame, media: DataFrame,
                  run_ts: _dt.datetime, rules: DataFrame | None = None,
                  media_by_host: bool = False) -> DataFrame:
    """Fixed-up rows of pending articles that have a fetched page.

    ``pages``: ``(article_id, url, html)``; ``rules``: compiled rules by host
    (``rules.compile_rules``; default rules where it has none).  Output keeps the article columns
    plus ``content`` (the text to store) and ``changed`` (row differs).

    ``media_by_host=True`` attributes the article to the first media of its
    link's host (its name goes into the storage prefix and its id into the
    job messages) instead of the media of the feed it came from; articles
    whose host has no media are left pending.
    """
    # only the pages of pending articles reach the patterns
    pending = article.where(F.col("s3_prefix") == "").select("id", F.struct(*article.columns).alias("_a"))
    p = pages.select(F.col("article_id").alias("id"), "url", "html").join(pending, "id")
    x = extract_articles(p, rules, keep_empty=True)
    j = x.select(*[F.col(f"_a.{c}").alias(c) for c in article.columns], "content", F.col("author").alias("x_author"),
                 F.col("image_link").alias("x_image"), F.col("publish_date").alias("x_date"))
    if media_by_host:
        hm = media_of_host(media)          # per-site; broadcast by AQE
        j = j.withColumn("host", url_host(F.col("link_url"))).drop("media_id").join(hm, "host").drop("host")
    else:
        j = j.join(media.select(F.col("id").alias("media_id"), F.col("name").alias("media_name")), "media_id")
    date = resolve_publish_date(F.col("publish_date"), F.col("x_date"), run_ts)
    author = F.when(F.col("author") == "", F.col("x_author")).otherwise(F.col("author"))
    image = F.when(F.col("image_link") == "", F.col("x_image")).otherwise(F.col("image_link"))
    fixed = j.select(
        "id", "media_id", "media_name", "title", "link_url", author.alias("author"),
        image.alias("image_link"), date.alias("publish_date"), "content",
        F.col("author").alias("_a0"), F.col("image_link").alias("_i0"),
        F.col("publish_date").alias("_d0"))
    prefix = F.when(F.length("content") > 0,
                    s3_prefix_build(F.col("media_name"), F.col("publish_date"), F.col("title")))
    fixed = fixed.withColumn("s3_prefix", F.coalesce(prefix, F.lit("")))
    changed = ((F.col("author") != F.col("_a0")) | (F.col("image_link") != F.col("_i0"))
               | ~F.col("publish_date").eqNullSafe(F.col("_d0")) | (F.col("s3_prefix") != ""))
    return fixed.withColumn("changed", changed).drop("_a0", "_i0", "_d0")


def usable_page(fetched: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(article_id, url, html)``: one fetched page for each wanted ``(article_id,
    url)``.  Failed fetches (null or empty html) never stand for a page; of several
    good ones the latest fetched counts (``fetched_at``, if the table has it; ties
    and tables without it: the greatest html).  Pages nobody waits for are left
    out before anything is shuffled by text."""
    stamp = F.col("fetched_at") if "fetched_at" in fetched.columns else F.lit(0)
    good = fetched.where(F.length("html") > 0).select("url", "html", stamp.alias("_at"))
    good = good.join(wanted.select("url"), "url", "left_semi")
    best = good.groupBy("url").agg(F.max_by("html", F.struct("_at", "html")).alias("html"))
    return wanted.select("article_id", "url").join(best, "url")


def audit_columns(rows: DataFrame, run_ts: _dt.datetime, inserted: bool = False) -> DataFrame:
    """created_at/updated_at the way the table defaults set them.

    Inserted rows get both stamps; updated rows get ``updated_at`` only where
    something changed (``changed`` column), else keep the stored value.
    """
    ts = F.lit(run_ts).cast("timestamp_ntz")
    if inserted:
        return rows.withColumn("created_at", ts).withColumn("updated_at", ts)
    old = F.col("updated_at") if "updated_at" in rows.columns else F.lit(None).cast("timestamp_ntz")
    return rows.withColumn("updated_at", F.when(F.col("changed"), ts).otherwise(old))
