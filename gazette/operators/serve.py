"""Read side: timeline pages and article details.

A timeline page is one user's deliveries joined to article, media and
translation, newest first, ``page_size`` rows from ``page * page_size``.
The order is total (publish_date desc, then id desc, then lang) so paging is
repeatable; Spark plans the sort+offset+limit as a TakeOrderedAndProject, a
per-partition top-k merged on the driver (bounded by offset+limit rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import format_publish_date

# Rows per page and the public thumbnail location parts.
PAGE_LIMIT = 10
THUMBNAIL_FILE = "/thumbnail.webp"
DEFAULT_THUMBNAIL_BASE = "https://static.example.com/"


def thumbnail_url(s3_prefix, base: str = DEFAULT_THUMBNAIL_BASE):
    return F.concat(F.lit(base), s3_prefix, F.lit(THUMBNAIL_FILE))


def article_deliveries(article: DataFrame, user_article: DataFrame) -> DataFrame:
    """article ⋈ user_article on the article id.  ``user_article`` holds deliveries,
    or deliverable rows that are fanned out afterwards (their channel is kept)."""
    others = [c for c in ("user_id", "to_media", "to_lang") if c in user_article.columns]
    return article.join(user_article.select(*others, F.col("article_id").alias("id")), "id")


def article_media(article: DataFrame, media: DataFrame) -> DataFrame:
    """article ⋈ media.  Media is a per-site table: the planner broadcasts it
    from its file size, or AQE from its measured size after a shuffle; a
    large media table would get a shuffle join instead."""
    m = media.select(F.col("id").alias("media_id"), F.col("name").alias("media_name"))
    return article.join(m, "media_id")


def _translations(translation: DataFrame, lang: str | None) -> DataFrame:
    t = translation.select("article_id", "lang", F.col("title").alias("t_title"), "summary")
    return t if lang is None else t.where(F.col("lang") == lang)


def timeline_rows(article: DataFrame, user_article: DataFrame, media: DataFrame,
                  translation: DataFrame, user_id: int, lang: str | None) -> DataFrame:
    """All timeline cards of one user (unpaged), with sort keys kept."""
    ua = user_article.where(F.col("user_id") == user_id).select(F.col("article_id").alias("id"))
    a = article.select("id", "media_id", "s3_prefix", "publish_date").join(ua, "id")
    a = article_media(a, media)
    t = _translations(translation, lang).withColumnRenamed("article_id", "id")
    return a.join(t, "id")


def card_shape(rows: DataFrame, thumbnail_base: str = DEFAULT_THUMBNAIL_BASE) -> DataFrame:
    return rows.select(
        F.col("id").alias("articleId"), F.col("t_title").alias("title"),
        format_publish_date(F.col("publish_date")).alias("publishDate"),
        "summary", thumbnail_url(F.col("s3_prefix"), thumbnail_base).alias("thumbnailPath"),
        F.col("media_name").alias("media"))


def timeline_page(article: DataFrame, user_article: DataFrame, media: DataFrame,
                  translation: DataFrame, user_id: int, page: int = 0,
                  lang: str | None = "en", page_size: int = PAGE_LIMIT,
                  thumbnail_base: str = DEFAULT_THUMBNAIL_BASE) -> DataFrame:
    """One page of a user's timeline.  ``lang=None`` joins every translation
    (the reference's effective behaviour, where the language test is lost)."""
    rows = timeline_rows(article, user_article, media, translation, user_id, lang)
    ordered = rows.orderBy(F.col("publish_date").desc(), F.col("id").desc(), F.col("lang").asc())
    paged = ordered.offset(page * page_size).limit(page_size) if page else ordered.limit(page_size)
    return card_shape(paged, thumbnail_base)


def latest_articles(article: DataFrame) -> DataFrame:
    """Articles newest first; ties broken by id (descending), NULL dates last."""
    return article.orderBy(F.col("publish_date").desc_nulls_last(), F.col("id").desc())


def detail_rows(article: DataFrame, media: DataFrame, translation: DataFrame,
                article_id: int | None = None, lang: str | None = None) -> DataFrame:
    a = article.select("id", "media_id", "title", "s3_prefix", "publish_date", "link_url")
    if article_id is not None:
        a = a.where(F.col("id") == article_id)
    a = article_media(a, media)
    t = _translations(translation, lang).withColumnRenamed("article_id", "id")
    if article_id is not None:
        t = t.where(F.col("id") == article_id)
    return a.join(t, "id")


def detail_shape(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("article_id"), "lang", "title",
        format_publish_date(F.col("publish_date")).alias("publish_date"),
        "link_url", F.col("media_name").alias("media"),
        F.col("t_title").alias("translate_title"), "summary")


def article_detail(article: DataFrame, media: DataFrame, translation: DataFrame,
                   article_id: int, lang: str | None,
                   artifacts: DataFrame | None = None) -> DataFrame:
    """Detail of one article in one language (``lang=None``: every language).

    With ``artifacts`` (latest text per article/lang/kind) the translated
    article text is attached and an empty summary falls back to summary.txt.
    """
    rows = detail_shape(detail_rows(article, media, translation, article_id, lang))
    if artifacts is None:
        return rows
    return summary_fallback(rows, artifacts)


def summary_fallback(detail: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Attach translated article text; NULL/'' summary -> summary.txt artifact."""
    texts = artifacts.where(F.col("kind").isin("summary.txt", "article.txt")).groupBy(
        "article_id", "lang").agg(
        F.max(F.when(F.col("kind") == "summary.txt", F.col("body"))).alias("_summary_txt"),
        F.max(F.when(F.col("kind") == "article.txt", F.col("body"))).alias("translate_article"))
    j = detail.join(texts, ["article_id", "lang"], "left")
    return j.select(
        *[c for c in detail.columns if c != "summary"],
        F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("_summary_txt")).alias("summary"),
        "translate_article")


def exactly_one_violations(rows: DataFrame, key: str = "article_id") -> DataFrame:
    """Keys matched by other than exactly one row (a detail lookup must be unique)."""
    return (rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") != 1))


def first_by_id(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Deterministic ``.first()``: per key, the row with the lowest id.

    ``min_by`` over a struct is a partial aggregate, so a key holding a third
    of all rows is reduced map-side before the shuffle.
    """
    others = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(id_col)).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
