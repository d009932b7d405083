"""Scalar-function queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (format_publish_date, image_link_eligible, lang_display, s3_prefix_build,
                         text_trim, title_clean, title_key)
from ..functions.text import LANG_NAMES, WHITESPACE_CODES
from ..operators.serve import DEFAULT_THUMBNAIL_BASE, thumbnail_url
from .registry import query


@query("publish_date_text", "select id, strftime(publish_date, '%Y-%m-%d %H:%M') as publish_date_text from article")
def q_publish_date_text(m):
    """SC-02: display format of the publish date."""
    return m.article().select("id", format_publish_date(F.col("publish_date")).alias("publish_date_text"))


@query("title_key", "select id, replace(title, ' ', '_') as title_key from article")
def q_title_key(m):
    """SC-05: blanks -> underscores."""
    return m.article().select("id", title_key(F.col("title")).alias("title_key"))


@query("s3_prefix_build", """
select a.id, 'Articles/media=' || m.name || '/Year=' || cast(year(a.publish_date) as varchar)
  || '/Month=' || cast(month(a.publish_date) as varchar) || '/Day=' || cast(day(a.publish_date) as varchar)
  || '/Hour=' || cast(hour(a.publish_date) as varchar) || '/' || replace(a.title, ' ', '_') as s3_prefix
from article a join media m on m.id = a.media_id""")
def q_s3_prefix_build(m):
    """SC-06: storage prefix from media name, unpadded date parts and title key."""
    md = m.media().select(F.col("id").alias("media_id"), F.col("name").alias("media_name"))
    a = m.article().join(md, "media_id")
    return a.select("id", s3_prefix_build(F.col("media_name"), F.col("publish_date"),
                                          F.col("title")).alias("s3_prefix"))


@query("thumbnail_url", f"""
select id, '{DEFAULT_THUMBNAIL_BASE}' || s3_prefix || '/thumbnail.webp' as thumbnail_path from article""")
def q_thumbnail_url(m):
    """SC-07: public thumbnail location (base is a parameter)."""
    return m.article().select("id", thumbnail_url(F.col("s3_prefix")).alias("thumbnail_path"))


@query("title_clean", "select conv_id, turn, translate(text, ',.;', '') as title from conversations")
def q_title_clean(m):
    """SC-08: drop , . ; from model-written titles."""
    return m.t.conversations.select("conv_id", "turn", title_clean(F.col("text")).alias("title"))


@query("artifact_key", """
select x.event_id, a.s3_prefix || '/lang=' || x.lang || '/' || x.kind as key
from artifact x join article a on a.id = x.article_id""")
def q_artifact_key(m):
    """SC-09: prefix/lang=xx/kind of each artifact."""
    a = m.article().select(F.col("id").alias("article_id"), "s3_prefix")
    x = m.artifact().join(a, "article_id")
    return x.select("event_id", F.concat_ws("/", "s3_prefix", F.concat(F.lit("lang="), "lang"),
                                            "kind").alias("key"))


_LANG_SQL = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in LANG_NAMES.items()) + " else lang end"


@query("lang_display", f"select id, lang, {_LANG_SQL} as lang_name from users")
def q_lang_display(m):
    """SC-10: language code -> display name (lookup map, unknown passes through)."""
    return m.users().select("id", "lang", lang_display(F.col("lang")).alias("lang_name"))


@query("text_trim", f"select conv_id, turn, trim(text, {' || '.join(f'chr({c})' for c in WHITESPACE_CODES)}) as text from conversations")
def q_text_trim(m):
    """SC-11: strip surrounding whitespace of model answers."""
    return m.t.conversations.select("conv_id", "turn", text_trim(F.col("text")).alias("text"))


@query("image_link_eligible", r"""
select id, image_link,
  coalesce(regexp_matches(lower(regexp_extract(image_link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)),
                          '\.(jpg|jpeg|png|gif|bmp)$'), false) as eligible
from article""")
def q_image_link_eligible(m):
    """FLT-05: url path (query ignored), lower-cased, has an image extension."""
    return m.article().select("id", "image_link",
                              image_link_eligible(F.col("image_link")).alias("eligible"))
