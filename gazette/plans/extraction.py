"""Extraction queries over the fetched pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url_authority, url_host, url_path_lower
from ..operators import extract
from ..operators.fence import where_computed
from ..operators.serve import first_by_id
from .registry import query

HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1))"

_TIERS_SQL = rf"""
select page_id, url, {HOST_SQL} as host,
  regexp_extract(html, '<h1>(.*?)</h1>', 1) as title_1,
  regexp_extract(html, '<title>(.*?)</title>', 1) as title_2,
  regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', '', 'g') as content_1,
  array_to_string(list_transform(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1),
    lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), '') as content_2,
  regexp_extract(html, 'class="author">(.*?)<', 1) as author_1,
  regexp_extract(html, '<footer>&copy; (.*?) &middot;', 1) as author_2,
  regexp_extract(html, '<img[^>]* src="([^"]+)"', 1) as image_link_1,
  regexp_extract(html, '<a href="([^"]+)"', 1) as image_link_2,
  regexp_extract(html, '<time[^>]*>(.*?)</time>', 1) as publish_date_1
from pages where html is not null
"""

_MERGED_SQL = f"""
select page_id, url, host,
  coalesce(nullif(title_1, ''), nullif(title_2, ''), '') as title,
  coalesce(nullif(content_1, ''), nullif(content_2, ''), '') as content,
  coalesce(nullif(author_1, ''), nullif(author_2, ''), '') as author,
  coalesce(nullif(image_link_1, ''), nullif(image_link_2, ''), '') as image_link,
  case when publish_date_1 = '' then timestamp '1970-01-01 00:00:00' end as publish_date
from ({_TIERS_SQL})
"""

_FLAGGED_SQL = f"""
select *, (content = '' or author = '' or publish_date = timestamp '1970-01-01 00:00:00'
           or image_link = '') as incomplete
from ({_MERGED_SQL})
"""


def _all(m):
    return extract.extract_articles(m.t.pages, keep_empty=True)


@query("extract_articles", f"select * from ({_FLAGGED_SQL}) where length(content) > 0")
def q_extract_articles(m):
    """EXT-06: every field, tiers merged, pages with content."""
    return extract.extract_articles(m.t.pages)


@query("extract_title_tiers", f"""
select page_id, title_1, title_2, coalesce(nullif(title_1, ''), nullif(title_2, ''), '') as title
from ({_TIERS_SQL})""")
def q_extract_title_tiers(m):
    """EXT-01: title by tier 1 (h1) then tier 2 (title element)."""
    t = extract.tier_values(m.t.pages)
    return t.select("page_id", "title_1", "title_2",
                    extract.field_priority(F.col("title_1"), F.col("title_2")).alias("title"))


@query("extract_content", f"""
select page_id, content_1, content_2, coalesce(nullif(content_1, ''), nullif(content_2, ''), '') as content
from ({_TIERS_SQL})""")
def q_extract_content(m):
    """EXT-02: content, whole first match (tags dropped) else all paragraphs."""
    t = extract.tier_values(m.t.pages)
    return t.select("page_id", "content_1", "content_2",
                    extract.field_priority(F.col("content_1"), F.col("content_2")).alias("content"))


@query("extract_author", f"select page_id, author from ({_MERGED_SQL})")
def q_extract_author(m):
    """EXT-03: author text of the first match."""
    return _all(m).select("page_id", "author")


@query("extract_image_link", f"select page_id, image_link from ({_MERGED_SQL})")
def q_extract_image_link(m):
    """EXT-04: image link attribute of the first match."""
    return _all(m).select("page_id", "image_link")


@query("extract_publish_date", f"select page_id, publish_date from ({_MERGED_SQL})")
def q_extract_publish_date(m):
    """EXT-05: publish date text -> parsed date, sentinel when missing."""
    return _all(m).select("page_id", "publish_date")


@query("paragraph_concat", f"select page_id, content_2 as paragraphs from ({_TIERS_SQL})")
def q_paragraph_concat(m):
    """AGG-05: text of all matched paragraphs, page order, no separator."""
    return extract.tier_values(m.t.pages).select("page_id", F.col("content_2").alias("paragraphs"))


@query("field_priority", f"select page_id, title, author, image_link from ({_MERGED_SQL})")
def q_field_priority(m):
    """SC-13: first non-empty tier per field."""
    return _all(m).select("page_id", "title", "author", "image_link")


@query("incomplete_extracts", f"select page_id, url from ({_FLAGGED_SQL}) where incomplete")
def q_incomplete_extracts(m):
    """FLT-06: extracts with any of content/author/date/image missing."""
    return where_computed(_all(m), F.col("incomplete")).select("page_id", "url")


@query("non_empty_content", f"select page_id, content from ({_MERGED_SQL}) where length(content) > 0")
def q_non_empty_content(m):
    """FLT-07: only pages with content proceed to write and jobs."""
    return where_computed(_all(m), F.length("content") > 0).select("page_id", "content")


@query("extraction_quality", f"""
select host, count(*) as n_pages, count(*) filter (where author = '') as n_no_author,
  count(*) filter (where image_link = '') as n_no_image,
  count(*) filter (where publish_date = timestamp '1970-01-01 00:00:00') as n_no_date,
  count(*) filter (where content = '') as n_no_content
from ({_MERGED_SQL}) group by host""")
def q_extraction_quality(m):
    """AGG-02: missing-field report per host."""
    return extract.extraction_quality(_all(m))


@query("pages_by_site", f"select page_id, url, {HOST_SQL} as host from pages")
def q_pages_by_site(m):
    """SRC-03: fetched pages keyed by host."""
    return m.t.pages.select("page_id", "url", url_host(F.col("url")).alias("host"))


@query("url_host", r"""
select page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as netloc from pages""")
def q_url_host(m):
    """SC-03: network location (host plus port/userinfo) of each page url."""
    return m.t.pages.select("page_id", url_authority(F.col("url")).alias("netloc"))


@query("url_path_lower", r"""
select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) as path
from pages""")
def q_url_path_lower(m):
    """SC-04: lower-cased url path (query and fragment ignored)."""
    return m.t.pages.select("page_id", url_path_lower(F.col("url")).alias("path"))


@query("host_to_media", r"""
select a.id as article_id, min(m.id) as media_id
from article a join media m
  on lower(m.base_url) = lower(regexp_extract(a.link_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1))
group by a.id""")
def q_host_to_media(m):
    """JOIN-09: article link host -> first media with that base url."""
    media = m.media().select(F.lower("base_url").alias("host"), F.col("id").alias("media_id"))
    first = first_by_id(media.withColumn("id", F.col("media_id")), "host", "id").select("host", "media_id")
    a = m.article().select(F.col("id").alias("article_id"), url_host(F.col("link_url")).alias("host"))
    return a.join(first, "host").select("article_id", "media_id")    # per-site table: AQE broadcasts it
