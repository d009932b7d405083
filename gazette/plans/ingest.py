"""Ingest queries: feed documents -> items -> new article rows.

The feeds carry every article of the model; the article table "already
stored" before the run is the crawled part (``s3_prefix <> ''``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse_feed_date
from ..operators import ingest
from ..sources import feeds
from ..session import scratch_path
from .registry import query

_ITEMS_SQL = """
select a.link_url as link, a.title as title,
  case when a.id % 10 = 9 then timestamp '1970-01-01 00:00:00'
       else date_trunc('second', a.publish_date) end as pub_date,
  m.rss_url as feed_url, a.id as id
from article a join media m on m.id = a.media_id
"""


def feed_items(m):
    docs = feeds.render_feed_documents(feeds.feed_items_from_articles(m.article(), m.media()))
    items, _rejects = feeds.parse_feed_documents(docs)
    return items.drop("pub_text")


def stored(m):
    return m.article().where(F.col("s3_prefix") != "")


@query("feed_items", f"select link, title, pub_date, feed_url from ({_ITEMS_SQL})")
def q_feed_items(m):
    """SRC-01: feed XML documents -> one row per item (date parsed, offset dropped)."""
    return feed_items(m)


@query("feeds_union", f"""
select feed_url, count(*) as n_items,
  count(*) filter (where pub_date = timestamp '1970-01-01 00:00:00') as n_undated
from ({_ITEMS_SQL}) group by feed_url""")
def q_feeds_union(m):
    """SET-03: items of all feeds concatenated, counted per feed."""
    it = feed_items(m)
    return it.groupBy("feed_url").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("pub_date") == F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
         .alias("n_undated"))


@query("feed_date_parse", """
select id, strftime(publish_date, '%a, %d %b %Y %H:%M:%S') ||
    case when id % 10 = 9 then ' GMT' else ' -0400' end as pub_text,
  case when id % 10 = 9 then timestamp '1970-01-01 00:00:00'
       else date_trunc('second', publish_date) end as pub_date
from article""")
def q_feed_date_parse(m):
    """SC-01: RFC-822 feed dates -> wall clock; named zones -> 1970 sentinel."""
    a = m.article().select("id", feeds.feed_date_text(
        F.col("publish_date"), F.col("id") % 10 == 9).alias("pub_text"))
    return a.select("id", "pub_text", parse_feed_date(F.col("pub_text")).alias("pub_date"))


@query("known_links", f"""
select i.link, i.feed_url from ({_ITEMS_SQL}) i
where i.link in (select link_url from article where s3_prefix <> '')""")
def q_known_links(m):
    """FLT-09: feed links already stored (semi-join, no literal IN list)."""
    return ingest.known_links(feed_items(m), stored(m)).select("link", "feed_url")


@query("new_links", f"""
select i.link, i.title, i.feed_url from ({_ITEMS_SQL}) i
where not exists (select 1 from article s where s.s3_prefix <> '' and s.link_url = i.link)""")
def q_new_links(m):
    """JOIN-07: feed items whose link is not stored yet (anti-join)."""
    return ingest.new_links(feed_items(m), stored(m)).select("link", "title", "feed_url")


@query("feed_to_media", f"""
select i.link, x.media_id from ({_ITEMS_SQL}) i
join (select rss_url, min(id) as media_id from media group by rss_url) x on x.rss_url = i.feed_url""")
def q_feed_to_media(m):
    """JOIN-08: feed url -> media id with one broadcast join."""
    matched, _ = ingest.feed_to_media(feed_items(m), m.media())
    return matched.select("link", "media_id")


@query("article_defaults", f"""
select m.id as media_id, i.title, '' as author, i.link as link_url, '' as s3_prefix,
  '' as image_link, i.pub_date as publish_date
from ({_ITEMS_SQL}) i join media m on m.rss_url = i.feed_url""")
def q_article_defaults(m):
    """PRJ-03: article rows for feed items with '' sentinels."""
    matched, _ = ingest.feed_to_media(feed_items(m), m.media())
    return ingest.article_defaults(matched)


@query("insert_new_articles", f"""
select m.id as media_id, i.title, '' as author, i.link as link_url, '' as s3_prefix,
  '' as image_link, i.pub_date as publish_date
from ({_ITEMS_SQL}) i join media m on m.rss_url = i.feed_url
where not exists (select 1 from article s where s.s3_prefix <> '' and s.link_url = i.link)""")
def q_insert_new_articles(m):
    """SNK-01: rows appended for unseen links."""
    rows, _rejects = ingest.insert_new_articles(feed_items(m), m.media(), stored(m))
    return rows


@query("feed_files", f"select link, title, pub_date, feed_url from ({_ITEMS_SQL})")
def q_feed_files(m):
    """SRC-01 (files): feed XML files read with the XML data source, rowTag=item."""
    items = feeds.numbered_densely(feeds.feed_items_from_articles(m.article(), m.media()))
    docs = feeds.render_feed_documents(items)
    path = scratch_path(m.spark, "feeds")
    manifest = feeds.write_feed_files(docs, path)
    return feeds.read_feed_files(m.spark, path, manifest).drop("pub_text")


def broken_feed_documents(m, per_doc: int = 50):
    """Feed documents of all articles in which some items are broken: a bare
    ampersand in the title (id % 7 = 3) or no end (id % 7 = 5)."""
    items = feeds.feed_items_from_articles(m.article(), m.media())
    good = F.to_xml(F.struct("title", "link", "pubDate"), {"rowTag": "item"})
    bad = F.concat(F.lit("<item><title>this & that</title><link>"), F.col("link"), F.lit("</link></item>"))
    endless = F.concat(F.lit("<item><title>never closed<link>"), F.col("link"), F.lit("</link>"))
    k = F.col("seq") % 7
    rows = items.select("feed_url", "seq", F.when(k == 3, bad).when(k == 5, endless).otherwise(good).alias("item"))
    docs = rows.groupBy("feed_url", F.floor(F.col("seq") / per_doc).alias("doc_no")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "item"))).alias("its"))
    body = F.concat(F.lit("<rss><channel><title>x</title>"), F.array_join("its.item", "\n"), F.lit("</channel></rss>"))
    return docs.select("feed_url", "doc_no", body.alias("body"))


@query("feed_salvage", f"""
select link, feed_url, case id % 7 when 3 then '{feeds.NOT_XML}' when 5 then '{feeds.NOT_CLOSED}' else 'item' end as status,
  case when id % 7 not in (3, 5) then title end as title,
  case when id % 7 not in (3, 5) then pub_date end as pub_date
from ({_ITEMS_SQL})""")
def q_feed_salvage(m):
    """SRC-01, SET-03: every item of documents with broken items in between, as an
    item or as a reject with its reason."""
    items, rejects = feeds.parse_feed_documents(broken_feed_documents(m))
    link = F.regexp_extract("fragment", "<link>([^<]*)</link>", 1)
    return items.select("link", "feed_url", F.lit("item").alias("status"), "title", "pub_date").unionByName(
        rejects.select(link.alias("link"), "feed_url", F.col("reason").alias("status")), allowMissingColumns=True)
