"""Crawl fix-up, storage layout, job fan-out and job message queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import parse_feed_date
from ..operators import crawl, enrich, jobs
from ..operators.fence import where_computed
from ..sources import feeds, sinks
from .extraction import _MERGED_SQL
from ..session import scratch_path
from .registry import query

_MESSAGES_SQL = """
select event_id, cast(json_extract_string(body, '$.media_id') as bigint) as media_id,
  cast(json_extract_string(body, '$.article_id') as bigint) as article_id,
  json_extract_string(body, '$.title') as title, json_extract_string(body, '$.s3_prefix') as s3_prefix,
  coalesce(json_extract_string(body, '$.job_type'), 'summarize_article') as job_type,
  coalesce(json_extract_string(body, '$.image_link'), '') as image_link,
  coalesce(json_extract_string(body, '$.target_lang'), 'zh-CN') as target_lang
from job_message where json_valid(body)
"""

RUN_TS = dt.datetime(2024, 2, 1, 0, 0, 0)
RUN_TS_SQL = "timestamp '2024-02-01 00:00:00'"


def ingested(m):
    """Articles as the feed ingest stored them: feed date parsed (GMT -> sentinel)."""
    a = m.article()
    txt = feeds.feed_date_text(F.col("publish_date"), F.col("id") % 10 == 9)
    return a.withColumn("publish_date", parse_feed_date(txt))


def fetched_pages(m):
    return m.t.pages.select(F.col("page_id").alias("article_id"), "url", "html")


def crawled(m):
    return crawl.crawl_pending(ingested(m), fetched_pages(m), m.media(), RUN_TS)


_CRAWLED_SQL = f"""
select a.id, a.media_id, md.name as media_name, a.title, a.link_url,
  case when a.author = '' then x.author else a.author end as author,
  case when a.image_link = '' then x.image_link else a.image_link end as image_link,
  coalesce(case when a.id % 10 = 9 then null else date_trunc('second', a.publish_date) end,
           nullif(x.publish_date, timestamp '1970-01-01 00:00:00'), {RUN_TS_SQL}) as publish_date,
  x.content
from article a join ({_MERGED_SQL}) x on x.page_id = a.id join media md on md.id = a.media_id
where a.s3_prefix = ''
"""

_PREFIX = """'Articles/media=' || media_name || '/Year=' || cast(year(publish_date) as varchar)
  || '/Month=' || cast(month(publish_date) as varchar) || '/Day=' || cast(day(publish_date) as varchar)
  || '/Hour=' || cast(hour(publish_date) as varchar) || '/' || replace(title, ' ', '_')"""

_FIXED_SQL = f"""
select *, case when length(content) > 0 then {_PREFIX} else '' end as s3_prefix
from ({_CRAWLED_SQL})
"""

_JOBS_SQL = f"""
select f.id as article_id, f.media_id, f.title, f.s3_prefix, f.image_link, 'zh-CN' as target_lang,
  j.seq, j.job_type
from ({_FIXED_SQL}) f
join (values (0, 'summarize_title'), (1, 'summarize_article'), (2, 'translate_article'),
             (3, 'get_image')) j(seq, job_type)
  on j.seq < 3 or f.image_link <> ''
where length(f.content) > 0
"""


@query("article_fixup", f"select id, author, image_link, publish_date, s3_prefix from ({_FIXED_SQL})")
def q_article_fixup(m):
    """SNK-05: pending rows updated only where a field still held its sentinel."""
    return crawled(m).select("id", "author", "image_link", "publish_date", "s3_prefix")


@query("publish_date_resolve", f"select id, publish_date from ({_CRAWLED_SQL})")
def q_publish_date_resolve(m):
    """SC-12: row date, else extracted date, else the run time."""
    return crawled(m).select("id", "publish_date")


@query("audit_columns", f"""
select id, {RUN_TS_SQL} as updated_at from ({_FIXED_SQL})""")
def q_audit_columns(m):
    """CON-06: updated_at stamped with the run time on rows the fix-up changed."""
    return crawl.audit_columns(crawled(m), RUN_TS).select("id", "updated_at")


@query("article_text_layout", f"""
select id, media_name as media, cast(year(publish_date) as integer) as "Year",
  cast(month(publish_date) as integer) as "Month", cast(day(publish_date) as integer) as "Day",
  cast(hour(publish_date) as integer) as "Hour", replace(title, ' ', '_') as title_key, content as body
from ({_FIXED_SQL}) where length(content) > 0""")
def q_article_text_layout(m):
    """SNK-02: texts written partitioned media/Year/Month/Day/Hour, read back."""
    rows = crawled(m).where(F.length("content") > 0)
    path = sinks.write_article_texts(rows, m.spark)
    return sinks.read_article_texts(m.spark, path)


@query("job_fanout", _JOBS_SQL)
def q_job_fanout(m):
    """SET-02: 3 jobs per crawled article, a 4th (get_image) with an image link."""
    return jobs.job_fanout(crawled(m))


@query("job_queue_rows", f"""
select article_id, seq, json_object('media_id', media_id, 'article_id', article_id, 'title', title,
  's3_prefix', s3_prefix, 'job_type', job_type, 'target_lang', target_lang,
  'image_link', image_link)::varchar as body
from ({_JOBS_SQL})""")
def q_job_queue_rows(m):
    """SNK-03: job messages serialized as JSON text."""
    return jobs.job_queue_rows(jobs.job_fanout(crawled(m)))


@query("job_messages", f"select * from ({_MESSAGES_SQL})")
def q_job_messages(m):
    """SRC-05: message body -> typed job; missing fields take their defaults."""
    js, _ = jobs.parse_job_messages(m.job_message().select("event_id", "body"))
    return js


@query("job_rejects", "select event_id, body from job_message where not json_valid(body)")
def q_job_rejects(m):
    """SRC-05 reject path: bodies that do not parse."""
    _, rej = jobs.parse_job_messages(m.job_message().select("event_id", "body"))
    return rej


@query("article_fixup_merge", f"""
select a.id, a.media_id, a.title, coalesce(f.author, a.author) as author, a.link_url,
  coalesce(f.s3_prefix, a.s3_prefix) as s3_prefix, coalesce(f.image_link, a.image_link) as image_link,
  case when f.id is null then a.publish_date else f.publish_date end as publish_date,
  case when f.id is null then cast(null as timestamp) else {RUN_TS_SQL} end as updated_at
from article a left join ({_FIXED_SQL}) f on f.id = a.id""")
def q_article_fixup_merge(m):
    """SNK-05 + CON-06 as a table write: fixed-up rows merged into the article
    table by id (new snapshot), updated_at stamped where a row changed."""
    fixed = crawl.audit_columns(crawled(m), RUN_TS)
    base = m.article().withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    merged = sinks.merge_by_key(base, fixed, ["id"],
                                ["author", "image_link", "publish_date", "s3_prefix", "updated_at"])
    path = scratch_path(m.spark, "article_snapshot")
    merged.write.mode("overwrite").parquet(path)
    return m.spark.read.parquet(path)


@query("job_text_from_layout", f"""
select j.article_id, j.job_type, f.content as text from ({_JOBS_SQL}) j join ({_FIXED_SQL}) f on f.id = j.article_id
where j.job_type <> 'get_image'""")
def q_job_text_from_layout(m):
    """JOIN-13, SRC-06: the text of each text job read from the folder that the
    job's prefix names in the stored layout."""
    done = where_computed(crawled(m), F.length("content") > 0).checkpoint(eager=True)
    path = sinks.write_article_texts(done, m.spark)
    texts = sinks.read_article_texts(m.spark, path).select(F.col("id").alias("article_id"), F.col("body").alias("text"), *sinks.LAYOUT_PARTS)
    js, _rejects = jobs.parse_job_messages(jobs.job_queue_rows(jobs.job_fanout(done)).select("body"))
    text_jobs = js.where(F.col("job_type").isin(*enrich.TEXT_JOBS)).select("article_id", "job_type", "s3_prefix")
    return text_jobs.join(enrich.texts_of_jobs(text_jobs, texts), "article_id").select("article_id", "job_type", "text")
