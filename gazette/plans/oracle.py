"""SQL text of the derived model tables, for the second-engine check.

Each oracle query is ``WITH <views> <query>``; the driver registers the base
parquet tables as views of the same names.  Unused CTEs cost nothing.
"""

from __future__ import annotations

VIEWS: list[tuple[str, str]] = [
    ("media", """
select distinct cast(substr(source,4) as bigint) as id, source as name,
  concat(source,'.example.com') as base_url, concat('https://',source,'.example.com/rss') as rss_url
from documents"""),
    ("users", """
select c_custkey as id,
  case c_custkey % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end as lang
from customer"""),
    ("article", """
select d.doc_id as id, cast(substr(d.source,4) as bigint) as media_id, substr(d.text,1,60) as title,
  '' as author, concat('https://',d.source,'.example.com/',cast(d.doc_id as varchar)) as link_url,
  case when l.doc_id is null then ''
       else concat('Articles/',d.source,'/',cast(d.doc_id as varchar)) end as s3_prefix,
  case d.doc_id % 4
    when 0 then concat('https://img.example.com/',cast(d.doc_id as varchar),'.JPG?w=10')
    when 1 then concat('https://img.example.com/',cast(d.doc_id as varchar),'.webp')
    when 2 then ''
    else concat('https://img.example.com/',cast(d.doc_id as varchar),'.png') end as image_link,
  e.ts as publish_date
from documents d join events e on d.doc_id = e.event_id left join labels l on l.doc_id = d.doc_id"""),
    ("article_translation", """
select doc_id as article_id, lang, substr(text,1,60) as title, substr(text,1,200) as summary from documents
union all
select doc_id, 'en', substr(text,1,60), case when doc_id % 5 = 0 then '' else substr(text,1,200) end
from documents where lang <> 'en'"""),
    ("user_media", """
select distinct user_id, cast(regexp_extract(props,'[0-9]+',0) as bigint) % 20 as media_id,
  case user_id % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end as lang
from events where event_type = 'signup'"""),
    ("artifact", """
select event_id, user_id as article_id,
  case cast(regexp_extract(props,'[0-9]+',0) as bigint) % 4
    when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end as lang,
  case event_type when 'click' then 'title.txt' when 'view' then 'summary.txt'
    when 'purchase' then 'article.txt' else 'thumbnail.webp' end as kind, ts
from events where event_type <> 'error'"""),
    ("artifact_store", """
select a.article_id, a.lang, a.kind, a.event_id as seq,
  coalesce(case a.kind when 'title.txt' then substr(d.text,1,60)
    when 'summary.txt' then substr(d.text,1,200) when 'article.txt' then d.text else '' end, '') as body
from artifact a left join documents d on d.doc_id = a.article_id"""),
    ("ready", """
select article_id, lang from artifact where kind <> 'thumbnail.webp'
group by article_id, lang having count(distinct kind) = 3"""),
    ("user_article", """
select um.user_id, r.article_id from ready r
join article a on a.id = r.article_id
join user_media um on um.media_id = a.media_id and um.lang = r.lang"""),
    ("user_article_all_langs", """
select distinct um.user_id, r.article_id from ready r
join article a on a.id = r.article_id
join user_media um on um.media_id = a.media_id"""),
    ("job_message", """
select event_id, ts,
  case when event_type = 'error' then '{'
  else concat('{"media_id":',cast(cast(regexp_extract(props,'[0-9]+',0) as bigint) % 20 as varchar),
    ',"article_id":',cast(user_id as varchar),',"title":"","s3_prefix":"p/',cast(event_id as varchar),'"',
    case event_type when 'click' then ',"job_type":"summarize_title"'
      when 'view' then ',"job_type":"translate_article"'
      when 'purchase' then ',"job_type":"get_image"' else '' end, '}') end as body
from events"""),
    ("completion", """
select conv_id, turn, case role when 'assistant' then 200 when 'user' then 429 else 500 end as status, text
from conversations"""),
]


def with_views(sql: str) -> str:
    ctes = ",\n".join(f"{name} as ({body.strip()})" for name, body in VIEWS)
    body = sql.strip()
    if body[:5].lower() == "with ":  # merge the query's own CTEs into the list
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
