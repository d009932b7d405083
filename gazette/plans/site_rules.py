"""Queries of the per-site rules: three kinds of site with rules of their own
(good, bad and doubled ones) and sites without any.

The stand-in pages are the given pages with a block of markup after ``<body>``,
by kind of site (the first label of the host); dates come from the events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url_host
from ..operators import extract, rules
from ..operators.fence import where_computed
from ..sources import feeds, seed
from ..session import scratch_path
from .extraction import HOST_SQL
from .registry import query

# Kinds of site, the markup of each (before and after the date)
# and their rules (field, tier, pattern).
KINDS = ("www", "m", "blog")
MARKUP = {
    "www": ('<meta name="author" content="Author {id}"><meta property="og:image" content="https://img.example.com/{id}.png">'
            '<meta name="date" content="', '">'),
    "m": ('<div class="by">By {id}</div><img class="lead" src="https://img.example.com/m/{id}.jpg"><time datetime="x">', "</time>"),
    "blog": ('<span class="when">', "</span>"),
}
RULES = {
    "www": [("title", 1, r"<title>(.*?)</title>"), ("content", 1, r"(?s)<article>(.*?)</article>"),
            ("author", 1, r'<meta name="author" content="([^"]*)">'),
            ("image_link", 1, r'<meta property="og:image" content="([^"]*)">'),
            ("publish_date", 1, r'<meta name="date" content="([^"]*)">')],
    "m": [("title", 1, r"<h1>(.*?)</h1>"), ("content", 1, ""), ("content", 2, r"(?s)<p>(.*?)</p>"),
          ("author", 1, r'<div class="by">(.*?)</div>'), ("image_link", 1, r'<img class="lead" src="([^"]+)">'),
          ("publish_date", 1, r'<time datetime="[^"]*">(.*?)</time>')],
    "blog": [("title", 2, r"<title>(.*?)</title>"), ("author", 2, r"<footer>&copy; (.*?) &middot;"),
             ("image_link", 1, r'<a href="([^"]+)"'), ("publish_date", 1, r'<span class="when">(.*?)</span>')],
}
# rules that are left out, with the reason
BAD_RULES = {
    "www": [("colour", 1, "(.*)", rules.UNKNOWN_FIELD), ("title", 3, "(.*)", rules.UNKNOWN_TIER)],
    "m": [("publish_date", 2, "(" + "x" * 1030 + ")", rules.TOO_LONG)],
    "blog": [("title", 1, r"<h1>(.*?</h1>", rules.NOT_A_PATTERN), ("author", 1, r"<footer>&copy; [(]?[^<]*", rules.NO_GROUP),
             ("image_link", 1, r'<img src="([^"]+)"', rules.ANOTHER)],
}

_KIND_SQL = f"regexp_extract({HOST_SQL}, '^(www|m|blog)\\.', 1)"


def _kind(host):
    return F.regexp_extract(host, r"^(www|m|blog)\.", 1)


def site_pages(m):
    """(page_id, url, html): the pages with the markup of their kind of site."""
    date = m.t.events.select(F.col("event_id").alias("page_id"), "ts")
    p = m.t.pages.join(date, "page_id", "left")
    kind, text = _kind(url_host(F.col("url"))), F.coalesce(feeds.feed_date_text(F.col("ts"), F.col("page_id") % 10 == 9), F.lit(""))
    block = F.lit("")
    for k in KINDS:
        before, after = MARKUP[k]
        parts = before.split("{id}")
        ids = [x for p in parts for x in (F.lit(p), F.col("page_id").cast("string"))][:-1]
        block = F.when(kind == k, F.concat(*ids, text, F.lit(after))).otherwise(block)
    return p.select("page_id", "url", F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit("<body>"), block)).alias("html"))


def site_rules(m):
    """(host, field, tier, pattern) for every host of a kind with rules."""
    hosts = m.t.pages.select(url_host(F.col("url")).alias("host")).distinct().withColumn("kind", _kind(F.col("host")))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.lit(t).alias("tier"), F.lit(p).alias("pattern"))
                     for k in KINDS for f, t, p in [*RULES[k], *[r[:3] for r in BAD_RULES[k]]]])
    rows = hosts.select("host", F.col("kind").alias("of"), F.inline(each)).where("of = kind")
    return rows.select(F.upper("host").alias("host"), "field", "tier", "pattern")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _block_sql() -> str:
    out = "case kind"
    for k in KINDS:
        before, after = MARKUP[k]
        ids = " || cast(page_id as varchar) || ".join(_quoted(p) for p in before.split("{id}"))
        out += f" when '{k}' then {ids} || when_text || {_quoted(after)}"
    return out + " else '' end"


def _tier_sql(field: str, tier: int) -> str:
    """The tier's value by kind of site; other sites have the default rules."""
    def value(pattern: str) -> str:
        if pattern == "":
            return "''"
        if field == "content" and tier == 2:
            return (f"array_to_string(list_transform(regexp_extract_all(html, {_quoted(pattern)}, 1), "
                    "lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), '')")
        v = f"regexp_extract(html, {_quoted(pattern)}, 1)"
        return f"regexp_replace({v}, '<[^>]+>', '', 'g')" if field == "content" else v

    default = extract.DEFAULT_RULES[field][tier - 1]
    out = "case kind"
    for k in KINDS:
        # a site's good rule, else '' for a rejected one, else the default
        own = [p for f, t, p in RULES[k] if (f, t) == (field, tier)] + ["" for f, t, *_ in BAD_RULES[k] if (f, t) == (field, tier)]
        out += f" when '{k}' then {value((own or [default])[0])}"
    return out + f" else {value(default)} end"


_DATE = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), +(\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2}) +(?:Z|[+-]\d\d:?[0-5]\d)$"

_SITE_SQL = f"""
with d as (select page_id, url, html, {HOST_SQL} as host, {_KIND_SQL} as kind,
             coalesce(strftime(ts, '%a, %d %b %Y %H:%M:%S') || case when page_id % 10 = 9 then ' GMT' else ' -0400' end, '') as when_text
           from pages left join (select event_id as page_id, ts from events) using (page_id) where html is not null),
p as (select page_id, url, host, kind, replace(html, '<body>', '<body>' || {_block_sql()}) as html from d),
t as (select page_id, url, host, {", ".join(f"{_tier_sql(f, t)} as {f}_{t}" for f in extract.FIELDS for t in (1, 2))} from p),
v as (select page_id, url, host, {", ".join(f"coalesce(nullif({f}_1, ''), nullif({f}_2, ''), '') as {f}" for f in extract.FIELDS)} from t)
select page_id, url, host, title, content, author, image_link,
  coalesce(try_strptime(nullif(regexp_extract(publish_date, '{_DATE}', 1), ''), '%d %b %Y %H:%M:%S'),
           timestamp '1970-01-01 00:00:00') as publish_date
from v where length(content) > 0"""


@query("extract_by_site", _SITE_SQL)
def q_extract_by_site(m):
    """EXT-01..06 with rules of the sites' own: every field by the site's patterns,
    by the default ones where it has none; rejected rules switch their tier off."""
    compiled, _rejects = rules.compile_rules(site_rules(m))
    return extract.extract_articles(site_pages(m), compiled).drop("incomplete")


_REJECTS_SQL = f"""
select h.host, r.field, r.tier, r.pattern, r.reason
from (select distinct {HOST_SQL} as host, {_KIND_SQL} as kind from pages) h
join (values {", ".join(f"({_quoted(k)}, {_quoted(f)}, {t}, {_quoted(p)}, {_quoted(why)})" for k in KINDS for f, t, p, why in BAD_RULES[k])})
  r(kind, field, tier, pattern, reason) using (kind)"""


@query("site_rule_rejects", _REJECTS_SQL)
def q_site_rule_rejects(m):
    """SRC-02: rules that are left out, with the reason of each."""
    return rules.compile_rules(site_rules(m))[1]


@query("site_rules_by_host", f"""
with d as (select page_id, html, {HOST_SQL} as host, {_KIND_SQL} as kind from pages where html is not null)
select host, count(*) as n_pages, count(*) filter (where length({_tier_sql("content", 1)}) = 0) as n_no_first_tier
from d group by host""")
def q_site_rules_by_host(m):
    """SRC-02: the sites' rules written as the seed CSV, read back, compiled and
    applied: pages per host whose content the first tier doesn't find."""
    by_host = rules.compile_rules(site_rules(m))[0]
    hosts = m.t.pages.select(url_host(F.col("url")).alias("host")).distinct()
    own = rules.judged(site_rules(m)).where("reason is null").select("host", "field", "tier", "pattern")
    default = [(f, t) for f in extract.FIELDS for t in (1, 2)]
    cell = {ft: F.max(F.when((F.col("field") == ft[0]) & (F.col("tier") == ft[1]), F.col("pattern"))) for ft in default}
    asked = own.groupBy("host").agg(*[cell[ft].alias(f"{ft[0]}_{ft[1]}") for ft in default])
    off = by_host.select("host", *[(F.col(f"{f}_{t}") == "").alias(f"_off_{f}_{t}") for f, t in default])
    full = hosts.join(asked, "host", "left").join(off, "host", "left")
    column = {x: seed.FIELD_OF[x] for x in seed.RULE_FIELDS}
    rows = full.select(
        F.col("host").alias("name"), F.col("host").alias("base_url"), F.concat(F.lit("https://"), F.col("host"), F.lit("/rss")).alias("rss_url"),
        *[F.when(F.coalesce(F.col(f"_off_{f}_{t}"), F.lit(False)), "").otherwise(F.coalesce(f"{f}_{t}", F.lit(extract.DEFAULT_RULES[f][t - 1]))).alias(f"{kind}_{x}")
          for t, kind in ((1, "xpath"), (2, "selector")) for x, f in column.items()])
    path = seed.write_seed_csv(rows, scratch_path(m.spark, "site-rules"))
    stored = seed.rules_from_media(seed.read_seed_csv(m.spark, path))
    compiled, _rejects = rules.compile_rules(rules.rule_rows(stored))
    got = extract.tier_values(m.t.pages.where("html is not null"), compiled)
    first = where_computed(got.select("host", "content_1"), F.lit(True))
    return first.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"),
                                     F.count_if(F.length("content_1") == 0).alias("n_no_first_tier"))
