"""Queries of the one-pass constraint report, over tables that break constraints.

The stand-in tables are the model's with some columns replaced and some rows
doubled; the replacing expressions are read by both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints
from ..schemas import FOREIGN_KEYS, LENGTH_CAPS, PRIMARY_KEYS, RULE_FIELDS, TABLES
from ..sources import sinks
from ..session import scratch_path
from .registry import query

# Per table the source in SQL, columns by expression, rows that
# stand twice.
STAND_IN = {
    "user": ("select c_custkey as id, case c_custkey % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end as lang from customer", {
        "email": "case when id % 50 = 1 then null when id % 41 = 1 then repeat('e', 300) else concat('user', cast(id as string), '@example.com') end"}, "id % 60 = 5"),
    "media": ("select * from media", {
        "name": "case when id = 5 then repeat(name, 60) else name end", "base_url": "case when id = 4 then null else base_url end",
        "rss_url": "case when id = 6 then repeat(rss_url, 30) else rss_url end",
        **{f"{k}_{x}": f"case when id = 7 then repeat('{x[:1]}', 1025) else '' end" for k in ("xpath", "selector") for x in RULE_FIELDS}}, "id = 2"),
    "category": ("select n_nationkey as id, n_name as name from nation", {"name": "case when id = 7 then null else name end"}, "id = 3"),
    "article": ("select * from article", {
        "media_id": "case when id % 19 = 0 then id + 1000 else media_id end", "category_id": "case when id % 5 = 0 then null else id % 30 end",
        "title": "case when id % 11 = 0 then null when id % 13 = 0 then repeat('long', 129) else title end",
        "link_url": "case when id % 23 = 0 then null else link_url end", "s3_prefix": "case when id % 29 = 0 then repeat('x', 1100) else s3_prefix end"},
        "id % 97 = 1"),
    "article_translation": ("select * from article_translation", {
        "article_id": "case when article_id % 37 = 0 then article_id + 1000000000 else article_id end",
        "lang": "case when article_id % 43 = 0 then null else lang end",
        "summary": "case when article_id % 31 = 0 then repeat('s', 4097) else summary end"}, "article_id % 53 = 1"),
    "user_media": ("select * from user_media", {
        "user_id": "case when user_id % 11 = 0 then user_id + 1000000000 else user_id end",
        "lang": "case when user_id % 7 = 0 then null else lang end", "media_id": "case when user_id % 13 = 0 then null else media_id end"}, "user_id % 17 = 1"),
    "user_article": ("select user_id, event_id as article_id from events where event_type = 'purchase'", {}, "article_id % 10 = 1"),
}


def stand_in(m):
    """The seven tables as DataFrames."""
    t = m.t
    source = {
        "user": m.users(), "media": m.media(), "category": t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "article": m.article(), "article_translation": m.article_translation(), "user_media": m.user_media(),
        "user_article": t.events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("article_id"))}
    out = {}
    for name, (_sql, columns, twice) in STAND_IN.items():
        df = source[name]
        kept = [F.col(c) for c in df.columns if c not in columns]
        df = df.unionByName(df.where(twice)).select(*kept, *[F.expr(x).alias(c) for c, x in columns.items()])
        out[name] = df
    return out


def _tables_sql() -> str:
    """CTEs ``c_<table>`` with all declared columns."""
    parts = []
    for name, (sql, columns, twice) in STAND_IN.items():
        given = {"user": {"id", "lang"}, "media": {"id", "name", "base_url", "rss_url"}, "category": {"id", "name"},
                 "article": {"id", "media_id", "title", "author", "link_url", "s3_prefix", "image_link", "publish_date"},
                 "article_translation": {"article_id", "lang", "title", "summary"}, "user_media": {"user_id", "media_id", "lang"},
                 "user_article": {"user_id", "article_id"}}[name]
        cols = ", ".join(f"{columns.get(f.name) or (f.name if f.name in given else 'null')} as {f.name}" for f in TABLES[name].fields)
        parts.append(f"s_{name} as ({sql}), d_{name} as (select * from s_{name} union all select * from s_{name} where {twice}), "
                     f"c_{name} as (select {cols} from d_{name})")
    return ",\n".join(parts)


def _report_sql() -> str:
    rows = []
    for t, key in PRIMARY_KEYS.items():
        rows.append(f"select '{t}' as table_name, '{constraints.PRIMARY}' as check_name, '{','.join(key)}' as target, count(*) as n_keys, "
                    f"cast(coalesce(sum(n), 0) as bigint) as n_rows from (select count(*) as n from c_{t} group by {', '.join(key)} having count(*) > 1)")
    for t, c, p, pc in FOREIGN_KEYS:
        rows.append(f"select '{t}', '{constraints.FOREIGN}', '{c}', count(distinct {c}), count(*) from c_{t} "
                    f"where {c} is not null and {c} not in (select {pc} from c_{p} where {pc} is not null)")
    for t, s in TABLES.items():
        rows += [f"select '{t}', '{constraints.NOT_NULL}', '{f.name}', cast(null as bigint), count(*) from c_{t} where {f.name} is null"
                 for f in s.fields if not f.nullable]
    for t, caps in LENGTH_CAPS.items():
        rows += [f"select '{t}', '{constraints.LENGTH}', '{c}', cast(null as bigint), count(*) from c_{t} where length({c}) > {n}" for c, n in caps.items()]
    return f"with {_tables_sql()}\n" + "\nunion all ".join(rows)


@query("constraint_report", _report_sql())
def q_constraint_report(m):
    """CON-01, 02, 04, 05: every primary key, foreign key, NOT NULL and length rule
    of the seven tables, each table scanned once."""
    return constraints.report(m.spark, stand_in(m))


def _scan_sql() -> str:
    rows = []
    for t, key in PRIMARY_KEYS.items():
        texts = [f.name for f in TABLES[t].fields if f.dataType.simpleString() == "string"]
        chars = " + ".join(["0", *[f"coalesce(sum(length({c})), 0)" for c in texts]])
        rows.append(f"select '{t}' as table_name, count(*) as n_rows, count(distinct struct_pack({', '.join(f'{k} := {k}' for k in key)})) as n_keys, "
                    f"cast({chars} as bigint) as n_chars from c_{t}")
    return f"with {_tables_sql()}\n" + "\nunion all ".join(rows)


@query("table_scan_all", _scan_sql())
def q_table_scan_all(m):
    """SRC-04: each of the seven tables stored and scanned with its declared schema."""
    root, out = scratch_path(m.spark, "tables"), None
    for name, df in stand_in(m).items():
        sinks.write_table(df, name, f"{root}/{name}")
        stored = sinks.read_table(m.spark, name, f"{root}/{name}")
        texts = [f.name for f in TABLES[name].fields if f.dataType.simpleString() == "string"]
        chars = sum((F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in texts), F.lit(0)).cast("long")
        row = stored.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                         F.count_distinct(F.struct(*PRIMARY_KEYS[name])).alias("n_keys"), chars.alias("n_chars"))
        out = row if out is None else out.unionByName(row)
    return out
