"""Table and message schemas of the news-digest data model."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, TS = T.LongType(), T.StringType(), T.TimestampNTZType()


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


USER = T.StructType([_f("id", L, False), _f("lang", S, False), _f("email", S, False),
                     _f("created_at", TS), _f("updated_at", TS)])

RULE_FIELDS = ("title", "publish_date", "author", "image_url", "content")

MEDIA = T.StructType(
    [_f("id", L, False), _f("name", S, False), _f("base_url", S, False), _f("rss_url", S, False)]
    + [_f(f"xpath_{x}", S, False) for x in RULE_FIELDS]
    + [_f(f"selector_{x}", S, False) for x in RULE_FIELDS]
    + [_f("created_at", TS), _f("updated_at", TS)])

ARTICLE = T.StructType([
    _f("id", L, False), _f("media_id", L, False), _f("category_id", L), _f("title", S, False),
    _f("author", S, False), _f("link_url", S, False), _f("s3_prefix", S, False),
    _f("image_link", S, False), _f("publish_date", TS), _f("created_at", TS), _f("updated_at", TS)])

ARTICLE_TRANSLATION = T.StructType([
    _f("article_id", L, False), _f("lang", S, False), _f("title", S, False), _f("summary", S),
    _f("created_at", TS), _f("updated_at", TS)])

CATEGORY = T.StructType([_f("id", L, False), _f("name", S, False),
                         _f("created_at", TS), _f("updated_at", TS)])

USER_MEDIA = T.StructType([_f("user_id", L, False), _f("media_id", L, False), _f("lang", S, False),
                           _f("created_at", TS), _f("updated_at", TS)])

USER_ARTICLE = T.StructType([_f("user_id", L, False), _f("article_id", L, False),
                             _f("created_at", TS), _f("updated_at", TS)])

TABLES = {
    "user": USER, "media": MEDIA, "article": ARTICLE,
    "article_translation": ARTICLE_TRANSLATION, "category": CATEGORY,
    "user_media": USER_MEDIA, "user_article": USER_ARTICLE,
}

# Primary keys (composite where declared) and foreign keys child -> parent.
PRIMARY_KEYS = {
    "user": ["id"], "media": ["id"], "article": ["id"], "category": ["id"],
    "article_translation": ["article_id", "lang"],
    "user_media": ["user_id", "media_id"],
    "user_article": ["user_id", "article_id"],
}
FOREIGN_KEYS = [
    ("article", "media_id", "media", "id"),
    ("article", "category_id", "category", "id"),
    ("article_translation", "article_id", "article", "id"),
    ("user_media", "user_id", "user", "id"),
    ("user_media", "media_id", "media", "id"),
    ("user_article", "user_id", "user", "id"),
    ("user_article", "article_id", "article", "id"),
]

# Declared string lengths (String(n)); a longer value is a violation.
LENGTH_CAPS = {
    "user": {"lang": 255, "email": 255},
    "media": dict({"name": 255, "base_url": 512, "rss_url": 512},
                  **{f"xpath_{x}": 1024 for x in RULE_FIELDS},
                  **{f"selector_{x}": 1024 for x in RULE_FIELDS}),
    "article": {"title": 512, "author": 255, "link_url": 1024, "s3_prefix": 1024,
                "image_link": 1024},
    "article_translation": {"lang": 255, "title": 1024, "summary": 4096},
    "category": {"name": 255},
    "user_media": {"lang": 255},
}

# Seed CSV: 13 string columns bound by position (header names are not used).
SEED_CSV = T.StructType(
    [_f("name", S), _f("base_url", S), _f("rss_url", S)]
    + [_f(f"xpath_{x}", S) for x in RULE_FIELDS]
    + [_f(f"selector_{x}", S) for x in RULE_FIELDS])

# One feed document: channel -> repeated item.
FEED_ITEM = T.StructType([_f("title", S), _f("link", S), _f("pubDate", S)])
FEED_DOC = T.StructType([_f("channel", T.StructType([_f("item", T.ArrayType(FEED_ITEM))]))])

# Queue message body of one enrichment job.
JOB_MESSAGE = T.StructType([
    _f("media_id", L), _f("article_id", L), _f("title", S), _f("s3_prefix", S),
    _f("job_type", S), _f("image_link", S), _f("target_lang", S)])

CHAT_MESSAGE = T.StructType([_f("role", S), _f("content", S)])
CHAT_REQUEST = T.StructType([_f("model", S), _f("temperature", T.IntegerType()),
                             _f("messages", T.ArrayType(CHAT_MESSAGE))])
