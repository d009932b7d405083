"""The pipeline's own tables derived from the driver tables.

``documents`` plays the crawled articles, ``events`` their timestamps,
subscriptions, text artifacts and queue messages, ``customer`` the users,
``labels`` marks which articles were already crawled, ``conversations`` the
model replies.  Every frame is a lazy plan over the parquet scans, so its
work grows with the tables.  The same derivations as SQL text live in
``gazette.plans.oracle`` for the cross-engine check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

# Fixed values of the fixture derivation: language by residue mod 4, kind of
# artifact by event type, status of a model reply by role.
LANG_BY_RESIDUE = ["en", "fr", "de", "es"]
KIND_BY_EVENT = {"click": "title.txt", "view": "summary.txt", "purchase": "article.txt"}
OTHER_KIND = "thumbnail.webp"
JOB_TYPE_BY_EVENT = {"click": "summarize_title", "view": "translate_article",
                     "purchase": "get_image"}
STATUS_BY_ROLE = {"assistant": 200, "user": 429}
OTHER_STATUS = 500


def lang_of(x: Column) -> Column:
    r = x % 4
    out = F.when(r == 0, F.lit(LANG_BY_RESIDUE[0]))
    for i, code in enumerate(LANG_BY_RESIDUE[1:], start=1):
        out = out.when(r == i, F.lit(code))
    return out


def props_number(props: Column) -> Column:
    return F.regexp_extract(props, r"[0-9]+", 0).cast("bigint")


def _media_id(source: Column) -> Column:
    return F.substring(source, 4, 1 << 30).cast("bigint")


class Model:
    """Derived tables of the digest data model over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.t = Tables(spark, sf_dir)

    # -- dimension-like tables -------------------------------------------------
    def media(self) -> DataFrame:
        src = self.t.documents.select("source").distinct()
        return src.select(
            _media_id(F.col("source")).alias("id"),
            F.col("source").alias("name"),
            F.concat("source", F.lit(".example.com")).alias("base_url"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/rss")).alias("rss_url"))

    def users(self) -> DataFrame:
        c = self.t.customer
        return c.select(F.col("c_custkey").alias("id"), lang_of(F.col("c_custkey")).alias("lang"))

    # -- facts -----------------------------------------------------------------
    def article(self) -> DataFrame:
        d = self.t.documents.select("doc_id", "text", "source")
        e = self.t.events.select(F.col("event_id").alias("doc_id"), "ts")
        crawled = self.t.labels.select("doc_id", F.lit(True).alias("crawled"))
        j = d.join(e, "doc_id").join(crawled, "doc_id", "left")
        sid = F.col("doc_id").cast("string")
        img = (F.when(F.col("doc_id") % 4 == 0,
                      F.concat(F.lit("https://img.example.com/"), sid, F.lit(".JPG?w=10")))
               .when(F.col("doc_id") % 4 == 1,
                     F.concat(F.lit("https://img.example.com/"), sid, F.lit(".webp")))
               .when(F.col("doc_id") % 4 == 2, F.lit(""))
               .otherwise(F.concat(F.lit("https://img.example.com/"), sid, F.lit(".png"))))
        return j.select(
            F.col("doc_id").alias("id"),
            _media_id(F.col("source")).alias("media_id"),
            F.substring("text", 1, 60).alias("title"),
            F.lit("").alias("author"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/"), sid).alias("link_url"),
            F.when(F.col("crawled").isNull(), F.lit(""))
             .otherwise(F.concat(F.lit("Articles/"), "source", F.lit("/"), sid)).alias("s3_prefix"),
            img.alias("image_link"),
            F.col("ts").alias("publish_date"))

    def article_translation(self) -> DataFrame:
        d = self.t.documents.select("doc_id", "text", "lang")
        own = d.select(F.col("doc_id").alias("article_id"), "lang",
                       F.substring("text", 1, 60).alias("title"),
                       F.substring("text", 1, 200).alias("summary"))
        en = d.where(F.col("lang") != "en").select(
            F.col("doc_id").alias("article_id"), F.lit("en").alias("lang"),
            F.substring("text", 1, 60).alias("title"),
            F.when(F.col("doc_id") % 5 == 0, F.lit(""))
             .otherwise(F.substring("text", 1, 200)).alias("summary"))
        return own.unionByName(en)

    def user_media(self) -> DataFrame:
        e = self.t.events.where(F.col("event_type") == "signup")
        return e.select(
            "user_id", (props_number(F.col("props")) % 20).alias("media_id"),
            lang_of(F.col("user_id")).alias("lang")).distinct()

    def artifact(self) -> DataFrame:
        e = self.t.events.where(F.col("event_type") != "error")
        kind = F.when(F.col("event_type") == "click", F.lit(KIND_BY_EVENT["click"]))
        for et in ("view", "purchase"):
            kind = kind.when(F.col("event_type") == et, F.lit(KIND_BY_EVENT[et]))
        return e.select("event_id", F.col("user_id").alias("article_id"),
                        lang_of(props_number(F.col("props"))).alias("lang"),
                        kind.otherwise(F.lit(OTHER_KIND)).alias("kind"), "ts")

    def artifact_store(self) -> DataFrame:
        """Artifacts with their text body (seq = event id orders the puts)."""
        a = self.artifact()
        d = self.t.documents.select(F.col("doc_id").alias("article_id"), "text")
        body = (F.when(F.col("kind") == "title.txt", F.substring("text", 1, 60))
                .when(F.col("kind") == "summary.txt", F.substring("text", 1, 200))
                .when(F.col("kind") == "article.txt", F.col("text"))
                .otherwise(F.lit("")))
        return a.join(d, "article_id", "left").select(
            "article_id", "lang", "kind", F.col("event_id").alias("seq"),
            F.coalesce(body, F.lit("")).alias("body"))

    def job_message(self) -> DataFrame:
        e = self.t.events
        k = (props_number(F.col("props")) % 20).cast("string")
        jt = F.when(F.col("event_type") == "click", F.lit(',"job_type":"summarize_title"'))
        jt = jt.when(F.col("event_type") == "view", F.lit(',"job_type":"translate_article"'))
        jt = jt.when(F.col("event_type") == "purchase", F.lit(',"job_type":"get_image"'))
        body = F.concat(
            F.lit('{"media_id":'), k, F.lit(',"article_id":'), F.col("user_id").cast("string"),
            F.lit(',"title":"","s3_prefix":"p/'), F.col("event_id").cast("string"), F.lit('"'),
            jt.otherwise(F.lit("")), F.lit("}"))
        return e.select("event_id", "ts",
                        F.when(F.col("event_type") == "error", F.lit("{")).otherwise(body).alias("body"))

    def completion(self) -> DataFrame:
        c = self.t.conversations
        status = (F.when(F.col("role") == "assistant", F.lit(STATUS_BY_ROLE["assistant"]))
                  .when(F.col("role") == "user", F.lit(STATUS_BY_ROLE["user"]))
                  .otherwise(F.lit(OTHER_STATUS)))
        return c.select("conv_id", "turn", status.alias("status"), "text")

    # -- gate and deliveries as already stored -----------------------------------
    def ready(self) -> DataFrame:
        from ..operators.deliver import completeness_gate
        return completeness_gate(self.artifact())

    def user_article(self, user_id: int | None = None) -> DataFrame:
        """Deliveries; with ``user_id`` only that user's (the subscription side
        is filtered before the fan-out, so nothing else is joined)."""
        from ..operators.deliver import subscription_fanout
        um = self.user_media()
        if user_id is None:
            return subscription_fanout(self.ready(), self.article(), um)
        return subscription_fanout(self.ready(), self.article(),
                                   um.where(F.col("user_id") == user_id), few_subscribers=True)
