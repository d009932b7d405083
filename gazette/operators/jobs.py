"""Enrichment jobs: fan-out per crawled article and queue message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import JOB_MESSAGE
from .fence import where_computed

# Job types, the order they are sent in, and message defaults.
JOB_ORDER = ("summarize_title", "summarize_article", "translate_article")
IMAGE_JOB = "get_image"
KNOWN_JOB_TYPES = ("summarize_article", "translate_title", "translate_article",
                   "summarize_title", "get_image")
DEFAULT_JOB_TYPE = "summarize_article"
DEFAULT_TARGET_LANG = "zh-CN"
REQUIRED_FIELDS = ("media_id", "article_id", "title", "s3_prefix")
# Message field order as serialized.
MESSAGE_FIELDS = ("media_id", "article_id", "title", "s3_prefix", "job_type",
                  "target_lang", "image_link")


def job_fanout(crawled: DataFrame, target_lang: str = DEFAULT_TARGET_LANG) -> DataFrame:
    """Three jobs per article with content, a fourth when it has an image link.

    One ``explode`` over a per-row array replaces the per-type unions; ``seq``
    keeps the send order.
    """
    base = where_computed(crawled, F.length("content") > 0)
    types = F.array(*[F.lit(t) for t in JOB_ORDER])
    types = F.when(F.col("image_link") != "", F.concat(types, F.array(F.lit(IMAGE_JOB)))).otherwise(types)
    return base.select(
        F.col("id").alias("article_id"), "media_id", "title", "s3_prefix", "image_link",
        F.lit(target_lang).alias("target_lang"),
        F.posexplode(types).alias("seq", "job_type"))


def job_queue_rows(jobs: DataFrame) -> DataFrame:
    """One JSON message body per job (queue or file sink)."""
    return jobs.select("article_id", "seq",
                       F.to_json(F.struct(*[F.col(c) for c in MESSAGE_FIELDS])).alias("body"))


def parse_job_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, rejects) from message bodies.

    Missing fields take the message defaults; a body that is not a JSON object
    with every required field is rejected (and would stay in the queue) without
    stopping the other messages.
    """
    parsed = messages.withColumn("_j", F.from_json("body", JOB_MESSAGE, {"mode": "PERMISSIVE"}))
    ok = F.col("_j").isNotNull()
    for required in REQUIRED_FIELDS:
        ok = ok & F.col(f"_j.{required}").isNotNull()
    keep = [c for c in messages.columns if c != "body"]
    jobs = parsed.where(ok).select(
        *keep,
        F.col("_j.media_id").alias("media_id"), F.col("_j.article_id").alias("article_id"),
        F.col("_j.title").alias("title"), F.col("_j.s3_prefix").alias("s3_prefix"),
        F.coalesce(F.col("_j.job_type"), F.lit(DEFAULT_JOB_TYPE)).alias("job_type"),
        F.coalesce(F.col("_j.image_link"), F.lit("")).alias("image_link"),
        F.coalesce(F.col("_j.target_lang"), F.lit(DEFAULT_TARGET_LANG)).alias("target_lang"))
    rejects = parsed.where(~ok).drop("_j")
    return jobs, rejects
