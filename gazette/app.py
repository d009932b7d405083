"""The digest application's stages over a folder of stored tables.

``root`` holds parquet tables by name; every write appends (idempotently,
keyed) or adds a new file, nothing is rewritten in place:

* ``media``, ``user_media``      seed tables (written by ``seed``)
* ``article``                    ingested articles (ids from blocks, append-only)
* ``feed_rejects``               feed items and documents left out, with the reason
* ``article_fixup``              crawl results; the current article is the
                                 article row overlaid with its latest fix-up
* ``rule_rejects``               extraction rules left out, with the reason
* ``text``                       crawled article texts, media/Year/Month/Day/Hour layout
* ``queue``                      job messages (event_id, ts, body)
* ``answers``                    what the model said, by a digest of the request
* ``artifacts``, ``retry``, ``rejects``, ``acked``   worker results
* ``ready``, ``article_translation``, ``user_article``   gate and delivery
* ``timeline``                   deliveries with their sort key, by user

Stages: ``ingest`` (feeds), ``crawl`` (pages), ``work`` (model jobs, batch or
stream), ``deliver`` (gate, translations, fan-out), and the read side
``timeline`` / ``detail``.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, constraints, crawl as crawl_op, deliver as deliver_op, enrich, ingest as ingest_op
from .operators import jobs as jobs_op, rules as rules_op
from .operators import serve
from .operators.fence import where_computed
from .schemas import TABLES
from .sources import deletes, deliveries, feeds, seed as seed_csv, sinks, timelines
from .sources.answers import AnswerStore
from .sources.ids import IdBlocks, with_reserved_ids
from .streaming import worker

ARTICLE_SCHEMA = ("id long, media_id long, title string, author string, link_url string, "
                  "s3_prefix string, image_link string, publish_date timestamp_ntz, created_at timestamp_ntz")
FIXUP_SCHEMA = ("id long, author string, image_link string, publish_date timestamp_ntz, "
                "s3_prefix string, updated_at timestamp_ntz")
MESSAGE_SCHEMA = "event_id long, ts timestamp_ntz, body string"
ARTIFACT_SCHEMA = "event_id long, article_id long, lang string, kind string, key string, body string"


def _p(root: str, name: str) -> str:
    return os.path.join(root, name)


def seed(spark: SparkSession, root: str, media: DataFrame, user_media: DataFrame,
         users: DataFrame | None = None) -> None:
    """Write the media (with rule columns), subscription and user tables."""
    media.write.mode("overwrite").parquet(_p(root, "media"))
    user_media.select("user_id", "media_id", "lang").write.mode("overwrite").parquet(_p(root, "user_media"))
    if users is not None:
        sinks.write_table(users, "user", _p(root, "user"))


def seed_from_csv(spark: SparkSession, root: str, path: str, email: str, lang: str = jobs_op.DEFAULT_TARGET_LANG,
                  run_ts: _dt.datetime | None = None) -> int:
    """Seed the tables from the CSV of media and rules: ids in the file's order, one
    user who subscribes to every media in their language.  Returns the media."""
    stamp = F.lit(run_ts or _dt.datetime.now()).cast("timestamp_ntz")
    rows = seed_csv.read_seed_csv(spark, path).withColumn("_at", F.monotonically_increasing_id())
    start = spark.range(1).select(F.lit(0).cast("bigint").alias("_n"))
    rows = checks.numbered(checks.ranged_by(rows, ["_at"]), start, "id").drop("_at")
    media = sinks.conform(rows.withColumns({"created_at": stamp, "updated_at": stamp}), "media").checkpoint(eager=True)
    user = spark.range(1).select(F.lit(1).cast("bigint").alias("id"), F.lit(lang).alias("lang"), F.lit(email).alias("email"),
                                 stamp.alias("created_at"), stamp.alias("updated_at"))
    seed(spark, root, media, deliver_op.seed_subscriptions(media, 1, lang), user)
    return media.count()


def check(spark: SparkSession, root: str) -> DataFrame:
    """Every declared constraint of the stored tables with the keys and rows that
    break it; tables that aren't there yet are empty."""
    tables = {}
    for name, schema in TABLES.items():
        path = _p(root, name)
        if name == "article":
            tables[name] = articles(spark, root)
        else:
            tables[name] = sinks.read_or_empty(spark, path, schema)
    return constraints.report(spark, tables)


def delete_media(spark: SparkSession, root: str, ids: list[int]) -> dict[str, int]:
    """Delete media and everything that hangs off them, in all stored tables;
    returns the rows deleted by table."""
    gone = spark.createDataFrame([(i,) for i in ids], "id long")
    schemas = {
        "article": ARTICLE_SCHEMA, "article_fixup": FIXUP_SCHEMA, "text": sinks.TEXT_LAYOUT, "media": media(spark, root).schema,
        "user_media": "user_id long, media_id long, lang string", "user_article": "user_id long, article_id long",
        "article_translation": "article_id long, lang string, title string, summary string", "ready": "article_id long, lang string",
        "timeline": timelines.SCHEMA.removesuffix(", _bucket int")}
    return deletes.delete_media(spark, root, gone, schemas)


def media(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(_p(root, "media"))


def articles(spark: SparkSession, root: str) -> DataFrame:
    """Current articles: each row overlaid with its latest fix-up (merge on read)."""
    base = sinks.read_or_empty(spark, _p(root, "article"), ARTICLE_SCHEMA)
    fix = sinks.read_or_empty(spark, _p(root, "article_fixup"), FIXUP_SCHEMA)
    cols = ["author", "image_link", "publish_date", "s3_prefix", "updated_at"]
    latest = fix.groupBy("id").agg(F.max_by(F.struct(*cols), "updated_at").alias("_f"))
    latest = latest.select("id", *[F.col(f"_f.{c}").alias(c) for c in cols])
    base = base.withColumn("updated_at", F.col("created_at"))
    return sinks.merge_by_key(base, latest, ["id"], cols)


def id_blocks(spark: SparkSession, root: str) -> IdBlocks:
    """The id log of the article table; batch and stream take their ids from it."""
    return IdBlocks(spark, _p(root, "_ids/article"))


def ingest(spark: SparkSession, root: str, feed_docs: DataFrame, run_id: str | None = None,
           run_ts: _dt.datetime | None = None) -> int:
    """Feed documents -> new article rows with ids (appended); returns how many
    were added.  Known links are skipped; what does not parse, lacks a link or
    title or comes from an unknown feed is kept in ``feed_rejects``.  A run that
    is repeated under its ``run_id`` numbers its rows alike."""
    items, broken = feeds.parse_feed_documents(feed_docs)
    current = articles(spark, root)
    rows, bad = ingest_op.insert_new_articles(items, media(spark, root), current)
    highest = current.agg(F.max("id")).first()[0] or 0
    rows = with_reserved_ids(rows, id_blocks(spark, root), f"ingest/{run_id or uuid.uuid4().hex}",
                             ["link_url", "media_id", "title", "publish_date"], above=highest)
    rows = crawl_op.audit_columns(rows, run_ts or _dt.datetime.now(), inserted=True)
    added = sinks.append_new(rows.select(*[c.split()[0] for c in ARTICLE_SCHEMA.split(", ")]), _p(root, "article"), ["link_url", "media_id"])
    sinks.append_new(feeds.reject_rows(broken, bad), _p(root, "feed_rejects"), ["digest"])
    return added


def ingest_stream(spark: SparkSession, root: str, source, trigger: dict | None = None,
                  source_options: dict | None = None) -> None:
    """Feed items ``(link, title, pub_date, feed_url)`` polled as files (or any
    stream of them) -> new article rows, ids from the same log as the batch's."""
    current = articles(spark, root)
    highest = current.agg(F.max("id")).first()[0] or 0
    worker.run_feed_ingest(spark, source, media(spark, root), current, root, _p(root, "_chk_feeds"),
                           source_options=source_options, trigger=trigger, blocks=id_blocks(spark, root), above=highest,
                           key=["link_url", "media_id"], stamped=True)


def site_rules(spark: SparkSession, root: str) -> DataFrame | None:
    """The sites' extraction rules, compiled by host; None if the media table has
    no rule columns (then the default rules hold).  Rules that are left out are
    kept in ``rule_rejects`` with the reason."""
    m = media(spark, root)
    if "xpath_title" not in m.columns:
        return None
    compiled, rejects = rules_op.compile_rules(rules_op.rule_rows(seed_csv.rules_from_media(m)))
    sinks.append_new(rejects, _p(root, "rule_rejects"), ["host", "field", "tier", "pattern"])
    return compiled


def crawl(spark: SparkSession, root: str, fetched: DataFrame, run_ts: _dt.datetime,
          target_lang: str = jobs_op.DEFAULT_TARGET_LANG, media_by_host: bool = False) -> int:
    """Pending articles + fetched pages ``(url, html)`` -> fix-ups, stored
    texts and job messages; returns the number of articles crawled."""
    current = articles(spark, root)
    pending = current.where(F.col("s3_prefix") == "")
    pages = crawl_op.usable_page(fetched, pending.select(F.col("id").alias("article_id"), F.col("link_url").alias("url")))
    m = media(spark, root)
    fixed = crawl_op.crawl_pending(pending.drop("updated_at"), pages, m, run_ts, rules=site_rules(spark, root),
                                   media_by_host=media_by_host)
    done = where_computed(fixed, F.length("content") > 0).checkpoint(eager=True)
    stamp = F.lit(run_ts).cast("timestamp_ntz")
    fix = done.select("id", "author", "image_link", "publish_date", "s3_prefix",
                      stamp.alias("updated_at"))
    # the fix-up marks an article as crawled, so it is written last; a run
    # that failed before it is repeated, and what it had written is left out
    texts = sinks.read_or_empty(spark, _p(root, "text"), sinks.TEXT_LAYOUT)
    sinks.write_article_texts(done.join(texts.select("id"), "id", "left_anti"), spark, _p(root, "text"), mode="append")
    msgs = jobs_op.job_queue_rows(jobs_op.job_fanout(done, target_lang))
    queue = sinks.read_or_empty(spark, _p(root, "queue"), MESSAGE_SCHEMA)
    queued = queue.select(F.get_json_object("body", "$.article_id").cast("long").alias("article_id"),
                          F.get_json_object("body", "$.job_type").alias("job_type")).distinct()
    msgs = (msgs.withColumn("job_type", F.get_json_object("body", "$.job_type"))
            .join(queued, ["article_id", "job_type"], "left_anti").drop("job_type"))
    msgs = checks.surrogate_ids(msgs.withColumn("ts", stamp), queue.select("event_id"),
                                ["article_id", "seq"], id_col="event_id")
    msgs.select("event_id", "ts", "body").write.mode("append").parquet(_p(root, "queue"))
    fix.write.mode("append").parquet(_p(root, "article_fixup"))
    return done.count()


def stored_texts(spark: SparkSession, root: str) -> DataFrame:
    """``(article_id, text)`` with the folder columns of the stored layout."""
    rows = sinks.read_or_empty(spark, _p(root, "text"), sinks.TEXT_LAYOUT)
    return rows.select(F.col("id").alias("article_id"), F.col("body").alias("text"), *sinks.LAYOUT_PARTS)


def work(spark: SparkSession, root: str, model_fn=enrich.echo_model, stream: bool = False,
         use_large: bool = False, trigger: dict | None = None) -> None:
    """Answer queued jobs: artifacts for successes, the retry table for
    failures.  ``stream=True`` runs the Structured Streaming worker over the
    queue folder (checkpointed under ``root``; ``trigger`` as for a stream's
    writer, e.g. ``{"processingTime": "20 seconds"}`` to go on running; default:
    what is there); otherwise one batch job over the messages without an outcome
    yet.  Both keep the model's answers in ``answers`` and ask nothing twice."""
    paths = {"artifacts": _p(root, "artifacts"), "retry": _p(root, "retry"),
             "rejects": _p(root, "rejects")}
    texts = stored_texts(spark, root)
    if stream:
        worker.run_worker(spark, _p(root, "queue"), texts, root, _p(root, "_chk_worker"), model_fn, use_large,
                          trigger=trigger, answers=_p(root, "answers"))
        return
    queue = sinks.read_or_empty(spark, _p(root, "queue"), MESSAGE_SCHEMA)
    acked = sinks.read_or_empty(spark, _p(root, "acked"), "event_id long")
    todo = queue.join(acked.select("event_id"), "event_id", "left_anti").checkpoint(eager=True)
    parsed, rejects = jobs_op.parse_job_messages(todo)
    good, failed = enrich.enrich_batch(parsed, texts, model_fn, use_large, AnswerStore(spark, _p(root, "answers")))
    sinks.append_new(good, paths["artifacts"], ["event_id"])
    sinks.append_new(failed.select("event_id", "article_id", "job_type").join(
        todo.select("event_id", "ts", "body"), "event_id").withColumn("epoch", F.lit(-1).cast("long")),
        paths["retry"], ["event_id", "epoch"])
    odd = enrich.unknown_jobs(parsed).select("event_id").join(todo.select("event_id", "body"), "event_id")
    rejects = rejects.select("event_id", "body").unionByName(odd)
    sinks.append_new(rejects, paths["rejects"], ["event_id"])
    # acknowledged (never taken again): answered text jobs, image jobs (an
    # ineligible link is done with no output) and bodies that do not parse
    images = parsed.where(F.col("job_type") == "get_image").select("event_id")
    done = good.select("event_id").unionByName(images).unionByName(rejects.select("event_id"))
    sinks.append_new(done, _p(root, "acked"), ["event_id"])


def message_media(spark: SparkSession, root: str) -> DataFrame:
    """``(article_id, media_id)``: the media that an article's first job names."""
    queue = sinks.read_or_empty(spark, _p(root, "queue"), MESSAGE_SCHEMA)
    js, _rejects = jobs_op.parse_job_messages(queue)
    return js.groupBy("article_id").agg(F.min_by("media_id", "event_id").alias("media_id"))


def deliver(spark: SparkSession, root: str, all_langs: bool = False, by_message_media: bool = False) -> None:
    """Gate over all artifacts; newly complete pairs get their translation row
    and their deliveries (each appended once per key).  ``by_message_media``
    delivers to the subscribers of the media that the article's jobs name (with
    ``crawl(media_by_host=True)`` the first media of the link's host) instead of
    the media of its feed."""
    arts = sinks.read_or_empty(spark, _p(root, "artifacts"), ARTIFACT_SCHEMA)
    ready = deliver_op.completeness_gate(arts)
    fresh = sinks.without_existing(ready, _p(root, "ready"), ["article_id", "lang"]).checkpoint(eager=True)
    store = arts.select("article_id", "lang", "kind", F.col("event_id").alias("seq"), "body")
    tr = deliver_op.translations_from_artifacts(fresh, store)
    sinks.append_new(tr, _p(root, "article_translation"), ["article_id", "lang"])
    um = spark.read.parquet(_p(root, "user_media"))
    # keys already delivered are dropped by the appends
    items = deliver_op.deliverable(fresh, articles(spark, root), all_langs,
                                   message_media(spark, root) if by_message_media else None).checkpoint(eager=True)
    deliveries.append(items, um, _p(root, "user_article"), by_media=True)
    timelines.append_fanout(timelines.rows_of(items, articles(spark, root)), um, _p(root, "timeline"))
    # last: a run that failed before is repeated whole, and adds what is missing
    sinks.append_new(fresh, _p(root, "ready"), ["article_id", "lang"])


def translations(spark: SparkSession, root: str) -> DataFrame:
    return sinks.read_or_empty(spark, _p(root, "article_translation"),
                               "article_id long, lang string, title string, summary string")


def timeline(spark: SparkSession, root: str, user_id: int, page: int = 0,
             lang: str | None = "en") -> DataFrame:
    """One page of a user's timeline by its number (``lang=None``: every
    translation).  ``timeline_after`` reads on from a page without the ones before."""
    cursor = None
    for _ in range(page):
        _cards, cursor = timeline_after(spark, root, user_id, cursor, lang)
        if cursor is None:
            return _cards.limit(0)
    return timeline_after(spark, root, user_id, cursor, lang)[0]


def timeline_after(spark: SparkSession, root: str, user_id: int, cursor: timelines.Cursor | None = None,
                   lang: str | None = "en", page_size: int = serve.PAGE_LIMIT) -> tuple[DataFrame, timelines.Cursor | None]:
    """(cards, next cursor): the page behind ``cursor`` (None: the first page; a
    next cursor of None: there is no further page)."""
    if not sinks.exists(spark, _p(root, "timeline")):
        empty = spark.createDataFrame([], "id long, t_title string, publish_date timestamp_ntz, summary string, s3_prefix string, media_name string")
        return serve.card_shape(empty), None
    return timelines.page(spark, _p(root, "timeline"), _p(root, "article_translation"), media(spark, root), user_id,
                          cursor, lang, page_size)


def detail(spark: SparkSession, root: str, article_id: int, lang: str) -> DataFrame:
    """Article detail with the translated text; empty summary -> summary.txt."""
    arts = sinks.read_or_empty(spark, _p(root, "artifacts"), ARTIFACT_SCHEMA)
    latest = deliver_op.latest_artifacts(
        arts.select("article_id", "lang", "kind", F.col("event_id").alias("seq"), "body"))
    return serve.article_detail(articles(spark, root), media(spark, root), translations(spark, root),
                                article_id, lang, artifacts=latest)
