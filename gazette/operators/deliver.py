"""Completeness gate, translation rows and subscriber fan-out.

An (article, language) is complete once its title, summary and article texts
all exist; the thumbnail is not required.  Complete pairs produce one
translation row and one delivery per subscriber of the article's media.
Deliveries are keyed (user_id, article_id): inserting is idempotent through an
anti-join on that key, so a gate that fires again (after every later job, or in
a second language) adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import DEFAULT_ROWS_PER_SLICE, skew_safe_join

# Subscribers that follow each other for one item, and again for the next ones: few
# enough for a page of a file to hold many repetitions (each item is dealt to every
# such run of its channel; wide items to fewer).
PER_RUN, PER_RUN_WIDE = 512, 2_048

# Artifact names the gate requires.
REQUIRED_KINDS = ("title.txt", "summary.txt", "article.txt")


def completeness_gate(artifact: DataFrame) -> DataFrame:
    """(article_id, lang) pairs holding all three required texts.

    One aggregate with boolean partials: a hot article is combined map-side
    before the shuffle, so no task ever sees all of its artifact rows.
    """
    flags = [F.bool_or(F.col("kind") == k).alias(f"_has{i}") for i, k in enumerate(REQUIRED_KINDS)]
    g = (artifact.where(F.col("kind").isin(*REQUIRED_KINDS))
         .groupBy("article_id", "lang").agg(*flags))
    cond = F.col("_has0") & F.col("_has1") & F.col("_has2")
    return g.where(cond).select("article_id", "lang")


def deliverable(ready: DataFrame, article: DataFrame, all_langs: bool = False,
                by_media: DataFrame | None = None) -> DataFrame:
    """Complete articles and their channel: ``(article_id, to_media, to_lang)``, with
    ``all_langs`` ``(article_id, to_media)``.

    Every subscriber of the channel receives the article.  What depends on the
    article alone (its columns, whether it is deleted) is joined to these rows,
    before ``fan_out`` multiplies them by the subscribers.
    """
    a = article.select(F.col("id").alias("article_id"), F.col("media_id").alias("to_media"))
    if all_langs:
        items = ready.select("article_id").distinct().join(a, "article_id")
    else:
        items = ready.select("article_id", F.col("lang").alias("to_lang")).join(a, "article_id").select(
            "article_id", "to_media", "to_lang")
    if by_media is not None:
        named = by_media.select("article_id", F.col("media_id").alias("to_media"))
        items = items.drop("to_media").join(named, "article_id")
    return items


def channels(items: DataFrame) -> list[str]:
    """The channel columns of deliverable rows."""
    return [c for c in ("to_media", "to_lang") if c in items.columns]


def subscribers(user_media: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """Subscriptions by channel: ``(user_id, to_media[, to_lang])`` and columns ``more``."""
    named = {"to_media": F.col("media_id").alias("to_media"), "to_lang": F.col("lang").alias("to_lang")}
    return user_media.select("user_id", *[named[k] for k in keys], *more)


def fan_out(items: DataFrame, subs: DataFrame, item_id: str = "article_id", few_subscribers: bool = False,
            rows_per_slice: int = DEFAULT_ROWS_PER_SLICE) -> DataFrame:
    """``items`` (with their channel) for each of the channel's ``subscribers``, an item's
    rows together (they are all alike but for the subscriber)."""
    keys = channels(items)
    per_run = PER_RUN if set(items.columns) <= {item_id, *keys} else PER_RUN_WIDE
    if few_subscribers:
        # one user's subscriptions come out of a shuffle: AQE measures them and
        # broadcasts them, so the articles stream through without a hot task
        out = subs.join(items, keys)
    else:
        # the join multiplies: a busy media has many subscribers and articles
        out = skew_safe_join(items, subs, keys, left_ids=[item_id], right_ids=["user_id"],
                             rows_per_slice=rows_per_slice, right_rows=per_run)
    return out.drop(*keys)


def _without_delivered(items: DataFrame, user_media: DataFrame, strict: DataFrame,
                       rows_per_slice: int) -> DataFrame:
    """Fan-out in any language of ``items`` without the deliveries that the
    ``strict`` items (with ``to_lang``) make.

    A user has such a delivery if one of the languages in which the article is
    complete is one in which the user reads its media.  Both sets of languages go
    with the two sides of the fan-out, so no delivery is looked up.  Only articles
    of several media (rows that share an id) are compared delivery by delivery.
    """
    several = (items.select("article_id", "to_media").unionByName(strict.select("article_id", "to_media"))
               .groupBy("article_id").agg(F.min("to_media").alias("_m"), F.max("to_media").alias("_n"))
               .where("_m != _n").select("article_id"))
    subs = subscribers(user_media, ["to_media"])
    read = (user_media.groupBy("user_id", F.col("media_id").alias("to_media")).agg(F.collect_set("lang").alias("_read")))
    done = strict.groupBy("article_id").agg(F.collect_set("to_lang").alias("_done"))
    one = items.join(several, "article_id", "left_anti").join(done, "article_id", "left")
    rows = fan_out(one, subs.join(read, ["user_id", "to_media"], "left"), rows_per_slice=rows_per_slice)
    new = rows.where(~F.coalesce(F.arrays_overlap("_read", "_done"), F.lit(False))).select("user_id", "article_id")
    many = fan_out(items.join(several, "article_id", "left_semi"), subs, rows_per_slice=rows_per_slice)
    had = fan_out(strict.join(several, "article_id", "left_semi"),
                  subscribers(user_media, ["to_media", "to_lang"]), rows_per_slice=rows_per_slice)
    return new.unionByName(many.select("user_id", "article_id").join(
        had.select("user_id", "article_id"), ["user_id", "article_id"], "left_anti"))


def subscription_fanout(ready: DataFrame, article: DataFrame, user_media: DataFrame,
                        existing: DataFrame | None = None, all_langs: bool = False,
                        by_media: DataFrame | None = None,
                        few_subscribers: bool = False,
                        rows_per_slice: int = DEFAULT_ROWS_PER_SLICE,
                        delivered: DataFrame | None = None) -> DataFrame:
    """New (user_id, article_id) deliveries for complete articles.

    Strict (default): a subscriber receives an article once it is complete in
    the subscription's language.  ``all_langs=True`` is the looser form where
    completion in any language delivers to every subscriber of the media; the
    ready pairs are reduced to distinct articles *before* the join, so each
    delivery is produced once and no post-join distinct is needed.

    ``by_media`` optionally replaces the article's own media id (e.g. the
    host-based media of ``host_to_media``).  ``existing`` is the delivery
    table already written; its keys are anti-joined away.  ``delivered`` names
    the pairs ``(article_id, lang)`` of an earlier strict firing over the same
    articles and subscriptions (with ``all_langs``): its deliveries are left out
    without being made.

    ``few_subscribers=True`` (e.g. one user's timeline) skips the hot-key
    split: the small subscription side is broadcast by AQE from its measured
    size, and the articles stream through in parallel whatever media they
    belong to.
    """
    items = deliverable(ready, article, all_langs, by_media)
    if delivered is not None:
        if not all_langs:
            raise ValueError("delivered needs all_langs: a strict firing is told by existing")
        out = _without_delivered(items, user_media, deliverable(delivered, article, by_media=by_media), rows_per_slice)
    else:
        out = fan_out(items, subscribers(user_media, channels(items)), few_subscribers=few_subscribers,
                      rows_per_slice=rows_per_slice)
    out = out.select("user_id", "article_id")
    if existing is not None:
        out = out.join(existing.select("user_id", "article_id"), ["user_id", "article_id"],
                       "left_anti")
    return out


def fanout_counts(items: DataFrame, subs: DataFrame, by: str) -> DataFrame:
    """``(by, n)``: deliveries that ``fan_out`` makes per ``user_id`` or
    ``article_id``, from the rows of the other side counted by channel."""
    keys = channels(items)
    own, other = (subs, items) if by == "user_id" else (items, subs)
    many = other.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return own.select(by, *keys).join(many, keys).groupBy(by).agg(F.sum("_n").alias("n"))


def seed_subscriptions(media: DataFrame, user_id: int, lang: str) -> DataFrame:
    """The seed user subscribes to every media in its language (no join needed)."""
    return media.select(F.lit(user_id).cast("bigint").alias("user_id"),
                        F.col("id").alias("media_id"), F.lit(lang).alias("lang"))


def latest_artifacts(artifact_store: DataFrame) -> DataFrame:
    """Object-store semantics: a put overwrites by key, empty text is never put.

    Keeps the last non-empty body of each (article_id, lang, kind) by ``seq``.
    """
    return (artifact_store.where(F.col("body") != "")
            .groupBy("article_id", "lang", "kind")
            .agg(F.max_by("body", "seq").alias("body")))


def translations_from_artifacts(ready: DataFrame, artifact_store: DataFrame,
                                existing: DataFrame | None = None) -> DataFrame:
    """article_translation rows (article_id, lang, title, summary) for complete pairs.

    Title and summary texts are pivoted out of the latest artifacts with a
    single conditional aggregate; rows whose key already exists are skipped.
    """
    pairs = ready.select("article_id", "lang")
    # only the artifacts of the pairs being written (a stream batch touches few)
    wanted = artifact_store.where(F.col("kind").isin("title.txt", "summary.txt")).join(
        pairs, ["article_id", "lang"], "left_semi")
    latest = latest_artifacts(wanted)
    texts = latest.groupBy("article_id", "lang").agg(
        F.max(F.when(F.col("kind") == "title.txt", F.col("body"))).alias("title"),
        F.max(F.when(F.col("kind") == "summary.txt", F.col("body"))).alias("summary"))
    out = pairs.join(texts, ["article_id", "lang"])
    if existing is not None:
        out = out.join(existing.select("article_id", "lang"), ["article_id", "lang"], "left_anti")
    return out
