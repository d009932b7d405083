"""Feed documents (RSS-style XML) as a DataFrame source.

A feed document is one row ``(feed_url, body)``, parsed with ``from_xml``.  One that
does not parse is cut into its items and each is parsed by itself, so an item that
does not parse goes to the reject frame alone: the rest of its document and the
other documents are unaffected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse_feed_date
from ..operators import checks
from ..operators.fence import where_computed
from ..schemas import FEED_DOC, FEED_ITEM

# Feed date text as the fixture feeds carry it.
FEED_DATE_OUT = "EEE, dd MMM yyyy HH:mm:ss"
XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}
DEFAULT_ITEMS_PER_DOC = 50
ITEM_OR_BAD = T.StructType([*FEED_ITEM.fields, T.StructField("_bad", T.StringType())])
DOC_OR_BAD = T.StructType([*FEED_DOC.fields, T.StructField("_bad", T.StringType())])
BAD_OPTION = {"columnNameOfCorruptRecord": "_bad"}
# Why something of a feed is left out.
NO_ITEMS, NOT_CLOSED, NOT_XML = "no items", "item is not closed", "item does not parse"
NO_LINK_OR_TITLE, UNKNOWN_FEED = "link or title missing", "unknown feed"


def feed_date_text(ts, use_named_zone) -> F.Column:
    """RFC-822 date text; a named zone (GMT) instead of an offset where asked."""
    return F.concat(F.date_format(ts, FEED_DATE_OUT),
                    F.when(use_named_zone, F.lit(" GMT")).otherwise(F.lit(" -0400")))


def render_feed_documents(items: DataFrame, items_per_doc: int = DEFAULT_ITEMS_PER_DOC) -> DataFrame:
    """Render items ``(feed_url, seq, title, link, pubDate)`` into feed documents.

    Items are grouped by feed and by ``seq div items_per_doc``: with a unique
    ``seq`` no document holds more than ``items_per_doc`` items, however many
    items one feed has, so the collect per group is bounded.
    """
    grouped = items.groupBy("feed_url", F.floor(F.col("seq") / items_per_doc).alias("doc_no")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "title", "link", "pubDate"))).alias("its"))
    body = F.to_xml(F.struct(F.struct(
        F.transform("its", lambda s: F.struct(s["title"].alias("title"), s["link"].alias("link"),
                                              s["pubDate"].alias("pubDate"))).alias("item")
    ).alias("channel")), {"rowTag": "rss"})
    return grouped.select("feed_url", "doc_no", body.alias("body"))


def numbered_densely(items: DataFrame) -> DataFrame:
    """``items`` with a dense ``seq`` in the order of feed and old ``seq``: documents
    rendered from them are full but for the ends of a feed, however thinly a feed's
    numbers are spread."""
    start = items.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("_n"))
    ranged = checks.ranged_by(items, ["feed_url", "seq"]).drop("seq")
    return checks.numbered(ranged, start, "seq")


def split_items(docs: DataFrame) -> DataFrame:
    """``(feed_url, position, item, fragment)``: the items of documents that parse
    as a whole; of the others the text from each ``<item`` to the next one.
    Positions count from 0; a document without items is one row of position null."""
    parsed = docs.select("feed_url", "body", F.from_xml("body", DOC_OR_BAD, {**XML_OPTIONS, **BAD_OPTION, "rowTag": "rss"}).alias("_d"))
    sound = F.col("_d._bad").isNull() & (F.size("_d.channel.item") > 0)
    items = F.transform("_d.channel.item", lambda x: F.struct(
        F.struct(x["title"].alias("title"), x["link"].alias("link"), x["pubDate"].alias("pubDate"),
                 F.lit(None).cast("string").alias("_bad")).alias("item"), F.lit(None).cast("string").alias("fragment")))
    parts = F.filter(F.split("body", r"(?=<item[\s>/])"), lambda x: x.rlike(r"^<item[\s>/]"))
    parts = F.transform(parts, lambda x: F.struct(F.lit(None).cast(ITEM_OR_BAD).alias("item"), x.alias("fragment")))
    each = parsed.select("feed_url", "body", F.posexplode_outer(F.when(sound, items).otherwise(parts)).alias("position", "_e"))
    return each.select("feed_url", "position", F.col("_e.item").alias("item"),
                       F.when(F.col("position").isNull(), F.col("body")).otherwise(F.col("_e.fragment")).alias("fragment"))


def parse_feed_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of documents ``(feed_url, body)``.

    A document that doesn't parse as a whole is cut into its items, which are
    parsed one by one: what is wrong with one item costs that item, and the ones
    before and after it are kept, also in a document that breaks off.  Items are
    ``(link, title, pub_date, pub_text, feed_url)``, rejects ``(feed_url, position,
    fragment, reason)``: every item of the input is a row of one of the two.
    """
    whole = F.regexp_extract("fragment", r"(?s)^(.*</item\s*>)", 1)
    rows = split_items(docs).withColumn("_whole", F.when(F.col("item").isNull() & F.col("position").isNotNull(), whole))
    alone = F.when(F.col("_whole") != "", F.from_xml("_whole", ITEM_OR_BAD, {**XML_OPTIONS, **BAD_OPTION, "rowTag": "item"}))
    parsed = rows.withColumn("_i", F.coalesce("item", alone))
    reason = (F.when(F.col("position").isNull(), NO_ITEMS).when(F.col("_whole") == "", NOT_CLOSED)
              .when(F.col("_i").isNull() | F.col("_i._bad").isNotNull(), NOT_XML))
    judged = parsed.withColumn("reason", reason)
    items = where_computed(judged.select("feed_url", "_i", "reason"), F.col("reason").isNull()).select(
        F.col("_i.link").alias("link"), F.col("_i.title").alias("title"), parse_feed_date(F.col("_i.pubDate")).alias("pub_date"),
        F.col("_i.pubDate").alias("pub_text"), "feed_url")
    rejects = where_computed(judged.select("feed_url", "position", "fragment", "reason"), F.col("reason").isNotNull())
    return items, rejects


def reject_rows(broken: DataFrame, bad: DataFrame) -> DataFrame:
    """``(digest, feed_url, reason, content)`` of what an ingest leaves out: rejects
    of ``parse_feed_documents`` and items that no article can be made of."""
    missing = F.col("link").isNull() | F.col("title").isNull()
    rows = broken.select("feed_url", "reason", F.col("fragment").alias("content")).unionByName(bad.select(
        "feed_url", F.when(missing, NO_LINK_OR_TITLE).otherwise(UNKNOWN_FEED).alias("reason"),
        F.to_json(F.struct("link", "title", "pub_date")).alias("content")))
    named = F.to_json(F.struct("feed_url", "reason", "content"))
    return rows.select(F.sha2(named, 256).alias("digest"), "feed_url", "reason", "content")


def feed_items_from_articles(article: DataFrame, media: DataFrame) -> DataFrame:
    """Item rows as the feeds would carry the given articles (test source).

    Every tenth article carries a named-zone date, which does not parse.
    """
    m = media.select(F.col("id").alias("media_id"), F.col("rss_url").alias("feed_url"))
    return article.join(m, "media_id").select(
        "feed_url", F.col("id").alias("seq"), "title", F.col("link_url").alias("link"),
        feed_date_text(F.col("publish_date"), F.col("id") % 10 == 9).alias("pubDate"))


def write_feed_files(docs: DataFrame, path: str) -> DataFrame:
    """Write each feed document as its own XML file under ``path/doc=<n>/``;
    returns the manifest ``(feed_url, doc_dir)`` for reading them back."""
    numbered = docs.withColumn("doc", F.concat_ws("-", F.xxhash64("feed_url").cast("string"),
                                                  F.col("doc_no").cast("string")))
    numbered.select("doc", "body").repartition("doc").write.mode("overwrite") \
        .partitionBy("doc").text(path)
    return numbered.select("feed_url", "doc")


def read_feed_files(spark, path: str, manifest: DataFrame) -> DataFrame:
    """Feed items from XML files with Spark's XML source (``rowTag=item``).

    Every file is parsed in parallel; the feed of an item comes from its
    file's folder, mapped to the feed url by the (per-document, small)
    manifest.  Items come out like ``parse_feed_documents``' items.
    """
    raw = (spark.read.format("xml").option("rowTag", "item").option("ignoreSurroundingSpaces", "false")
           .schema(FEED_ITEM).load(path)
           .select("*", F.regexp_extract(F.col("_metadata.file_path"), r"/doc=([^/]+)/", 1).alias("doc")))
    items = raw.join(manifest, "doc")
    return items.select("link", "title", parse_feed_date(F.col("pubDate")).alias("pub_date"),
                        F.col("pubDate").alias("pub_text"), "feed_url")
