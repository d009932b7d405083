"""Deleting rows of stored tables, and what hangs off them.

Only the folders that hold a row to go are rewritten: their other rows are put back
by a dynamic partition overwrite, which replaces just those folders when its job
commits.  Files of all other folders stay as they are.  Children go before their parents, so a delete that fails half way is ended
by repeating it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import sinks


# Files that a task may hold open while it writes rows of several folders.
WRITERS, OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 16
# Values of a folder column up to which they are named in the plan of a scan.
LITERALS = 1000


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_rows(spark: SparkSession, path: str, schema, gone: DataFrame, key: list[str], parts: list[str],
                encoding: dict[str, str] | None = None) -> int:
    """Delete the rows of the table at ``path`` whose ``key`` is in ``gone``;
    returns how many.  ``parts``: the table's folder columns (none: a table of one
    folder, rewritten whole if it is touched); ``encoding``: the writer's options."""
    encoding = encoding or {}
    if not sinks.exists(spark, path):
        return 0
    table = spark.read.schema(schema).parquet(path)
    gone = gone.select(*key).distinct()
    hit = table.select(*key, *parts).join(gone, key, "left_semi")
    if not parts:
        n = hit.count()
        if n:
            staged(table.join(gone, key, "left_anti"), "delete-kept").write.mode("overwrite").parquet(path)
        return n
    touched = staged(hit.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n")), "delete-folders")
    n = touched.agg(F.sum("_n")).first()[0] or 0
    if not n:
        return 0
    inside = _among(table, touched, parts).join(touched.select(*parts), parts, "left_semi")
    # a folder that loses all of its rows isn't part of the overwrite
    rows = inside.groupBy(*parts).agg(F.count(F.lit(1)).alias("_all"))
    empty = staged(touched.join(rows, parts).where("_n = _all").select(*parts), "delete-empty")
    folder = F.regexp_extract(F.input_file_name(), "^(.*)/[^/]+$", 1).alias("_folder")
    gaps = [] if empty.isEmpty() else (_among(table, empty, parts).select(*parts, folder).join(empty, parts, "left_semi")
                                       .select("_folder").distinct().collect())
    # the rows lie as in the table's files, a few folders to a task: they are written
    # as they come, one open file a folder, neither shuffled nor sorted (a task of
    # more folders than that is sorted by them).  The folders are replaced when the
    # job commits, after all of their rows were read
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(OPEN_FILES))
    try:
        (inside.join(gone, key, "left_anti").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .options(**encoding).partitionBy(*parts).parquet(path))
    finally:
        spark.conf.set(WRITERS, before)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in gaps:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r[0].replace(" ", "%20")))
        p.getFileSystem(conf).delete(p, True)
    return n


def _among(table: DataFrame, touched: DataFrame, parts: list[str]) -> DataFrame:
    """``table`` cut down to folders whose columns each have a value of some touched
    folder, by literals, so that most others aren't read."""
    found = touched.select(*[F.collect_set(c).alias(c) for c in parts], *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in parts]).first()
    for c in parts:
        if found[c] and not found[f"_{c}"] and len(found[c]) <= LITERALS:
            table = table.where(F.col(c).isin(sorted(found[c])))
    return table


def delete_media(spark: SparkSession, root: str, media_ids: DataFrame, schemas: dict[str, str]) -> dict[str, int]:
    """Delete media (``id``) from the application's tables under ``root`` with all
    that refers to them: media -> subscriptions and articles -> translations,
    deliveries, timelines, fix-ups and texts.  Returns the rows deleted by table."""
    media_ids = media_ids.select("id").distinct()
    of_media = media_ids.select(F.col("id").alias("media_id"))
    articles = sinks.read_or_empty(spark, os.path.join(root, "article"), schemas["article"])
    ids = staged(articles.join(of_media, "media_id", "left_semi").select("id").distinct(), "delete-articles")
    of_article = ids.select(F.col("id").alias("article_id"))
    bucket = ["_bucket"]
    steps = [
        ("timeline", of_article, ["article_id"], bucket), ("user_article", of_article, ["article_id"], bucket),
        ("article_translation", of_article, ["article_id"], bucket), ("ready", of_article, ["article_id"], bucket),
        ("article_fixup", ids, ["id"], []), ("text", ids, ["id"], sinks.LAYOUT_PARTS),
        ("user_media", of_media, ["media_id"], []), ("article", ids, ["id"], bucket), ("media", media_ids, ["id"], [])]
    out = {}
    for name, gone, key, parts in steps:
        path, schema = os.path.join(root, name), schemas[name]
        if parts == bucket and sinks.exists(spark, path) and sinks.has_folders(spark, path, "_media"):
            parts = [*bucket, "_media"]
        if bucket[0] in parts:
            schema += "".join(f", {c} int" for c in parts)
        delivered = name in ("user_article", "timeline")
        out[name] = delete_rows(spark, path, schema, gone, key, parts, *[sinks.REPEATING] * delivered)
    return out
