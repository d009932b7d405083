"""Appending a fan-out to a stored table, once per user and article.

Deliveries are far more than what they come from, so a large append never shuffles
or sorts them: subscribers and items meet in the folder (a hash of the user) that the
rows go to, the two sides are sorted, and each task writes what it makes as it comes.
What a key can come from twice is told from the two sides: users who read a media in
several languages, articles whose id or media is not unique, and articles that the
table holds deliveries of already.  Only those are compared row by row
(``sinks.append_new``).
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import deliver
from . import sinks

KEY = ["user_id", "article_id"]
# Deliveries up to which an append is compared row by row as a whole.
COMPARED = 5_000_000
# Folders by media (a hash) inside each folder of users, of a table that whole media
# are deleted from.
MEDIA_FOLDERS = 8
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def made(items: DataFrame, subs: DataFrame) -> int:
    """How many rows the fan-out makes."""
    keys = deliver.channels(items)
    a, b = (x.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for x, n in ((items, "_i"), (subs, "_s")))
    return int(a.join(b, keys).agg(F.sum(F.col("_i").cast("double") * F.col("_s"))).first()[0] or 0)


def append(items: DataFrame, user_media: DataFrame, path: str, order: list[Column] | None = None,
           buckets: int = sinks.BUCKETS, compared: int = COMPARED, by_media: bool = False) -> int:
    """Append ``items`` (deliverable rows; more columns are kept) for each of their
    subscribers; returns how many rows were written.  With ``order`` (of item columns)
    a user's rows are together in the files, in that order, otherwise an article's.
    ``by_media`` gives a new table folders by media, so that a deleted media touches
    few; a table that has none yet goes on without them."""
    spark = items.sparkSession
    keys = deliver.channels(items)
    columns = [*KEY, *[c for c in items.columns if c not in (*KEY, *keys)]]
    by_media = by_media and (not sinks.exists(spark, path) or sinks.has_folders(spark, path, "_media"))
    folders = ["_media"] if by_media else []
    items = items.checkpoint(eager=True)
    subs = deliver.subscribers(user_media, keys)

    def whole(i: DataFrame, s: DataFrame) -> int:
        if by_media:
            i = i.withColumn("_media", sinks.bucket_of(F.col("to_media"), MEDIA_FOLDERS))
        return sinks.append_new(deliver.fan_out(i, s).select(*columns, *folders), path, KEY, buckets,
                                order and [F.col("user_id"), *order], folders)

    total = made(items, subs)
    if total <= compared:
        return whole(items, subs)
    subs = subs.distinct().checkpoint(eager=True)
    # users and articles that may meet twice
    readers = subs.groupBy("user_id", "to_media").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = subs.join(readers.select(F.col("user_id").alias("_u"), F.col("to_media").alias("_m")),
                      F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("to_media") == F.col("_m")), "left_semi")
    once = subs.join(readers.select(F.col("user_id").alias("_u"), F.col("to_media").alias("_m")),
                     F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("to_media") == F.col("_m")), "left_anti")
    odd = (items.groupBy("article_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(*keys).alias("_c"),
                                           F.min("to_media").alias("_a"), F.max("to_media").alias("_b"))
           .where("_n != _c or _a != _b").select("article_id"))
    if sinks.exists(spark, path):
        held = spark.read.schema("article_id long").parquet(path).select("article_id")
        odd = odd.unionByName(held.join(items.select("article_id").distinct(), "article_id", "left_semi")).distinct()
    odd = odd.checkpoint(eager=True)
    plain = items.join(odd, "article_id", "left_anti").checkpoint(eager=True)
    n = 0
    if not odd.isEmpty():
        n += whole(items.join(odd, "article_id", "left_semi"), subs)
    if not again.isEmpty():
        n += whole(plain, again)
    return n + _placed(plain, once, keys, [*columns, "_bucket", *folders], path, order, buckets, by_media)


def _placed(items: DataFrame, subs: DataFrame, keys: list[str], columns: list[str], path: str,
            order: list[Column] | None, buckets: int, by_media: bool) -> int:
    """Write a fan-out whose keys are unique and new, from the tasks that make it."""
    spark = items.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a task holds whole folders, or parts of them by media, so it writes few files
    groups = MEDIA_FOLDERS if by_media else max(1, -(-2 * tasks // buckets))
    place = ["_bucket", "_media"]

    def side(df: DataFrame, *by: Column) -> DataFrame:
        df = df.withColumn("_media", sinks.bucket_of(F.col("to_media"), groups))
        return _in_order(df.repartition(tasks, *place), *place, *keys, *by)

    # a merge join gives its rows in the order of its left side, then of its right
    # side: by folder, as the writer wants them
    readers = side(subs.withColumn("_bucket", sinks.bucket_of(F.col("user_id"), buckets)), F.col("user_id"))
    read = side(items.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))),
                *(order or [F.col("article_id")]))
    outer, inner = (readers, read) if order else (read, readers)
    rows = outer.hint("merge").join(inner, [*place, *keys]).select(*columns)
    written = Observation()
    with _placed_by(spark):
        (rows.observe(written, F.count(F.lit(1)).alias("n"))
         .write.mode("append").options(**sinks.REPEATING).partitionBy(*[c for c in place if c in columns]).parquet(path))
    return written.get["n"]


def _in_order(df: DataFrame, *by) -> DataFrame:
    """``df`` sorted inside its partitions.  A sort below a join is dropped as of no
    use unless a column hangs on it; the test of that column is true for every row."""
    return df.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).where("_at >= 0").drop("_at")


@contextmanager
def _placed_by(spark: SparkSession):
    """Let joins take sides as they lie if they are dealt by some of the join's keys."""
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)
