"""Writers and readers of the pipeline's stored tables.

Every write goes to a folder under the shared checkpoint directory (or a path
the caller gives); partitioned layouts let later reads prune by media and date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import title_key
from ..schemas import TABLES
from ..session import scratch_path

TEXT_LAYOUT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title_key", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("media", T.StringType()),
    T.StructField("Year", T.IntegerType()), T.StructField("Month", T.IntegerType()),
    T.StructField("Day", T.IntegerType()), T.StructField("Hour", T.IntegerType())])
LAYOUT_PARTS = ["media", "Year", "Month", "Day", "Hour"]
# Writer's options for the rows of a fan-out, which repeat one side for every row of
# the other: in large pages with a dictionary each repetition is a few bytes.
REPEATING = {"compression": "zstd", "parquet.page.size": str(8 << 20), "parquet.page.row.count.limit": "1000000",
             "parquet.dictionary.page.size": str(8 << 20)}


def write_article_texts(rows: DataFrame, spark: SparkSession, path: str | None = None,
                        mode: str = "overwrite") -> str:
    """Article texts under media=/Year=/Month=/Day=/Hour= (unpadded numbers).

    Rows are range-partitioned on the folder columns plus the article id
    before writing: each task writes a contiguous run of folders (few files
    per folder), and a folder holding a large share of the rows (one busy
    media and hour) is split over several tasks instead of one.
    """
    path = path or scratch_path(spark, "article_text")
    ts = F.col("publish_date")
    out = rows.select(
        F.col("id"), title_key(F.col("title")).alias("title_key"), F.col("content").alias("body"),
        F.col("media_name").alias("media"), F.year(ts).alias("Year"), F.month(ts).alias("Month"),
        F.dayofmonth(ts).alias("Day"), F.hour(ts).alias("Hour"))
    # no explicit count: AQE may merge small ranges, large inputs keep their split
    out.repartitionByRange(*[F.col(c) for c in LAYOUT_PARTS], F.col("id")).write.mode(mode) \
        .partitionBy(*LAYOUT_PARTS).parquet(path)
    return path


def read_article_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEXT_LAYOUT).parquet(path).select(
        "id", "media", "Year", "Month", "Day", "Hour", "title_key", "body")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select ``df`` in the declared column order/types of ``table``;
    declared columns it lacks become NULL."""
    schema = TABLES[table]
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, table: str, path: str, mode: str = "overwrite") -> str:
    options = REPEATING if table == "user_article" else {}
    conform(df, table).write.mode(mode).options(**options).parquet(path)
    return path


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Scan a stored table with its declared schema (no inference)."""
    return spark.read.schema(TABLES[table]).parquet(path)


def rebuild_tables(spark: SparkSession, root: str, frames: dict[str, DataFrame] | None = None
                   ) -> dict[str, str]:
    """Drop and recreate every table under ``root``: each is overwritten with
    its declared schema, empty unless ``frames`` supplies its rows."""
    frames = frames or {}
    paths = {}
    for name, schema in TABLES.items():
        df = frames.get(name)
        if df is None:
            df = spark.createDataFrame([], schema)
        paths[name] = write_table(df, name, f"{root}/{name}")
    return paths


def merge_by_key(base: DataFrame, updates: DataFrame, key: list[str],
                 columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` replaced by ``updates`` where the key matches
    (an UPDATE ... FROM for plain parquet tables); other rows pass unchanged.

    One shuffle join on the key; the result is written as a new snapshot of
    the table (never over the files it is read from).
    """
    u = updates.select(*key, *[F.col(c).alias(f"_u_{c}") for c in columns],
                       F.lit(True).alias("_u_hit"))
    j = base.join(u, key, "left")
    out = [F.when(F.col("_u_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)
           if c in columns else F.col(c) for c in base.columns]
    return j.select(*out)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


exists = _exists


def has_folders(spark: SparkSession, path: str, column: str) -> bool:
    """Whether the bucketed table at ``path`` has folders by ``column`` inside its buckets."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"_bucket=*/{column}=*")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    if _exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    return read_table_or_empty(spark, path, schema).drop("_bucket")


# Bucket folders per stream target; size so one bucket stays within a few
# hundred MB at the expected table size.
BUCKETS = 64


def append_new(df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS, sort: list | None = None,
               folders: Sequence[str] = ()) -> int:
    """Append rows whose key the target does not hold yet (idempotent append);
    of rows that share a key in the batch the least one is kept, so a repeated
    batch keeps the same.  Returns how many rows were written.

    Targets are partitioned by ``_bucket`` = hash of the key's first column,
    so the anti-join reads only the buckets this batch touches (a partition
    filter on the target's scan) instead of the whole, ever-growing table.
    The list of touched buckets has at most ``buckets`` small integers.  Rows are
    sorted by ``sort`` (default: the key) inside the files.  ``folders`` are columns of
    ``df`` that the table has folders by inside its buckets.
    """
    from pyspark import StorageLevel

    spark = df.sparkSession
    columns = df.columns
    others = [c for c in columns if c not in key]
    if others:
        df = df.groupBy(*key).agg(F.min(F.struct(*others)).alias("_r")).select(
            *[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in columns])
    else:
        df = df.distinct()
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key[0])), F.lit(buckets)).cast("int"))
    if not _exists(spark, path):
        return _write_buckets(df, path, key, sort, folders)
    # the batch is read twice (its buckets, then the write): kept for the
    # duration of the append; lost blocks are rebuilt from lineage
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        touched = [r[0] for r in df.select("_bucket").distinct().collect()]
        if not touched:
            return 0
        existing = (spark.read.schema(df.schema).parquet(path)
                    .where(F.col("_bucket").isin(touched)).select("_bucket", *key))
        return _write_buckets(df.join(existing, ["_bucket", *key], "left_anti"), path, key, sort, folders)
    finally:
        df.unpersist()


def without_existing(df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``df`` whose key the bucketed table at ``path`` does not hold;
    only the buckets ``df`` touches are read."""
    spark = df.sparkSession
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key[0])), F.lit(buckets)).cast("int"))
    if not _exists(spark, path):
        return df
    touched = [r[0] for r in b.select("_bucket").distinct().collect()]
    if not touched:
        return df
    existing = (spark.read.schema(b.schema).parquet(path)
                .where(F.col("_bucket").isin(touched)).select("_bucket", *key))
    return b.join(existing, ["_bucket", *key], "left_anti").drop("_bucket")


def bucket_of(column: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def replace_buckets(df: DataFrame, path: str, touched: list[int]) -> None:
    """Put ``df`` (a stored frame with ``_bucket``) in place of what the folders
    ``touched`` hold; folders that get no row are removed, others stay as they are."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    full = {r[0] for r in df.select("_bucket").distinct().collect()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for b in set(touched) - full:
        p = jvm.org.apache.hadoop.fs.Path(path, f"_bucket={b}")
        p.getFileSystem(conf).delete(p, True)


def in_buckets(spark: SparkSession, values: list[int], buckets: int = BUCKETS) -> Column:
    """Partition filter on the folders that hold rows of these (long) key values,
    as a few literal numbers, so that other folders aren't even listed."""
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    hit = rows.select(F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()
    return F.col("_bucket").isin(sorted(r.b for r in hit))


def _write_buckets(df: DataFrame, path: str, key: list[str], sort: list | None = None, folders: Sequence[str] = ()) -> int:
    # range-partitioned on (bucket, key): a small batch writes about one file per
    # touched bucket, a large one splits its big buckets over several tasks
    written = Observation()
    (df.repartitionByRange("_bucket", *key).sortWithinPartitions("_bucket", *folders, *(sort or key))
     .observe(written, F.count(F.lit(1)).alias("n"))
     .write.mode("append").partitionBy("_bucket", *folders).parquet(path))
    return written.get["n"]


def read_bucketed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stream target without its bucket column."""
    df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    return df.drop("_bucket")
