"""Answers of the model, kept by a digest of the request.

A request holds the model's name, its settings and every message, so an equal
digest is the same question.  Answers are written by the job that asks for them,
before anything else uses them: whatever fails later finds them here when it is
repeated, and the model isn't asked again.  Requests that several jobs share are
asked once.  Failed and empty answers aren't kept, so those jobs are tried again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

SCHEMA = "digest string, status int, body string, _bucket int"
# Tasks that ask on behalf of one folder.
SPREAD = 4


def digest(request):
    return F.sha2(request, 256)


class AnswerStore:
    """Table of answers under ``path``, in folders by a hash of the digest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = sinks.BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def read(self) -> DataFrame:
        if sinks.exists(self.spark, self.path):
            return self.spark.read.schema(SCHEMA).parquet(self.path).drop("_bucket")
        return self.spark.createDataFrame([], SCHEMA).drop("_bucket")

    def unanswered(self, reqs: DataFrame) -> DataFrame:
        """One row of ``reqs`` (with ``digest``) for each request without an answer."""
        return reqs.dropDuplicates(["digest"]).join(self.read().select("digest"), "digest", "left_anti")

    def ask(self, reqs: DataFrame, call: Callable[[DataFrame], DataFrame], good) -> None:
        """Have ``call`` answer what of ``reqs`` has no answer yet, and keep the
        answers that pass ``good`` (a column over status and body).  Requests are
        dealt to folders before they are asked, so the asking job itself writes."""
        bucket = F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int")
        todo = self.unanswered(reqs).select("event_id", "digest", "request", bucket.alias("_bucket"))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        todo = todo.repartition(tasks, "_bucket", F.pmod(F.xxhash64("digest", "_bucket"), F.lit(SPREAD)))
        call(todo).where(good).select("digest", "status", "body", "_bucket").write.mode("append") \
            .partitionBy("_bucket").parquet(self.path)

    def answered(self, reqs: DataFrame) -> DataFrame:
        """``reqs`` with status and body, those that have an answer.  A digest that
        two writers answered at the same time counts once."""
        kept = self.read().groupBy("digest").agg(F.min(F.struct("status", "body")).alias("_a"))
        return reqs.join(kept, "digest").withColumns({"status": F.col("_a.status"), "body": F.col("_a.body")}).drop("_a", "digest")
