"""Hot-key demo on the given tables: fan-out with one media owning a third of
all subscriptions and a third of all articles.

python tools/skew_demo.py [sf_dir] [copies] [rows_per_slice]
Subscriptions of sf_dir are replicated ``copies`` times (distinct user ids);
a third of subscriptions and of ready articles are moved to media 0.  The
fan-out is timed as a plain join (AQE skew split off, then on) and as
``skew_safe_join``; outputs are checked equal by count and checksum.
The slice threshold is scaled down with the data (50,000 rows is the default
for cluster-sized inputs).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(sf_dir: str, copies: int, rows_per_slice: int) -> None:
    from pyspark.sql import functions as F

    from gazette.operators.skew import skew_safe_join
    from gazette.session import build_session
    from gazette.sources.model import Model

    spark = build_session("local[8]", shuffle_partitions=64, app_name="skew-demo")
    m = Model(spark, sf_dir)
    hot = lambda c: F.pmod(F.xxhash64(c), F.lit(3)) == 0
    subs = (m.user_media().withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            .select((F.col("user_id") * 1000 + F.col("copy")).alias("user_id"),
                    F.when(hot(F.col("user_id") * 1000 + F.col("copy")), F.lit(0)).otherwise(F.col("media_id")).alias("media_id"),
                    "lang")).checkpoint(eager=True)
    items = (m.ready().join(m.article().select(F.col("id").alias("article_id"), "media_id"), "article_id")
             .select("article_id", "lang",
                     F.when(hot(F.col("article_id")), F.lit(0)).otherwise(F.col("media_id")).alias("media_id"))
             ).checkpoint(eager=True)
    keys = ["media_id", "lang"]

    def run(name, df):
        t = time.perf_counter()
        r = df.agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.pmod(F.xxhash64("user_id", "article_id"), F.lit(1000000007))).alias("h")).first()
        return name, round(time.perf_counter() - t, 2), r.n, r.h

    out = []
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    out.append(run("plain join, AQE skew split off", subs.join(items, keys).select("user_id", "article_id")))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    out.append(run("plain join, AQE skew split on", subs.join(items, keys).select("user_id", "article_id")))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    out.append(run("skew_safe_join (AQE split off)",
                   skew_safe_join(subs, items, keys, ["user_id"], ["article_id"],
                                  rows_per_slice=rows_per_slice).select("user_id", "article_id")))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    hot_share = subs.where("media_id = 0").count() / subs.count()
    print(json.dumps({"subs": subs.count(), "items": items.count(), "hot_share": round(hot_share, 3),
                      "rows_per_slice": rows_per_slice,
                      "runs": [dict(zip(["plan", "sec", "rows", "checksum"], r)) for r in out]}))
    spark.stop()


if __name__ == "__main__":
    a = sys.argv[1:]
    main(a[0] if a else "/root/testdata/sf0.1", int(a[1]) if len(a) > 1 else 10,
         int(a[2]) if len(a) > 2 else 2000)
