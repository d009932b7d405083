"""What hangs on deliveries, from the two sides of the fan-out: the same rows as
from the deliveries themselves, which are never shuffled."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from data_paths import SF001
from gazette.operators import checks, deliver, serve


def model(spark, seed, clean=False):
    """ready, article, user_media with ids held twice, articles of several media,
    users who read a media in several languages, and nulls."""
    rng = random.Random(seed)
    langs = ["en", "fr", "de"]
    ready = {(a, rng.choice(langs)) for a in range(30) for _ in range(2)}
    article = [(a, a % 4, f"t{a}") for a in range(28)]
    um = {(u, rng.randrange(4), langs[u % 3]) for u in range(25) for _ in range(3)}
    article, um = list(article), list(um)
    if not clean:
        article += [(a, (a + 1) % 4, f"other{a}") for a in range(0, 28, 5)] + [(3, 3, "t3"), (None, 1, "none"), (9, None, "none")]
        um += [(u, m, rng.choice(langs)) for u, m, _ in um[::4]] + [(None, 1, "en"), (7, None, "en"), (8, 1, None), um[0]]
    return (spark.createDataFrame(sorted(ready), "article_id long, lang string"),
            spark.createDataFrame(article, "id long, media_id long, title string"),
            spark.createDataFrame(um, "user_id long, media_id long, lang string"))


def plain(ready, article, um, all_langs=False):
    """Deliveries in plain Python, from collected rows."""
    pairs = {(a, None) for a, _ in ready} if all_langs else ready
    return [(u, a) for a, lang in pairs for i, m, _ in article if i == a and m is not None
            for u, n, to in um if n == m and (all_langs or to == lang)]


def same(got, want):
    return Counter(map(tuple, got.collect())) == Counter(want)


@pytest.mark.parametrize("clean", [True, False])
def test_same_as_from_deliveries(spark, clean):
    frames = [x.coalesce(1).localCheckpoint() for x in model(spark, 1, clean)]
    ready, article, um = frames
    rows = [[tuple(r) for r in x.collect()] for x in frames]
    ua = plain(*rows)
    items = deliver.deliverable(ready, article).localCheckpoint()
    subs = deliver.subscribers(um, deliver.channels(items)).localCheckpoint()
    got = deliver.fan_out(serve.article_deliveries(article, items), subs, "id").select("user_id", "id", "media_id", "title")
    assert len(ua) > 50 and same(got, [(u, a, m, t) for u, a in ua for i, m, t in rows[1] if i == a])
    held = [n for n in Counter(ua).values() if n > 1]
    assert same(checks.pk_violations_of_fanout(items, subs, "user_article"), [("user_article", len(held), sum(held))])
    assert clean == (not held)
    n = deliver.fanout_counts(items, subs, "user_id")
    assert same(n, Counter(u for u, _ in ua).items())
    orphans = checks.fk_orphans(n, "user_id", spark.range(0, 20, 2), "id", "by", "n")
    assert same(orphans, [("by", sum(u is not None and (u >= 20 or u % 2 == 1) for u, _ in ua))])
    second = plain(*rows, all_langs=True)
    few = ready.where("article_id % 3 = 0")
    had = {k for k in plain([r for r in rows[0] if r[0] % 3 == 0], *rows[1:]) if None not in k}
    want = [k for k in second if k not in had]
    assert 20 < len(want) < len(second)
    assert same(deliver.subscription_fanout(ready, article, um, delivered=few, all_langs=True), want)
    # a delete that cascades over the items
    media = spark.range(4).select("id")
    left = checks.cascade_prune(media, article, ready, items, media.where("id = 2"))["user_article"]
    kept = {i for i, m, _ in rows[1] if m != 2 and m is not None}
    assert same(deliver.fan_out(left, subs).select("user_id", "article_id"), [k for k in ua if k[1] in kept])


@pytest.mark.parametrize("name", ["article_deliveries", "cascade_prune", "pk_violations", "fk_orphans", "deliveries_idempotent"])
def test_deliveries_are_not_shuffled(spark, registry, name):
    q, _ = registry
    plan = q[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    # no exchange or join on the key of a delivery (but for ids held twice)
    held = [x for x in plan.split("\n") if "hashpartitioning(user_id" in x and "article_id" in x.split("hashpartitioning(")[1]]
    assert len(held) <= (2 if name == "deliveries_idempotent" else 0), held
    if name in ("article_deliveries", "cascade_prune"):
        joins = [x for x in plan.split("\n") if "Join" in x]
        assert "to_media" in joins[0], joins                   # the fan-out comes last


def test_key_that_makes_many_rows_is_dealt_out(spark, monkeypatch):
    from gazette.operators import skew

    monkeypatch.setattr(skew, "ROWS_MADE", 1000)
    left = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("l"))
    right = spark.range(400).select((F.col("id") % 2).alias("k"), F.col("id").alias("r"))
    out = skew.skew_safe_join(left, right, ["k"], ["l"], ["r"])
    assert same(out, [(k, a, b) for k in range(2) for a in range(k, 300, 2) for b in range(k, 400, 2)])
    made = out.groupBy("k", F.pmod(F.xxhash64("r"), F.lit(skew.MADE_SLICES)), F.spark_partition_id()).count()
    assert made.agg(F.max("count")).first()[0] <= 300 * 400 // 2 // 4


def test_large_append_gives_each_delivery_once(spark):
    from gazette.session import scratch_path
    from gazette.sources import deliveries, sinks, timelines

    frames = [x.coalesce(1).localCheckpoint() for x in model(spark, 1)]
    rows = [[tuple(r) for r in x.collect()] for x in frames]
    ready, article, um = frames
    first = ready.where("article_id % 3 = 0")
    path, dated = scratch_path(spark, "t"), scratch_path(spark, "tl")
    art = article.select("id", F.lit(None).cast("timestamp_ntz").alias("publish_date"), "media_id", F.col("title").alias("s3_prefix"))
    um = um.where("user_id is not null")                   # a null key is never held
    rows[2] = [r for r in rows[2] if r[0] is not None]
    kept = [deliveries.append(deliver.deliverable(some, article), um, path, buckets=4, compared=0) for some in (first, ready, ready)]
    got = [tuple(r) for r in sinks.read_bucketed(spark, path).select("user_id", "article_id").collect()]
    assert Counter(got) == Counter(set(plain(*rows))) and sum(kept) == len(got) > 50 and kept[2] == 0
    folder = spark.read.parquet(path).where(F.col("_bucket") != sinks.bucket_of(F.col("user_id"), 4))
    assert folder.isEmpty()
    few = timelines.rows_of(deliver.deliverable(first, article), art)
    assert timelines.append_fanout(few, um, dated, 4, 0) == len({k for k in plain([r for r in rows[0] if r[0] % 3 == 0], *rows[1:])})
    least = {i: min((m is not None, m or 0, t) for j, m, t in rows[1] if j == i) for i, *_ in rows[1] if i is not None}
    for r in spark.read.parquet(dated).collect():
        assert (r.media_id is not None, r.media_id or 0, r.s3_prefix) == least[r.article_id]


def size(path):
    import glob
    import os

    return sum(os.path.getsize(f) for f in glob.glob(path.replace("file:", "") + "/**/*.parquet", recursive=True))


def test_media_leaves_the_folders_of_others_alone(spark):
    """Deliveries of a large and of a small append lie by media too, so that deleting a
    media rewrites its folders only; a table without such folders goes on without."""
    from gazette.session import scratch_path
    from gazette.sources import deletes, deliveries, sinks

    media = spark.range(12).select(F.col("id").alias("media_id"))
    um = spark.range(40).crossJoin(media).select(F.col("id").alias("user_id"), "media_id", F.lit("en").alias("lang"))
    article = spark.range(240).select("id", (F.col("id") % 12).alias("media_id"))
    ready = article.select(F.col("id").alias("article_id"), F.lit("en").alias("lang"))
    path, old = scratch_path(spark, "by-media"), scratch_path(spark, "by-user")
    first, second = (deliver.deliverable(ready.where(x), article) for x in ("article_id < 180", "article_id >= 180"))
    for at, large in ((path, True), (old, False)):
        assert deliveries.append(first, um, at, buckets=2, compared=0, by_media=large) == 180 * 40
        assert deliveries.append(second, um, at, buckets=2, by_media=True) == 60 * 40
        assert deliveries.append(first, um, at, buckets=2, by_media=True) == 0
    assert sinks.has_folders(spark, path, "_media") and not sinks.has_folders(spark, old, "_media")
    schema = "user_id long, article_id long, _bucket int"
    gone = article.where("media_id = 3").select(F.col("id").alias("article_id"))
    lying = lambda: {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    own = sinks.bucket_of(F.lit(3).cast("long"), deliveries.MEDIA_FOLDERS)
    k = spark.range(1).select(own.alias("k")).first().k
    before = lying()
    for at, more in ((path, ["_media"]), (old, [])):
        table = schema + "".join(f", {c} int" for c in more)
        assert deletes.delete_rows(spark, at, table, gone, ["article_id"], ["_bucket", *more]) == 20 * 40
        left = {tuple(r) for r in spark.read.parquet(at).select("user_id", "article_id").collect()}
        assert left == {(u, a) for u in range(40) for a in range(240) if a % 12 != 3}
    others = {f for f in before if f"_media={k}/" not in f}
    assert others and others <= lying() and not (before - others) & lying()


@pytest.mark.parametrize("ordered", [False, True])
def test_stored_fanout_is_small(spark, ordered):
    """A large append takes far less than a byte a row, whatever it holds of an
    article, and lies by user (or by article) in the files without a sort of its rows."""
    from gazette.session import scratch_path
    from gazette.sources import deliveries

    um = spark.range(1500).select((F.col("id") * 7919).alias("user_id"), F.lit(1).cast("long").alias("media_id"), F.lit("en").alias("lang"))
    items = spark.range(800).select((F.col("id") * 104729).alias("article_id"), F.lit(1).cast("long").alias("to_media"), F.lit("en").alias("to_lang"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("s3_prefix"))
    path = scratch_path(spark, "small")
    order = [F.col("article_id").desc()] if ordered else None
    assert deliveries.append(items, um, path, order, buckets=4, compared=0) == 1500 * 800
    assert size(path) < 1500 * 800 / 2
    for name in {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}:
        rows = [tuple(r) for r in spark.read.parquet(name).select("user_id", "article_id").collect()]
        keys = [(u, -a) for u, a in rows] if ordered else [(a, u) for u, a in rows]
        assert keys == sorted(keys)


def test_written_fanout_is_small(spark):
    """A channel of many items and subscribers: rows come by item, with few subscribers
    at a time, so that files repeat them at a small part of a byte a row."""
    from gazette.session import scratch_path
    from gazette.sources import sinks

    m, lang = F.lit(1).cast("long").alias("to_media"), F.lit("en").alias("to_lang")
    items = spark.range(3001).select((F.col("id") * 17 + 3).alias("article_id"), m, lang)
    subs = spark.range(701).select((F.col("id") * 53 + 1).alias("user_id"), m, lang)
    rows, n = deliver.fan_out(items, subs).select("user_id", "article_id"), 3001 * 701
    plain, table = scratch_path(spark, "plain"), scratch_path(spark, "user_article")
    rows.write.parquet(plain)
    stored = spark.read.parquet(plain)
    assert stored.count() == n == stored.distinct().count() and size(plain) < 0.7 * n
    sinks.write_table(rows, "user_article", table)
    assert sinks.read_table(spark, "user_article", table).count() == n and size(table) < 0.1 * n
