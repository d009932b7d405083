"""Deletes that cascade over stored tables, constraint reports and seeding."""

import datetime as dt
import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from data_paths import SF001
from gazette import app
from gazette.__main__ import main
from gazette.operators import constraints
from gazette.schemas import TABLES
from gazette.session import scratch_path
from gazette.sources import deletes, feeds, seed, sinks
from gazette.sources.model import Model


def files(path):
    path = path.replace("file:", "")
    return {f: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_untouched_folders_keep_their_files(spark):
    path = scratch_path(spark, "rows")
    rows = spark.range(1000).select(F.col("id").alias("article_id"), F.lit("x").alias("lang"))
    sinks.append_new(rows, path, ["article_id", "lang"], buckets=16)
    before = files(path)
    victims = {r.article_id for r in sinks.read_bucketed(spark, path).limit(3).collect()}
    gone = spark.createDataFrame([(v,) for v in [*victims, 5_000_000]], "article_id long")
    schema = "article_id long, lang string, _bucket int"
    assert deletes.delete_rows(spark, path, schema, gone, ["article_id"], ["_bucket"]) == 3
    left = {r.article_id for r in sinks.read_bucketed(spark, path).collect()}
    assert left == set(range(1000)) - victims
    after = files(path)
    touched = {r.b for r in spark.createDataFrame([(v,) for v in victims], "v long").select(F.pmod(F.xxhash64("v"), F.lit(16)).alias("b")).collect()}
    same = {f for f, digest in before.items() if after.get(f) == digest}
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in same} == set(range(16)) - touched
    # a folder that loses all of its rows goes; nothing to delete is no write
    folder = spark.read.schema(schema).parquet(path).where(f"_bucket = {min(touched)}").select("article_id")
    n = folder.count()
    assert deletes.delete_rows(spark, path, schema, folder.checkpoint(), ["article_id"], ["_bucket"]) == n
    assert not [f for f in files(path) if f"_bucket={min(touched)}/" in f]
    now = files(path)
    assert deletes.delete_rows(spark, path, schema, gone, ["article_id"], ["_bucket"]) == 0 and files(path) == now


def test_odd_folder_names(spark):
    path = scratch_path(spark, "texts")
    at = dt.datetime(2024, 1, 5, 7)
    rows = spark.createDataFrame([(i, f"t{i}", "body", at, name) for i, name in enumerate(["a b", "50%: x", "ü/y", "plain"] * 2)],
                                 "id long, title string, content string, publish_date timestamp_ntz, media_name string")
    sinks.write_article_texts(rows, spark, path)
    gone = spark.createDataFrame([(0,), (4,), (1,), (5,), (2,)], "id long")
    assert deletes.delete_rows(spark, path, sinks.TEXT_LAYOUT, gone, ["id"], sinks.LAYOUT_PARTS) == 5
    assert {(r.id, r.media) for r in sinks.read_article_texts(spark, path).collect()} == {(3, "plain"), (7, "plain"), (6, "ü/y")}


def test_application_deletes_a_media(spark, monkeypatch):
    m = Model(spark, SF001)
    root = scratch_path(spark, "test-app-delete")
    app.seed(spark, root, seed.media_with_rules(m.media()), m.user_media())
    app.ingest(spark, root, feeds.render_feed_documents(feeds.feed_items_from_articles(m.article(), m.media())))
    link_of = m.article().select(F.col("id").alias("page_id"), F.col("link_url").alias("url"))
    app.crawl(spark, root, m.t.pages.select("page_id", "html").join(link_of, "page_id"), dt.datetime(2024, 2, 1), target_lang="en")
    app.work(spark, root)
    app.deliver(spark, root)
    arts = app.articles(spark, root).checkpoint()
    victim = arts.where("s3_prefix <> ''").groupBy("media_id").count().orderBy(F.desc("count")).first().media_id
    gone = {r.id for r in arts.where(f"media_id = {victim}").collect()}
    ua = {(r.user_id, r.article_id) for r in spark.read.parquet(f"{root}/user_article").collect()}

    # a run that fails after the children is repeated and ends the work
    real, calls = deletes.delete_rows, []

    def failing(spark, path, *rest):
        calls.append(path)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return real(spark, path, *rest)

    monkeypatch.setattr(deletes, "delete_rows", failing)
    with pytest.raises(RuntimeError):
        app.delete_media(spark, root, [victim])
    counts = app.delete_media(spark, root, [victim])
    assert counts["article"] == len(gone) and counts["media"] == 1 and counts["text"] > 0
    assert {(r.user_id, r.article_id) for r in spark.read.parquet(f"{root}/user_article").collect()} == {x for x in ua if x[1] not in gone}
    assert app.articles(spark, root).count() == arts.count() - len(gone)
    for table in ("timeline", "article_translation"):
        assert not gone & {r.article_id for r in spark.read.parquet(f"{root}/{table}").select("article_id").collect()}
    assert not gone & {r.article_id for r in app.stored_texts(spark, root).select("article_id").collect()}
    report = {(r.table_name, r.check_name, r.target): r.n_rows for r in app.check(spark, root).collect()}
    assert report[("article", constraints.FOREIGN, "media_id")] == 0 and report[("user_article", constraints.FOREIGN, "article_id")] == 0
    # users were never stored, so every subscription refers to nobody
    assert report[("user_media", constraints.FOREIGN, "user_id")] == spark.read.parquet(f"{root}/user_media").count()


def test_each_table_is_scanned_once(spark):
    m = Model(spark, SF001)
    root = scratch_path(spark, "scan-once")
    tables = {}
    for name in TABLES:
        path = sinks.write_table(spark.createDataFrame([], TABLES[name]), name, f"{root}/{name}")
        tables[name] = sinks.read_table(spark, name, path)
    tables["article"] = sinks.read_table(spark, "article", sinks.write_table(m.article(), "article", f"{root}/article"))
    df = constraints.report(spark, tables)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(TABLES)
    rows = {(r.table_name, r.check_name, r.target): (r.n_keys, r.n_rows) for r in df.collect()}
    n = m.article().count()
    assert len(rows) == len(constraints.declared())
    assert rows[("article", constraints.PRIMARY, "id")] == (0, 0) and rows[("article", constraints.FOREIGN, "media_id")][1] == n


def test_seed_from_csv(spark, tmp_path):
    columns = [f.name for f in sinks.TABLES["media"].fields][1:14]
    head = ",".join(f'" {c}"' for c in columns)
    lines = ["zeta,z.com,https://z.com/rss" + ",(z)" * 10, "alpha,a.com,https://a.com/rss" + ",(a)" * 9 + ',"(""q"",x)"']
    (tmp_path / "seed.csv").write_text("\n".join([head, *lines]) + "\n")
    root = scratch_path(spark, "test-seed")
    main(["seed", "--root", root, "--csv", str(tmp_path / "seed.csv"), "--email", "me@example.com", "--lang", "fr"], spark=spark)
    media = {r.id: r for r in spark.read.parquet(os.path.join(root, "media")).collect()}
    assert [(i, media[i].name, media[i].selector_content) for i in sorted(media)] == [(1, "zeta", "(z)"), (2, "alpha", '("q",x)')]
    assert media[1].created_at is not None
    assert {tuple(r) for r in spark.read.parquet(os.path.join(root, "user_media")).collect()} == {(1, 1, "fr"), (1, 2, "fr")}
    user = spark.read.parquet(os.path.join(root, "user")).first()
    assert (user.id, user.email, user.lang) == (1, "me@example.com", "fr")
    assert main(["check", "--root", root], spark=spark).isEmpty()
