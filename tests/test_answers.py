"""Answers kept across failures and replays; texts read by folder."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from data_paths import SF001
from gazette import app
from gazette.__main__ import main
from gazette.operators import crawl, enrich, jobs
from gazette.session import scratch_path
from gazette.sources import feeds, seed, sinks
from gazette.sources.answers import AnswerStore
from gazette.sources.model import Model
from gazette.streaming import worker


def counting(folder, fail=()):
    """A model that notes every request it is asked (a file each)."""
    def model(batch):
        import hashlib
        import uuid

        for r in batch["request"]:
            with open(os.path.join(folder, hashlib.sha256(r.encode()).hexdigest() + "-" + uuid.uuid4().hex), "w"):
                pass
        out = enrich.echo_model(batch)
        bad = [any(f in r for f in fail) for r in batch["request"]]
        out["status"] = [500 if b else 200 for b in bad]
        return out

    return model


def asked(folder):
    names = [f.split("-")[0] for f in os.listdir(folder)]
    return len(names), len(set(names))


def jobs_and_texts(spark, n=12):
    rows = [(i, i % 4, 0, "t", "p", k, "", "en") for i, k in enumerate(["summarize_title", "translate_article"] * n)]
    js = spark.createDataFrame(rows, "event_id long, article_id long, media_id long, title string, s3_prefix string, job_type string, "
                               "image_link string, target_lang string")
    return js, spark.createDataFrame([(a, f"text {a}") for a in range(3)], "article_id long, text string")


def test_equal_requests_are_asked_once(spark, tmp_path):
    js, texts = jobs_and_texts(spark)
    store = AnswerStore(spark, scratch_path(spark, "answers"))
    good, failed = enrich.enrich_batch(js, texts, counting(str(tmp_path)), answers=store)
    plain, plain_failed = enrich.enrich_batch(js, texts)
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, plain.collect()))
    assert {r.event_id for r in failed.collect()} == {r.event_id for r in plain_failed.collect()} != set()
    n, distinct = asked(tmp_path)
    assert n == distinct == len({(r.article_id, r.job_type) for r in js.collect() if r.article_id < 3})


def test_failed_answers_are_asked_again(spark, tmp_path):
    js, texts = jobs_and_texts(spark)
    store = AnswerStore(spark, scratch_path(spark, "answers"))
    _good, failed = enrich.enrich_batch(js, texts, counting(str(tmp_path), fail=["text 1"]), answers=store)
    before = asked(tmp_path)[0]
    still = {r.event_id for r in failed.collect()}
    good, failed = enrich.enrich_batch(js, texts, counting(str(tmp_path)), answers=store)
    again = {r.event_id for r in failed.collect()}
    per_text = len({r.job_type for r in js.where("article_id = 1").collect()})
    assert asked(tmp_path)[0] == before + per_text
    assert again < still and {r.article_id for r in js.collect() if r.event_id in again} == {3}
    assert good.count() == js.where("article_id < 3").count()


def queued(spark, name):
    m = Model(spark, SF001)
    root = scratch_path(spark, name)
    app.seed(spark, root, seed.media_with_rules(m.media()), m.user_media())
    app.ingest(spark, root, feeds.render_feed_documents(feeds.feed_items_from_articles(m.article(), m.media())))
    link_of = m.article().select(F.col("id").alias("page_id"), F.col("link_url").alias("url"))
    n = app.crawl(spark, root, m.t.pages.select("page_id", "html").join(link_of, "page_id"), dt.datetime(2024, 2, 1), target_lang="en")
    return root, n


@pytest.mark.parametrize("stream", [False, True])
def test_a_failure_after_the_call_asks_nothing_twice(spark, tmp_path, monkeypatch, stream):
    root, n = queued(spark, "test-app-answers")
    module = worker if stream else sinks
    real, failed = module.append_new, []

    def failing(df, path, key, **kw):
        if path.endswith("/artifacts") and not failed:
            failed.append(path)
            raise RuntimeError("lost")
        return real(df, path, key, **kw)

    monkeypatch.setattr(module, "append_new", failing)
    with pytest.raises(Exception, match="lost"):
        app.work(spark, root, counting(str(tmp_path)), stream=stream)
    calls, distinct = asked(tmp_path)
    assert calls == distinct > 0
    app.work(spark, root, counting(str(tmp_path)), stream=stream)
    assert asked(tmp_path) == (calls, distinct)
    assert spark.read.parquet(f"{root}/artifacts").count() == 3 * n


def test_texts_are_found_by_folder(spark):
    root, n = queued(spark, "test-app-folders")
    queue = spark.read.parquet(f"{root}/queue")
    js, _ = jobs.parse_job_messages(queue)
    text_jobs = enrich.job_dispatch(js)[0].where(F.col("job_type").isin(*enrich.TEXT_JOBS))
    some = text_jobs.where("article_id % 50 = 7").checkpoint(eager=True).where(F.col("job_type") == "summarize_title")
    found = enrich.texts_of_jobs(some, app.stored_texts(spark, root))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    whole = enrich.texts_of_jobs(some, app.stored_texts(spark, root).select("article_id", "text"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) != []


def test_folder_of_a_prefix(spark):
    rows = [("Articles/media=a/b c/Year=2024/Month=1/Day=5/Hour=0/T_x",), ("p/1",), (None,), ("media=/Year=1/Month=2/Day=3/Hour=4/x",)]
    cols = enrich.text_folder(F.col("p"))
    got = spark.createDataFrame(rows, "p string").select(*[c.alias(n) for n, c in cols.items()]).collect()
    assert tuple(got[0]) == ("a/b c", 2024, 1, 5, 0) and tuple(got[1]) == tuple(got[2]) == (None,) * 5
    assert tuple(got[3]) == (None, 1, 2, 3, 4)


SHOUTING = """
from gazette.operators.enrich import echo_model


def answer(batch):
    out = echo_model(batch)
    out["body"] = out["body"].str.replace("Write", "WRITE")
    return out
"""


def test_model_from_the_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "shouting_model.py").write_text(SHOUTING)
    monkeypatch.syspath_prepend(str(tmp_path))
    root, n = queued(spark, "test-app-cli")
    main(["work", "--root", root, "--model", "shouting_model:answer", "--large"], spark=spark)
    arts = spark.read.parquet(f"{root}/artifacts")
    assert arts.count() == 3 * n and arts.where("kind = 'title.txt' and body like 'WRITE%'").count() == n
    answers = spark.read.parquet(f"{root}/answers")
    assert 0 < answers.count() <= 3 * n
