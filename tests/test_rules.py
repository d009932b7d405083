"""Per-site rules: compilation, rejects, and the crawl that uses them."""

import datetime as dt

from pyspark.sql import functions as F

from data_paths import SF001
from gazette import app
from gazette.operators import crawl, extract, rules
from gazette.session import scratch_path
from gazette.sources import feeds, seed
from gazette.sources.model import Model

SCHEMA = "host string, field string, tier int, pattern string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_reject_reasons(spark):
    rows = [("a.com", "title", 1, "<h1>(.*?)</h1>"), ("A.com ", "title", 1, "<h1>(.*?)</h1>"), ("a.com", "title", 1, "<h2>(.*?)</h2>"),
            ("a.com", "title", 2, "<h1>(.*?</h1>"), ("a.com", "author", 1, "no group"), ("a.com", "author", 2, None),
            ("a.com", "image_link", 1, "(?x) a(b) # open comment"), ("a.com", "colour", 1, "(x)"), ("a.com", "content", 0, "(x)"),
            ("a.com", None, 1, "(x)"), (None, "title", 1, "(x)"), (" ", "title", 1, "(x)"), ("b.com", "content", 1, "x" * 1025)]
    compiled, rejects = rules.compile_rules(table(spark, rows))
    got = {(r.host, r.field, r.tier, r.pattern): r.reason for r in rejects.collect()}
    assert got == {
        ("a.com", "title", 1, "<h2>(.*?)</h2>"): rules.ANOTHER, ("a.com", "title", 2, "<h1>(.*?</h1>"): rules.NOT_A_PATTERN,
        ("a.com", "author", 1, "no group"): rules.NO_GROUP, ("a.com", "image_link", 1, "(?x) a(b) # open comment"): rules.NOT_A_PATTERN,
        ("a.com", "colour", 1, "(x)"): rules.UNKNOWN_FIELD, ("a.com", "content", 0, "(x)"): rules.UNKNOWN_TIER,
        ("a.com", None, 1, "(x)"): rules.UNKNOWN_FIELD, (None, "title", 1, "(x)"): rules.NO_HOST, ("", "title", 1, "(x)"): rules.NO_HOST,
        ("b.com", "content", 1, "x" * 1025): rules.TOO_LONG}
    by = {r.host: r.asDict() for r in compiled.collect()}
    assert set(by) == {"a.com", "b.com"}
    a = by["a.com"]
    assert a["title_1"] == "(?:<h1>(.*?)</h1>)()" and a["title_2"] == "" and a["author_2"] == "" and a["content_1"] is None
    assert by["b.com"]["content_1"] == ""


def test_group_detection(spark):
    yes = [r"(a)", r"a(?<name>b)", r"\\(a)", r"[(](b)", r"(?:a)(b)", r"[]](b)", r"\Q(\E(b)"]
    no = [r"(?:a)", r"\(a\)", r"[(a)]", r"(?=a)b", r"(?<!a)b", r"(?<=a)b", r"\Q(a)\E", r"(?i)a", r"[^(]"]
    got = spark.createDataFrame([(p,) for p in yes + no], "p string").select("p", rules.has_group(F.col("p")).alias("g")).collect()
    assert {r.p for r in got if r.g} == set(yes)


def test_any_accepted_pattern_runs(spark):
    """Whatever is accepted can be run; group 1 is the rule's own."""
    pats = [r"x(a+)b", r"(?i)X(A)", r"(?<v>a)", r"a|(b)", r"(?s)x(.*)"]
    compiled, rejects = rules.compile_rules(table(spark, [(f"h{i}", "title", 1, p) for i, p in enumerate(pats)]))
    assert rejects.isEmpty()
    pages = spark.createDataFrame([(i, f"http://H{i}/p", "xaab") for i in range(len(pats))], "page_id int, url string, html string")
    got = [r.title_1 for r in extract.tier_values(pages, compiled).orderBy("page_id").collect()]
    assert got == ["aa", "a", "a", "", "aab"]


def test_bad_rule_costs_its_tier_only(spark):
    page = "<title>T</title><h1>H</h1><article>text</article><i>me</i>"
    pages = spark.createDataFrame([(1, "http://a.com/1", page), (2, "http://b.com/1", page), (3, "http://c.com/1", page)],
                                  "page_id int, url string, html string")
    compiled, _ = rules.compile_rules(table(spark, [
        ("a.com", "title", 1, "<h1>(.*"), ("a.com", "author", 1, "<i>(.*?)</i>"), ("b.com", "title", 1, ""), ("b.com", "title", 2, "(q+)")]))
    got = {r.page_id: (r.title, r.author, r.content) for r in extract.extract_articles(pages, compiled).collect()}
    assert got == {1: ("T", "me", "text"), 2: ("", "", "text"), 3: ("H", "", "text")}


def test_second_tier_runs_only_where_needed(spark):
    """Lazy tiers give the values that both tiers computed at once give."""
    pages = Model(spark, SF001).t.pages.where("html is not null")
    merged = extract.merged_values(pages).select("page_id", *extract.FIELDS[:4])
    t = extract.tier_values(pages)
    both = t.select("page_id", *[extract.field_priority(F.col(f"{f}_1"), F.col(f"{f}_2")).alias(f) for f in extract.FIELDS[:4]])
    assert merged.exceptAll(both).isEmpty() and both.exceptAll(merged).isEmpty()


def test_failed_fetch_never_beats_a_page(spark):
    wanted = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3"), (4, "u1")], "article_id long, url string")
    fetched = spark.createDataFrame(
        [("u1", "", 5), ("u1", "old", 1), ("u1", "new", 2), ("u2", None, 9), ("u3", "one", None), ("other", "x", 1)],
        "url string, html string, fetched_at int")
    assert {tuple(r) for r in crawl.usable_page(fetched, wanted).select("article_id", "url", "html").collect()} == {
        (1, "u1", "new"), (4, "u1", "new"), (3, "u3", "one")}
    assert {r.html for r in crawl.usable_page(fetched.drop("fetched_at"), wanted).where("url = 'u1'").collect()} == {"old"}


def test_application_applies_site_rules(spark):
    """Each site's stored rules decide; a bad rule is kept with its reason and the
    crawl goes on; a page fetched badly once and well once is crawled."""
    m = Model(spark, SF001)
    root = scratch_path(spark, "test-app-rules")
    media = seed.media_with_rules(m.media())
    own = (F.when(F.col("id") % 3 == 0, r"<title>(.*?)</title>").when(F.col("id") % 3 == 1, "(broken").otherwise(F.col("xpath_author")))
    media = media.withColumn("xpath_author", own)
    app.seed(spark, root, media, m.user_media())
    app.ingest(spark, root, feeds.render_feed_documents(feeds.feed_items_from_articles(m.article(), m.media())))
    link_of = m.article().select(F.col("id").alias("page_id"), F.col("link_url").alias("url"), "media_id")
    pages = m.t.pages.select("page_id", "html").join(link_of, "page_id")
    again = pages.select("url", F.lit("").alias("html"))
    n = app.crawl(spark, root, pages.select("url", "html").unionByName(again), dt.datetime(2024, 2, 1))
    assert n == pages.count()
    got = app.articles(spark, root).where("s3_prefix <> ''").join(
        pages.select(F.col("url").alias("link_url"), "html", F.col("media_id").alias("m")), "link_url")
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    footer = F.regexp_extract("html", extract.DEFAULT_RULES["author"][1], 1)
    assert got.where((F.col("m") % 3 == 0) & (F.col("author") != title)).isEmpty()
    assert got.where((F.col("m") % 3 != 0) & (F.col("author") != footer)).isEmpty()
    rejects = spark.read.parquet(f"{root}/rule_rejects")
    sites = media.where("id % 3 = 1").count()
    assert {r.reason for r in rejects.collect()} == {rules.NOT_A_PATTERN} and rejects.count() == sites > 0
    app.site_rules(spark, root)
    assert spark.read.parquet(f"{root}/rule_rejects").count() == sites
