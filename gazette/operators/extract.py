"""Rule-driven field extraction from fetched pages.

Rules are rows ``(host, <field>_1, <field>_2)``: for every field a tier-1 and
a tier-2 regular expression (group 1 is the value), as ``rules.compile_rules``
makes them from single rules.  A field takes the first non-empty tier; hosts
without a row use ``DEFAULT_RULES``.  The planner picks the join with the rule
table from measured sizes; fields are computed JVM-side, so the HTML never leaves
the executor, and the second tier's patterns run only on pages where the first
tier found nothing.

Content differs by tier: tier 1 is the whole text of the first match (tags
dropped), tier 2 the text of every match joined with nothing, in page order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import field_priority, parse_feed_date, url_host
from ..functions.dates import sentinel
from .fence import where_computed

FIELDS = ("title", "content", "author", "image_link", "publish_date")

# Regex rules matching the fixture page markup (tier 1, tier 2).
DEFAULT_RULES = {
    "title": (r"<h1>(.*?)</h1>", r"<title>(.*?)</title>"),
    "content": (r"(?s)<article>(.*?)</article>", r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"),
    "author": (r'class="author">(.*?)<', r"<footer>&copy; (.*?) &middot;"),
    "image_link": (r'<img[^>]* src="([^"]+)"', r'<a href="([^"]+)"'),
    "publish_date": (r"<time[^>]*>(.*?)</time>", ""),
}
TAG_RE = r"<[^>]+>"


def rule_columns() -> list[str]:
    return [f"{f}_{t}" for f in FIELDS for t in (1, 2)]


def _first(html: Column, pattern: Column) -> Column:
    """Group 1 of the first match, '' when there is none (or no pattern)."""
    return F.when(pattern == "", F.lit("")).otherwise(
        F.call_function("regexp_extract", html, pattern, F.lit(1)))


def _all_joined(html: Column, pattern: Column, drop: str) -> Column:
    """Group 1 of every match without what ``drop`` matches, joined."""
    found = F.call_function("regexp_extract_all", html, pattern, F.lit(1))
    return F.when(pattern == "", F.lit("")).otherwise(
        F.array_join(F.transform(found, lambda x: F.regexp_replace(x, drop, "")), ""))


def with_rules(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Attach the rule patterns of each page's host (defaults where none)."""
    p = pages.withColumn("host", url_host(F.col("url")))
    if rules is not None:
        r = rules.select("host", *[F.col(c).alias(f"_r_{c}") for c in rule_columns()])
        p = p.join(r, "host", "left")
    for f in FIELDS:
        for t in (1, 2):
            default = F.lit(DEFAULT_RULES[f][t - 1])
            src = F.coalesce(F.col(f"_r_{f}_{t}"), default) if rules is not None else default
            p = p.withColumn(f"_p_{f}_{t}", src)
    return p


def _tier(f: str, tier: int) -> Column:
    """The value of one field by one tier's pattern ('' when there is none)."""
    html, pattern = F.col("html"), F.col(f"_p_{f}_{tier}")
    if f != "content":
        v = _first(html, pattern)
    elif tier == 1:
        v = F.regexp_replace(_first(html, pattern), TAG_RE, "")
    else:
        v = _all_joined(html, pattern, TAG_RE)
    return F.coalesce(v, F.lit(""))


def tier_values(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Per page and field, the tier-1 and tier-2 values (before merging)."""
    p = with_rules(pages, rules)
    out = [F.col(c) for c in pages.columns if c != "html"] + [F.col("host")]
    return p.select(*out, *[_tier(f, t).alias(f"{f}_{t}") for f in FIELDS for t in (1, 2)])


def merged_values(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """First non-empty tier of each field; the date is parsed (sentinel if none)."""
    p = with_rules(pages, rules)
    keep = [c for c in pages.columns if c != "html"] + ["host"]
    # the first tier as columns of their own, so that the second one's patterns
    # stand in the branch not taken
    one = p.select(*keep, "html", *[f"_p_{f}_2" for f in FIELDS], *[_tier(f, 1).alias(f"_v_{f}") for f in FIELDS])
    both = one.select(*keep, *[F.when(F.col(f"_v_{f}") != "", F.col(f"_v_{f}")).otherwise(_tier(f, 2)).alias(f) for f in FIELDS])
    date = F.when(F.col("publish_date") == "", sentinel()).otherwise(parse_feed_date(F.col("publish_date")))
    return both.withColumn("publish_date", date)


def incomplete(df: DataFrame) -> Column:
    """Any of content/author/date/image still missing (the title is not tested)."""
    return ((F.col("content") == "") | (F.col("author") == "")
            | (F.col("publish_date") == sentinel()) | (F.col("image_link") == ""))


def extract_articles(pages: DataFrame, rules: DataFrame | None = None,
                     keep_empty: bool = False) -> DataFrame:
    """All fields of every page, tiers merged, with an ``incomplete`` flag.

    Only pages with non-empty content proceed (``keep_empty`` keeps all);
    pages whose html is NULL (fetch failed) are left out and stay pending.
    """
    out = merged_values(pages.where(F.col("html").isNotNull()), rules)
    out = out.withColumn("incomplete", incomplete(out))
    if keep_empty:
        return out
    # keeps the predicate on the computed content (no second regex pass)
    return where_computed(out, F.length("content") > 0)


def extraction_quality(extracted: DataFrame) -> DataFrame:
    """Missing-field report per host."""
    s = sentinel()
    return extracted.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.col("author") == "").alias("n_no_author"),
        F.count_if(F.col("image_link") == "").alias("n_no_image"),
        F.count_if(F.col("publish_date") == s).alias("n_no_date"),
        F.count_if(F.col("content") == "").alias("n_no_content"))
