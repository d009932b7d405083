"""Line dedup by distinct-site spread (built-in functions only).

A line (trimmed, with at least one word) is known by a 128-bit hash.  Each
hash gets a HyperLogLog sketch of the sites it is seen on, merged by
aggregation.  Estimates clearly over or under ``min_sites`` decide at once;
lines near the threshold get an exact distinct count.  Lines on ``min_sites``
sites or more are boilerplate and are cut from every document, except from
documents made mostly of such lines (``max_share`` of their word-bearing
characters): those are copies of one another, which document-level dedup
handles, and cutting them would lose the only text.

Null texts stay null, empty texts empty; a null site counts as one site of
its own; repeated rows are separate documents; extra columns pass through
unchanged.  Lines without a word are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 6
MAX_SHARE = 50
LG_K = 9
# Half-width of the band around the threshold that is counted exactly: over
# ten standard errors (1.04 / sqrt(2^LG_K)) of the sketch.
BAND = 0.5
_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK))),
                    lambda x: F.length(x) > 0)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def spread(df: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``key`` of the lines found on ``min_sites`` sites or more."""
    # a null site hashes unlike any string
    s = F.when(F.col(site).isNull(), F.lit(-1)).otherwise(F.xxhash64(site))
    seen = df.where(F.col("text").isNotNull()).select(
        F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias("key"), s.alias("site"))
    est = seen.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n"))
    # a line that many sites may share: everything not clearly under
    maybe = est.where(F.col("n") >= min_sites * (1 - BAND))
    sure = maybe.where(F.col("n") > min_sites * (1 + BAND)).select("key")
    near = maybe.where(F.col("n") <= min_sites * (1 + BAND)).select("key")
    exact = (seen.join(near, "key", "left_semi").groupBy("key", "site").agg(F.count(F.lit(1)))
             .groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("key"))
    return sure.unionAll(exact)


def cut_boilerplate(df: DataFrame, site: str = "source", min_sites: int = MIN_SITES,
                    max_share: int | None = MAX_SHARE) -> DataFrame:
    """All columns of ``df`` as struct ``row``, the new ``text`` and
    ``n_lines``/``n_cut`` (word-bearing lines, lines cut).  Without ``max_share``
    only documents that would have no line left stay whole."""
    base = df.select(F.monotonically_increasing_id().alias("rid"),
                     F.struct(*[df[c] for c in df.columns]).alias("row"))
    keys = F.explode(F.array_distinct(F.transform(_lines(F.col("row.text")), _key)))
    bad = spread(df, site, min_sites)
    hits = (base.select("rid", keys.alias("key")).join(bad, "key", "left_semi")
            .groupBy("rid").agg(F.collect_list("key").alias("bad")))
    joined = base.join(hits, "rid", "left")
    # line, whether it has a word and whether it goes
    parts = F.transform(F.split(F.col("row.text"), "\n"), lambda x: F.struct(
        x.alias("x"), F.length(F.btrim(x, F.lit(_BLANK))).alias("n"),
        F.array_contains(F.col("bad"), _key(F.btrim(x, F.lit(_BLANK)))).alias("cut")))
    total = F.aggregate("parts", F.lit(0), lambda a, p: a + p["n"])
    cut = F.aggregate("parts", F.lit(0), lambda a, p: a + F.when(p["cut"] & (p["n"] > 0), p["n"]).otherwise(0))
    plain = F.col("bad").isNull()
    kept = F.filter("parts", lambda p: (p["n"] == 0) | ~p["cut"])
    n_lines = F.size(_lines(F.coalesce(F.col("row.text"), F.lit("")))).cast("long")
    out = joined.select("row", "bad", F.when(plain, F.lit(None)).otherwise(parts).alias("parts"))
    spared = (F.exists("parts", lambda p: (p["n"] > 0) & ~p["cut"]) if max_share is None
              else cut * 100 <= total * max_share)
    out = out.select("row", "parts", (F.col("parts").isNotNull() & spared).alias("cuts"))
    return out.select(
        "row", F.when(F.col("cuts"), F.array_join(F.transform(kept, lambda p: p["x"]), "\n"))
        .otherwise(F.col("row.text")).alias("text"), n_lines.alias("n_lines"),
        F.when(F.col("cuts"), F.size(F.filter("parts", lambda p: (p["n"] > 0) & p["cut"])))
        .otherwise(0).cast("long").alias("n_cut"))


def clean(df: DataFrame, **options) -> DataFrame:
    """``df`` with boilerplate lines cut; ``n_chars`` follows, if there."""
    out = cut_boilerplate(df, **options)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[(F.when(F.col("n_cut") > 0, new[c]).otherwise(F.col("row")[c]) if c in new
                         else F.col("row")[c]).alias(c) for c in df.columns])
