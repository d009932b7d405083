"""Per-site extraction rules: rows ``(host, field, tier, pattern)`` compiled to
one row of patterns per host.

Every pattern is tried by the regex engine that will run it, as a column
expression, before a page sees it: a rule that does not compile, has no group or
names no known field goes to a reject frame with its reason and switches its tier
off, so one bad rule costs that field of that site and never the crawl.  A
compiled pattern is ``(?:pattern)()``: group 1 exists whatever the rule holds.

An empty pattern switches a tier off on purpose.  A field and tier that a host
has no rule for keeps the default rule, as do hosts without any rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import FIELDS, rule_columns

# Declared length of a stored rule.
MAX_PATTERN = 1024
# Reasons of the reject frame, in the order they are tested.
NO_HOST, UNKNOWN_FIELD, UNKNOWN_TIER = "no host", "unknown field", "unknown tier"
TOO_LONG, NOT_A_PATTERN, NO_GROUP = "pattern too long", "pattern does not compile", "pattern has no group"
ANOTHER = "another rule for the same field and tier"


def guarded(pattern: Column) -> Column:
    """The pattern as it is run: its own groups first, then an empty one."""
    return F.concat(F.lit("(?:"), pattern, F.lit(")()"))


def compiles(pattern: Column) -> Column:
    """Whether the engine accepts the guarded pattern (no row ever fails)."""
    return F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("matches"),
                           guarded(pattern), F.lit("")).isNotNull()


def has_group(pattern: Column) -> Column:
    """Whether the pattern has a capturing group: an opening bracket outside
    quotes, escapes and character classes that isn't a special construct."""
    bare = F.regexp_replace(pattern, r"(?s)\\Q.*?\\E", "")
    bare = F.regexp_replace(bare, r"(?s)\\.", "")
    bare = F.regexp_replace(bare, r"\[\^?\]?[^\]]*\]", "")
    return bare.rlike(r"\((?!\?)|\(\?<(?![=!])")


def judged(rules: DataFrame) -> DataFrame:
    """Distinct rules, host in lower case, with ``reason`` (null: good)."""
    rows = rules.select(
        F.lower(F.btrim("host")).alias("host"), "field", F.col("tier").cast("int").alias("tier"),
        F.coalesce("pattern", F.lit("")).alias("pattern")).distinct()
    p = F.col("pattern")
    reason = (F.when(F.coalesce("host", F.lit("")) == "", NO_HOST)
              .when(~F.coalesce(F.col("field").isin(*FIELDS), F.lit(False)), UNKNOWN_FIELD)
              .when(~F.coalesce(F.col("tier").isin(1, 2), F.lit(False)), UNKNOWN_TIER)
              .when(F.length(p) > MAX_PATTERN, TOO_LONG)
              .when((p != "") & ~compiles(p), NOT_A_PATTERN)
              .when((p != "") & ~has_group(p), NO_GROUP))
    rows = rows.withColumn("reason", reason)
    # of several good rules for one place the smallest pattern stays
    place = Window.partitionBy("host", "field", "tier").orderBy(F.col("reason").isNotNull(), "pattern")
    rank = F.row_number().over(place)
    return rows.withColumn("_rank", rank).withColumn(
        "reason", F.when(F.col("reason").isNull() & (F.col("_rank") > 1), ANOTHER).otherwise(F.col("reason")))


def compile_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns by host, rejects) of rules ``(host, field, tier, pattern)``.

    The first frame has a row per host with a column ``<field>_<tier>`` each
    (null: no rule, '' : off); the second has the rules left out, with why.
    """
    rows = judged(rules)
    rejects = rows.where(F.col("reason").isNotNull()).select("host", "field", "tier", "pattern", "reason")
    first = rows.where((F.col("_rank") == 1) & ~F.coalesce(F.col("reason"), F.lit("")).isin(NO_HOST, UNKNOWN_FIELD, UNKNOWN_TIER))
    run = F.when(F.col("reason").isNull() & (F.col("pattern") != ""), guarded(F.col("pattern"))).otherwise(F.lit(""))
    first = first.withColumn("_run", run)
    wide = [F.max(F.when((F.col("field") == f) & (F.col("tier") == t), F.col("_run"))).alias(f"{f}_{t}")
            for f in FIELDS for t in (1, 2)]
    return first.groupBy("host").agg(*wide), rejects


def rule_rows(by_host: DataFrame) -> DataFrame:
    """Rules ``(host, field, tier, pattern)`` of a table with a column per
    field and tier."""
    each = F.array(*[F.struct(F.lit(c.rpartition("_")[0]).alias("field"), F.lit(int(c[-1])).alias("tier"),
                              F.col(c).alias("pattern")) for c in rule_columns()])
    return by_host.select("host", F.inline(each))
