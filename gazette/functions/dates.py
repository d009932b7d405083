"""Date handling: feed date parsing, display format, storage prefix."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: "no date" sentinel, display format, feed date shape.
SENTINEL_TS = _dt.datetime(1970, 1, 1, 0, 0, 0)
DISPLAY_FORMAT = "yyyy-MM-dd HH:mm"
# RFC-822 style date as the feeds carry it: weekday name (must be valid, need
# not match), 1-2 digit day, month abbreviation, year, time, then a numeric
# offset or Z.  Named zones such as GMT do not parse.  The offset is dropped:
# the stored value is the wall-clock part.
# The offset is Z or +/-HH[:]MM with optional seconds and fraction, colons
# used consistently, hours below 24.
FEED_OFFSET_RE = (r"(?:Z|[+-](?:[01]\d|2[0-3])"
                  r"(?::[0-5]\d(?::[0-5]\d(?:\.\d{1,6})?)?|[0-5]\d(?:[0-5]\d(?:\.\d{1,6})?)?))")
FEED_DATE_RE = (r"^(?i:mon|tue|wed|thu|fri|sat|sun),\s+(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+"
                r"(\d{1,2}:\d{1,2}:\d{1,2})\s+" + FEED_OFFSET_RE + r"\z")
FEED_DATE_FORMAT = "d MMM yyyy H:m:s"


def sentinel() -> Column:
    return F.lit(SENTINEL_TS).cast("timestamp_ntz")


def parse_feed_date(text: Column) -> Column:
    """Feed date text -> TIMESTAMP_NTZ wall clock; unparsable -> 1970 sentinel."""
    groups = [F.regexp_extract(text, FEED_DATE_RE, i) for i in (1, 2, 3, 4)]
    month = F.initcap(F.lower(groups[1]))
    wall = F.concat_ws(" ", groups[0], month, groups[2], groups[3])
    ts = F.try_to_timestamp(wall, F.lit(FEED_DATE_FORMAT)).cast("timestamp_ntz")
    return F.coalesce(F.when(text.isNotNull() & (groups[0] != ""), ts), sentinel())


def format_publish_date(ts: Column) -> Column:
    return F.date_format(ts, DISPLAY_FORMAT)


def resolve_publish_date(row_date: Column, extracted: Column, run_ts) -> Column:
    """Row date unless sentinel, else extracted date unless sentinel, else the run time."""
    s = sentinel()
    return F.coalesce(F.when(row_date != s, row_date), F.when(extracted != s, extracted),
                      F.lit(run_ts).cast("timestamp_ntz"))


def s3_prefix_build(media_name: Column, ts: Column, title: Column) -> Column:
    """Articles/media=<name>/Year=<y>/Month=<m>/Day=<d>/Hour=<h>/<title_key>, unpadded."""
    from .text import title_key

    parts = [F.lit("Articles/media="), media_name,
             F.lit("/Year="), F.year(ts).cast("string"),
             F.lit("/Month="), F.month(ts).cast("string"),
             F.lit("/Day="), F.dayofmonth(ts).cast("string"),
             F.lit("/Hour="), F.hour(ts).cast("string"),
             F.lit("/"), title_key(title)]
    return F.concat(*parts)
