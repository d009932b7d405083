"""Property tests: feed dates against Python's strptime, ingest/fan-out laws."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.functions import parse_feed_date

SENTINEL = dt.datetime(1970, 1, 1)
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun", "mon", "SUN", "Xyz", "Monday"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
          "jan", "DEC", "Sept", "Foo"]
OFFSETS = ["-0400", "+0000", "+05:30", "Z", "GMT", "+2400", "+2359", "+053045", "+05:30:45",
           "+05:30:45.123", "-1200", "z", "+5", "+05:3045"]


def python_rule(s):
    """Date as the application parses it: strptime, wall clock kept, offset dropped."""
    try:
        return dt.datetime.strptime(s, "%a, %d %b %Y %H:%M:%S %z").replace(tzinfo=None)
    except (ValueError, TypeError):
        return SENTINEL


date_text = st.builds(
    lambda wd, day, mon, year, h, mi, sec, off, sep: f"{wd},{sep}{day} {mon} {year} {h}:{mi}:{sec} {off}",
    st.sampled_from(WEEKDAYS),
    st.one_of(st.integers(0, 32).map(str), st.integers(1, 31).map(lambda d: f"{d:02d}")),
    st.sampled_from(MONTHS),
    st.integers(1990, 2030).map(str),
    st.one_of(st.integers(0, 24).map(str), st.integers(0, 23).map(lambda h: f"{h:02d}")),
    st.integers(0, 59).map(lambda m: f"{m:02d}"),
    st.one_of(st.integers(0, 61).map(str), st.integers(0, 59).map(lambda s: f"{s:02d}")),
    st.sampled_from(OFFSETS),
    st.sampled_from([" ", "  ", ""]))


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.large_base_example,
                                 HealthCheck.too_slow, HealthCheck.data_too_large])
@given(st.lists(date_text, min_size=200, max_size=200))
def test_feed_dates_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", parse_feed_date(F.col("t")).alias("d")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == python_rule(t), t


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow,
                                 HealthCheck.data_too_large, HealthCheck.large_base_example])
@given(left_keys=st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=1, max_size=300),
       right_keys=st.lists(st.one_of(st.none(), st.integers(0, 8)), min_size=1, max_size=60),
       rows_per_slice=st.integers(1, 40),
       how=st.sampled_from(["inner", "left", "left_semi", "left_anti"]))
def test_skew_safe_join_equals_plain_join(spark, left_keys, right_keys, rows_per_slice, how):
    from gazette.operators.skew import skew_safe_join

    left = spark.createDataFrame([(k, i) for i, k in enumerate(left_keys)], "k int, lid int")
    right = spark.createDataFrame([(k, i) for i, k in enumerate(right_keys)], "k int, rid int")
    plain = left.join(right, "k", how)
    split = skew_safe_join(left, right, ["k"], ["lid"], ["rid"] if how == "inner" else None,
                           how=how, rows_per_slice=rows_per_slice, max_slices=8)
    a = sorted(map(repr, map(tuple, plain.collect())))            # NULL keys included
    b = sorted(map(repr, map(tuple, split.select(*plain.columns).collect())))
    assert a == b
