"""Equi-join for keys that are hot on both sides.

One oversized side is the runtime optimiser's business (AQE splits skewed
partitions).  What it can't see is a join that multiplies: a key with many rows
on both sides gives a huge output from partitions of ordinary size.
``skew_safe_join`` splits such keys by their counts, without any ceiling on
the number of hot keys or slices and without running a job of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Target rows of one side of one key inside a single join task.
DEFAULT_ROWS_PER_SLICE = 50_000
# Rows that one key makes before it is dealt over several tasks, and slices that
# it is dealt over at most for that (a copy of the other side each).
ROWS_MADE = 4_000_000
MADE_SLICES = 16


def _slices(n, rows_per_slice: int, max_slices: int | None):
    s = F.greatest(F.ceil(n / F.lit(rows_per_slice)), F.lit(1))
    return (s if max_slices is None else F.least(s, F.lit(max_slices))).cast("int")


def skew_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   left_ids: Sequence[str], right_ids: Sequence[str] | None = None,
                   how: str = "inner",
                   rows_per_slice: int = DEFAULT_ROWS_PER_SLICE,
                   max_slices: int | None = None, right_rows: int | None = None) -> DataFrame:
    """Equi-join on ``keys`` with hot keys split over several tasks.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    ``left_ids``/``right_ids`` spread a side's rows within a key (a row id);
    they only choose the slice and never change the result.  For an inner
    join with ``right_ids`` both sides may be split.  Keys with more than
    ``rows_per_slice`` rows on a side are found by a partial aggregate; their
    table joins back as the planner sees fit.  So are, with ``right_ids``, keys
    that make more than ``ROWS_MADE`` rows: their larger side is dealt over up to
    ``MADE_SLICES`` slices.  Such a join makes far more than it reads, so its
    partitions stay as many as the session asks for, whatever their size.  Its rows
    come by left row, each with all right rows of its slice; ``right_rows`` (default:
    ``rows_per_slice``) are how many at most, which files can repeat cheaply.
    """
    keys = list(keys)
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys).distinct()
    grid = how == "inner" and right_ids is not None
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    if grid:
        counts = counts.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")), keys)
    else:
        counts = counts.withColumn("_nr", F.lit(0))
    nl, nr = F.col("_nl"), F.col("_nr")
    right_rows = min(right_rows or rows_per_slice, rows_per_slice)
    by_left, by_right = _slices(nl, rows_per_slice, max_slices), _slices(nr, right_rows, max_slices)
    hot = (nl > rows_per_slice) | (nr > right_rows)
    if grid and max_slices is None:
        # as doubles: the product of two counts may pass a long
        made = nl.cast("double") * nr
        wanted = F.least(F.ceil(made / F.lit(ROWS_MADE)), F.lit(MADE_SLICES))
        more = F.ceil(wanted / (by_left * by_right)).cast("int")
        by_left, by_right = (by_left * F.when(nl >= nr, more).otherwise(F.lit(1)),
                             by_right * F.when(nl < nr, more).otherwise(F.lit(1)))
        hot = hot | (made > ROWS_MADE)
    stats = counts.where(hot).select(*keys, by_left.alias("_sl"), by_right.alias("_sr"))
    one = F.lit(1)
    sl = F.coalesce(F.col("_sl"), one)
    sr = F.coalesce(F.col("_sr"), one) if grid else one
    lhs = (left.join(stats, keys, "left")
           .withColumn("_a", F.pmod(F.xxhash64(*left_ids), sl).cast("int"))
           .withColumn("_b", F.explode(F.sequence(F.lit(0), sr - 1)))
           .drop("_sl", "_sr"))
    rb = F.pmod(F.xxhash64(*right_ids), sr).cast("int") if grid else F.lit(0)
    rhs = (right.join(stats, keys, "left")
           .withColumn("_b", rb)
           .withColumn("_a", F.explode(F.sequence(F.lit(0), sl - 1)))
           .drop("_sl", "_sr"))
    on = keys + ["_a", "_b"]
    if grid:
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lhs, rhs = lhs.repartition(n, *on).hint("merge"), rhs.repartition(n, *on)
    return lhs.join(rhs, on, how).drop("_a", "_b")
