"""Filtering on computed columns without recomputing them.

Catalyst pushes a filter below the projection that computes the columns it
tests, substituting the expressions; for expensive expressions (regexes over
whole pages, JSON parsing of whole answers) the work then runs twice per row.
Filtering the output of a one-row ``inline`` keeps the predicate above: the
generator's output cannot be substituted, and ``inline`` of a one-element
array is a cheap in-stage operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame) -> DataFrame:
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def where_computed(df: DataFrame, cond: Column) -> DataFrame:
    """``df.where(cond)`` evaluated on ``df``'s computed columns."""
    return fenced(df).where(cond)
