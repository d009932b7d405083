"""Licence scans by canonical digest (built-in functions only).

A text unit is brought to a canonical form (case, copyright lines, equivalent
spellings, punctuation and spacing), digested, and hash-joined to the digests
of known licence texts.  Units are a document's whole text, each of its
paragraphs (blocks between blank lines) and each line, so that a bare notice
is found as well as a licence that is the document or a block of it.  Only
units whose canonical length equals that of some known text are digested, which
loses nothing.

Null and blank texts have no units; a unit that occurs twice in a document is
one hit; repeated rows are scanned one by one; empty tables give empty results;
extra columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

# Lines that name a copyright holder differ from copy to copy.
COPYRIGHT_LINE = r"^\s*(?:copyright\b|\(c\)|©|all rights reserved\b).*$"
# What a line begins with (after blanks) if it names one.
HOLDER_STARTS = ["copyright", "(c)", "©", "all rights reserved"]
# Equivalent spellings in lower case: (text that is there wherever the pattern
# fits, pattern, canonical); without a pattern the text itself is replaced.
SPELLINGS = [
    ("licence", None, "license"),
    ("non-commercial", r"\bnon-commercial\b", "noncommercial"),
    ("copyright holder", r"\bcopyright holder\b", "copyright owner"),
    ("favour", r"\bfavour", "favor"),
    ("https://", None, "http://"),
    ("&", None, " and "),
    # the letter first: most places are left after one comparison
    ("v", r"v(?<=\bv)\.? ?(?=\d)", "version "),
]
# A run without letters and digits that isn't one space already (or a line end).
GAP = r"(?: ?[^a-z0-9 \n\p{L}\p{N}]|  )[^\p{L}\p{N}\n]*"

# Notices and short licence texts, as published.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
]


def canonical_lines(text: Column) -> Column:
    """Canonical form of every line of ``text``.  No spelling reaches over a line
    end, so whole texts are rewritten, and by a pattern only those that hold what
    it needs."""
    def without_holders(t: Column) -> Column:
        held = reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in HOLDER_STARTS])
        return F.when(held, F.array_join(F.transform(
            F.split(t, "\n"), lambda x: F.regexp_replace(x, COPYRIGHT_LINE, "")), "\n")).otherwise(t)

    def spelled(t: Column, rest: list) -> Column:
        if not rest:
            return F.transform(F.split(F.regexp_replace(t, GAP, " "), "\n"), lambda x: F.btrim(x))
        held, pattern, canonical = rest[0]
        new = (F.replace(t, F.lit(held), F.lit(canonical)) if pattern is None
               else F.when(F.contains(t, F.lit(held)), F.regexp_replace(t, pattern, canonical)).otherwise(t))
        return let(new, lambda x: spelled(x, rest[1:]))

    return let(F.lower(text), lambda t: let(without_holders(t), lambda x: spelled(x, SPELLINGS)))


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """digest, length and license_id of the canonical known texts."""
    texts = spark.createDataFrame(known, "license_id string, text string")
    return (texts.select("license_id", _joined(canonical_lines(F.col("text"))).alias("c"))
            .groupBy(F.sha2(F.col("c").cast("binary"), 256).alias("digest"))
            .agg(F.min("license_id").alias("license_id"), F.min(F.length("c")).alias("length")))


def scan(df: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, license_ids (sorted array), n_units (distinct units that match)
    and whole (the entire text is a known licence)."""
    lengths = [r[0] for r in known.select("length").distinct().collect()]  # one per known text at most
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), "text")
    blank = F.transform(F.split("text", "\n"), lambda x: ~x.rlike(r"\S"))
    # paragraphs: blank lines become a separator that canonical lines can't hold
    marked = F.zip_with("lines", "blank", lambda x, b: F.when(b, F.lit("\n\n")).otherwise(x))
    paragraphs = F.transform(F.split(F.array_join(F.filter(marked, lambda x: x != ""), "\n"), "\n\n\n*"),
                             lambda p: F.btrim(F.regexp_replace(p, "\n+", " ")))

    def digests(units: Column) -> Column:
        fit = F.filter(units, lambda u: F.length(u).isin(lengths))
        return F.array_distinct(F.transform(fit, lambda u: F.sha2(u.cast("binary"), 256)))

    # exploded without a test of the size first, which would be pushed down and
    # compute the units a second time
    units = (rows.where(F.col("text").isNotNull())
             .select("rid", canonical_lines(F.col("text")).alias("lines"), blank.alias("blank"))
             .select("rid", let(_joined(F.col("lines")), lambda w: F.when(F.length(w).isin(lengths), F.sha2(w.cast("binary"), 256))).alias("whole"),
                     digests(F.concat(F.col("lines"), paragraphs, F.array(_joined(F.col("lines"))))).alias("d"))
             .select("rid", "whole", F.explode_outer("d").alias("digest")))
    hits = (units.join(known.select("digest", "license_id"), "digest").groupBy("rid")
            .agg(F.array_sort(F.collect_set("license_id")).alias("license_ids"), F.count(F.lit(1)).alias("n_units"),
                 F.max((F.col("digest") == F.col("whole")).eqNullSafe(True)).alias("whole")))
    return rows.select("rid", "key").join(hits, "rid", "left").select(
        F.col("key").alias(key), F.coalesce("license_ids", F.array().cast("array<string>")).alias("license_ids"),
        F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("whole", F.lit(False)).alias("whole"))
