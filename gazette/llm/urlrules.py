"""URL allow/block rules as a sort-merge range join.

A host is keyed by its labels in reverse, each ended by a dot, so that a host
and all its subdomains are one interval of sorted keys.  Pages and rules are
cut into ranges of (host key, path, id) at bounds from a hash-chosen sample of
fixed size; a rule goes to every range its interval meets, a page to one, and
a host with very many pages spans several ranges.  Each range is sorted and
swept once: a stack holds the rule hosts whose interval is open, nested ones on
top, and a page is judged by the rules on the stack whose path begins its own.

The longest fitting rule (host plus path) wins; between equally long ones the
longer host, then ``block``.  Without a rule the verdict is ``default``.  A
null url or one without ``://`` has an empty host and path and fits no rule.
Repeated rows are judged one by one; empty tables and extra columns are fine.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

# Sampled pages per range, from which the bounds are taken.
SAMPLES_PER_RANGE = 16
_TOP = "\U0010ffff"


def url_parts(url):
    """(host, path) columns; A-Z of the host lower-cased."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """``key``, host, path, the winning rule (host + path) and the verdict.

    ``rules`` has columns host, path, verdict (``allow`` or ``block``).
    """
    spark = pages.sparkSession
    n = shuffle_partitions(spark)
    host, path = url_parts(F.col("url"))
    judged = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("hkey", host_key(F.col("host")))
    salt = F.xxhash64("id", "host", "path")
    sample = [tuple(r) for r in judged.groupBy(F.pmod(salt, F.lit(n * SAMPLES_PER_RANGE)).alias("b"))
              .agg(F.min_by(F.struct("hkey", "path", salt.alias("s")), F.xxhash64(salt)).alias("m"))
              .select("m.*").collect()]
    bounds = sorted(sample)[SAMPLES_PER_RANGE::SAMPLES_PER_RANGE]

    def range_of(h: str, p: str, s: int) -> int:
        return bisect.bisect_right(bounds, (h, p, s))

    def with_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, p, s = (b.column(i).to_pylist() for i in (3, 2, 4))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([range_of(*x) for x in zip(h, p, s)], pa.int32())], [*b.schema.names, "r"])

    def rule_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, p, v, k in zip(*(b.column(i).to_pylist() for i in range(4))):
                lo, hi = range_of(k, "", -(1 << 63)), range_of(k + _TOP, "", 0)
                rows += [(None, h, p, k, None, r, v) for r in range(lo, hi + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names)

    id_type = dict(pages.dtypes)[key]
    schema = f"id {id_type}, host string, path string, hkey string, s long, r int"
    names = ["id", "host", "path", "hkey", "s", "r", "verdict"]
    events = judged.withColumn("s", salt).mapInArrow(with_ranges, schema).withColumn("verdict", F.lit(None).cast("string"))
    types: list[pa.DataType] = []
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(events.schema)]
    opened = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
              .select("host", "path", "verdict", host_key(F.col("host")).alias("hkey"))
              .mapInArrow(rule_ranges, events.schema))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (host key, {path: (rule, verdict)}) of the open rule hosts
        stack: list[tuple[str, dict[str, tuple[str, str]]]] = []
        at = None
        for b in batches:
            out: list[tuple] = []
            for id_, h, p, k, _, r, v in zip(*(b.column(i).to_pylist() for i in range(7))):
                if r != at:
                    stack, at = [], r
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if v is not None:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, {}))
                    old = stack[-1][1].get(p)
                    if old is None or v == "block":
                        stack[-1][1][p] = (h + p, v)
                    continue
                best = None
                for hk, paths in stack:
                    for rp, rule in paths.items():
                        if p.startswith(rp) and (best is None or len(rule[0]) >= len(best[0])):
                            best = rule
                out.append((id_, h, p, *(best or (None, default))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate(
                    [types[0], pa.string(), pa.string(), pa.string(), pa.string()])],
                [key, "host", "path", "rule", "verdict"])

    return (events.unionByName(opened).repartition(n, "r")
            .sortWithinPartitions("r", "hkey", F.col("verdict").isNull(), "path", "s")
            .mapInArrow(sweep, f"`{key}` {id_type}, host string, path string, rule string, verdict string"))
