"""All declared constraints of a set of tables, checked in one pass.

Every table is scanned once.  A row gives a few entries: its primary key, the
parent keys that it refers to, its key as a parent of other tables, and one for
each NOT NULL or length rule that it breaks.  One aggregate over all entries finds
keys held twice and references nobody answers; entries of equal keys collapse
before the shuffle, so a parent that a third of all rows refers to costs one entry
a task.  The checks come from the tables' schemas.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FOREIGN_KEYS, LENGTH_CAPS, PRIMARY_KEYS, TABLES

PRIMARY, FOREIGN, NOT_NULL, LENGTH = "primary key", "foreign key", "not null", "length"


def declared() -> list[tuple[str, str, str]]:
    """(table, check, target) of every declared constraint."""
    out = [(t, PRIMARY, ",".join(k)) for t, k in PRIMARY_KEYS.items()]
    out += [(t, FOREIGN, c) for t, c, _p, _pc in FOREIGN_KEYS]
    out += [(t, NOT_NULL, f.name) for t, s in TABLES.items() for f in s.fields if not f.nullable]
    return out + [(t, LENGTH, c) for t, caps in LENGTH_CAPS.items() for c in caps]


def _entry(table: str, check: str, target: str, key: list[tuple[str, T.DataType]] = (), child: int = 1, parent: int = 0):
    longs = [F.col(c).cast("long") for c, kind in key if not isinstance(kind, T.StringType)]
    texts = [F.col(c).cast("string") for c, kind in key if isinstance(kind, T.StringType)]
    none = F.lit(None)
    first, second = (longs + [none, none])[:2]
    return F.struct(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), F.lit(target).alias("target"),
                    first.cast("long").alias("k1"), second.cast("long").alias("k2"), (texts + [none])[0].cast("string").alias("k3"),
                    F.lit(child).cast("long").alias("child"), F.lit(parent).cast("long").alias("parent"))


def entries(df: DataFrame, table: str) -> DataFrame:
    """The entries of one table's rows; a declared column that ``df`` lacks is
    NULL in every row."""
    schema = TABLES[table]
    kinds = {f.name: f.dataType for f in schema.fields}
    df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    key = [(c, kinds[c]) for c in PRIMARY_KEYS[table]]
    always = [_entry(table, PRIMARY, ",".join(PRIMARY_KEYS[table]), key)]
    always += [_entry(t, FOREIGN, c, [(pc, kinds[pc])], 0, 1) for t, c, p, pc in FOREIGN_KEYS if p == table]
    some = [F.when(F.col(c).isNotNull(), _entry(t, FOREIGN, c, [(c, kinds[c])])) for t, c, _p, _pc in FOREIGN_KEYS if t == table]
    some += [F.when(F.col(f.name).isNull(), _entry(table, NOT_NULL, f.name)) for f in schema.fields if not f.nullable]
    some += [F.when(F.length(c) > n, _entry(table, LENGTH, c)) for c, n in LENGTH_CAPS.get(table, {}).items()]
    given = F.concat(F.array(*always), F.array_compact(F.array(*some))) if some else F.array(*always)
    return df.select(F.inline(given))


def report(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, check_name, target, n_keys, n_rows)`` for every declared
    constraint of the given tables: keys and rows that break it (``n_keys`` is null
    where a check is about rows, not keys).  A reference into a table that isn't
    given can't be answered and isn't checked."""
    rows = reduce(DataFrame.unionByName, [entries(df, t) for t, df in tables.items()])
    by_key = rows.groupBy("table_name", "check_name", "target", "k1", "k2", "k3").agg(
        F.sum("child").alias("child"), F.sum("parent").alias("parent"))
    broken = (F.when(F.col("check_name") == PRIMARY, F.col("child") > 1)
              .when(F.col("check_name") == FOREIGN, (F.col("child") > 0) & (F.col("parent") == 0)).otherwise(F.lit(True)))
    found = by_key.where(broken).groupBy("table_name", "check_name", "target").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("child").alias("n_rows"))
    parent_of = {(t, c): p for t, c, p, _pc in FOREIGN_KEYS}
    asked = [d for d in declared() if d[0] in tables and (d[1] != FOREIGN or parent_of[(d[0], d[2])] in tables)]
    every = spark.createDataFrame(asked, "table_name string, check_name string, target string")
    zero = F.lit(0).cast("long")
    return every.join(found, ["table_name", "check_name", "target"], "left").select(
        "table_name", "check_name", "target",
        F.when(F.col("check_name").isin(PRIMARY, FOREIGN), F.coalesce("n_keys", zero)).alias("n_keys"),
        F.coalesce("n_rows", zero).alias("n_rows"))
