"""Quality rules as a short-circuit cascade (built-in functions only).

Each rule is a boolean column that is true for a text to reject.  Cost and
selectivity of every rule are measured on a bounded, hash-chosen sample, and
the rules then run in descending order of rejections per second inside one
``CASE``, which stops at the first rule that rejects.  The order never changes
which documents are rejected, only how much work a rejected one costs.

Null and blank texts have no words, so the word-count rule rejects them; an
empty table gives an empty result; repeated rows are judged one by one, and
extra columns are never read.  Whole texts are judged, however long.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fence import where_computed
from .common import let, split_words

# Rows that rule costs are measured on (the result doesn't depend on them).
SAMPLE_ROWS = 400
WINDOW = 8


def window_hashes(words: Column) -> Column:
    """Hash of every 8-word window, built by doubling (1, 2, 4, 8 words)."""
    def joined(step: int):
        return lambda h: F.zip_with(
            F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))),
            F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))),
            lambda a, b: F.xxhash64(a, b))

    h = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        h = let(h, joined(step))
    return h


def repeated_words(words: Column) -> Column:
    """Words covered by 8-word windows found twice or more in the text."""
    h = window_hashes(words)

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(p: Column) -> Column:
            same = F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]).eqNullSafe(True)
                            | (x["h"] == F.get(p, i + 1)["h"]).eqNullSafe(True))
            at = F.array_sort(F.transform(same, lambda x: x["i"]))
            return F.aggregate(
                at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda acc, i: F.struct(
                    (acc["n"] + WINDOW - F.greatest(acc["end"] - i, F.lit(0))).alias("n"),
                    (i + WINDOW).alias("end")),
                lambda acc: acc["n"])

        return let(pairs, of_sorted)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(h, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def with_words(df: DataFrame, key: list[str]) -> DataFrame:
    """``key`` columns, ``_text`` and ``_words`` (nothing else is read)."""
    return df.select(*key, F.coalesce(F.col("text"), F.lit("")).alias("_text"),
                     split_words(F.col("text")).alias("_words"))


def _n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def metrics() -> dict[str, Column]:
    w, t = F.col("_words"), F.col("_text")
    return {"n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": _n_symbols(t).cast("long"),
            "n_dup_lines": _dup_lines(t).cast("long"),
            "n_repeat_words": repeated_words(w).cast("long")}


BASE = ("too_short", "repeats")


def rules(m: dict[str, Column] | None = None, min_words: int = 20, max_repeat_pct: int = 30,
          word_chars: tuple[int, int] = (2, 12), max_symbols_pct: int = 10,
          max_dup_lines_pct: int = 30) -> dict[str, Column]:
    """Reject conditions; ``m`` gives the counts as columns or expressions."""
    m = m or metrics()
    n = m["n_words"]
    lines = F.size(F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    return {
        "too_short": n < min_words,
        "repeats": m["n_repeat_words"] * 100 > n * max_repeat_pct,
        "word_length": (m["word_chars"] < n * word_chars[0]) | (m["word_chars"] > n * word_chars[1]),
        "symbols": m["n_symbols"] * 100 > n * max_symbols_pct,
        "dup_lines": m["n_dup_lines"] * 100 > lines * max_dup_lines_pct,
    }


def cascade_order(df: DataFrame, conditions: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by measured rejections per second on a sample of ``df``
    (from :func:`with_words`): the texts with the least hashes."""
    text = F.col("_text")
    # the hashes are chosen first, so that only the sampled texts move
    h = F.xxhash64(text).alias("h")
    least = [r[0] for r in df.select(h).groupBy("h").count().orderBy("h").limit(sample_rows).select("h").collect()]
    sample = [] if not least else [r[1] for r in df.select(h, text).where(F.col("h") <= least[-1])
                                   .groupBy("h").agg(F.first("_text")).collect()]
    if not sample:
        return list(conditions)
    spark = df.sparkSession
    probe = with_words(spark.createDataFrame([(x,) for x in sample], "text string").coalesce(1), [])
    score = {}
    for name, bad in conditions.items():
        agg = probe.agg(F.count_if(bad))
        agg.first()  # compiled; the second run is measured
        t = time.perf_counter()
        rejected = agg.first()[0]
        score[name] = (rejected + 0.5) / max(time.perf_counter() - t, 1e-6)
    return sorted(conditions, key=lambda k: -score[k])


def first_failure(conditions: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule in ``order`` that rejects, null if none does."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(conditions[name], F.lit(name)).otherwise(out)
    return out


def judge(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, the counts, ``base_failed`` and ``kept`` of every row."""
    words = with_words(df, [key])
    order = cascade_order(words, rules())
    counted = words.select(key, "_text", *[c.alias(k) for k, c in metrics().items()])
    cond = rules({k: F.col(k) for k in metrics()})
    counts = [F.col(k) for k in metrics()]
    return counted.select(
        key, *counts, (cond["too_short"] | cond["repeats"]).alias("base_failed"),
        first_failure(cond, order).isNull().alias("kept"))


def keep_good(df: DataFrame) -> DataFrame:
    """Rows of ``df`` that no rule rejects, columns unchanged.  The counts are
    expressions inside the cascade, so a rejected row pays only for the rules
    up to the one that rejected it."""
    cond = rules()
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), F.col("text"))
    order = cascade_order(with_words(df, []), cond)
    # the words are computed once per row, not again below the filter
    return where_computed(with_words(packed, ["_row"]), first_failure(cond, order).isNull()).select("_row.*")
