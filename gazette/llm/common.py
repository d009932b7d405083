"""Shared helpers of the training-data operators: table reads, shared-folder
tables, row ids and the vectorised word scan used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package

# A word is [^\x20\x09-\x0D]+ everywhere in this package.
WORD_GAP = "[ \\t-\\r]+"
# Bytes of text that one vectorised step works on (a longer document is one step).
STEP_BYTES = 128 << 10
# Rows of an Arrow batch: setting, its default, value here.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def prepare(spark: SparkSession) -> None:
    """Name the shared checkpoint folder, ship the package to the executors and
    keep Arrow batches of texts small (a setting of one's own stays)."""
    ensure_checkpoint_dir(spark)
    if spark.conf.get(ARROW_ROWS[0], ARROW_ROWS[1]) == ARROW_ROWS[1]:
        spark.conf.set(ARROW_ROWS[0], ARROW_ROWS[2])
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage;
    the files survive the loss of any executor)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_words(text):
    """Words of a text column as an array (null or blank text: empty)."""
    t = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(t), F.lit(0)) > 0, F.split(t, WORD_GAP)).otherwise(
        F.array().cast("array<string>"))


def let(value, body):
    """``body(value)`` with ``value`` evaluated once per row (a lambda variable)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- vectorised word scan -------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (three multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hashes(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of ``x[start:end]`` for each range."""
    s = np.empty(len(x) + 1, dtype=np.uint64)
    s[0] = 0
    np.cumsum(x.astype(np.uint64, copy=False) * _powers(_BASE, len(x)), out=s[1:])
    h = (s[end] - s[start]) * _powers(_INV, len(x) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting (faster on integers than ``np.unique``)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Words:
    """Word hashes of a run of documents: ``hashes`` in order, and document
    ``i`` (of those in the run) owning ``hashes[first[i]:first[i + 1]]``."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, row: int):
        self.hashes, self.first, self.row = hashes, first, row

    def __len__(self) -> int:
        return len(self.first) - 1


def scan_words(texts: pa.Array, fold_case: bool = False, letters: bool = False) -> Iterator[Words]:
    """64-bit word hashes of an Arrow string column (null: no words), in runs
    of about ``STEP_BYTES``; a document is never split.  ``letters``: ASCII
    punctuation parts words too."""
    if pa.types.is_large_string(texts.type) or pa.types.is_string_view(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if n == 0:
        return
    _, off_buf, data_buf = texts.buffers()
    off = np.frombuffer(off_buf, dtype=np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.empty(0, np.uint8)
    empty = np.asarray(texts.is_null()) if texts.null_count else None
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + STEP_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        b = data[off[i]:off[j]]
        cut = off[i:j + 1] - off[i]
        if fold_case:
            b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
        if letters:
            word = ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
        else:
            word = (b != 32) & ((b < 9) | (b > 13))
        if empty is not None:
            for k in np.flatnonzero(empty[i:j]):
                word[cut[k]:cut[k + 1]] = False
        head = word.copy()
        head[1:] &= ~word[:-1]
        edge = cut[(cut > 0) & (cut < len(b))]
        head[edge] |= word[edge]
        tail = word.copy()
        tail[:-1] &= ~word[1:]
        tail[edge - 1] |= word[edge - 1]
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        hashes = range_hashes(b.astype(np.uint64) + np.uint64(1), start, end)
        yield Words(hashes, np.searchsorted(start, cut), i)
        i = j


def as_long(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)
