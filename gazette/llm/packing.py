"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised once; pieces of full capacity are sequences of their
own, all other pieces are packed by length.  A sequence's contents depend
only on piece lengths, so the packing is solved on the histogram of lengths
(at most ``capacity`` rows, whatever the corpus): for each bin a bitset
subset-sum over the lengths still available, anchored at the longest one,
finds the fullest feasible combination, which is taken as often as its counts
allow.  Pieces then get their place from their rank within their length,
found by a range partitioning and per-partition counts.

Null text is an empty document (one separator token).  Repeated rows are
packed as often as they occur; an empty table gives an empty result; extra
columns are never read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored
from .encoders import byte_pair_encoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0,
           key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the token ids."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_pair_encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = np.append(encode(text.as_py() or ""), np.uint32(separator)).astype("<u4", copy=False)
                for k, (s, n) in enumerate(cut_points(len(a), capacity)):
                    part = a[s:s + n]
                    for col, v in zip(rows, (doc, k, s, n, zlib.crc32(part.tobytes()), part)):
                        col.append(v)
            cols = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in rows[2:5]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The lengths (with multiplicity) of the fullest bin that holds the
    longest available length: subset sums as bits of one integer."""
    top = max(counts)
    room = capacity - top
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for n in sorted(counts, reverse=True):
        left = min(counts[n] - (n == top), room // n)
        size = 1
        while left > 0 and not reach >> room & 1:
            take = min(size, left)
            trail.append((reach, n, take))
            reach |= reach << (n * take) & mask
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = {top: 1}
    for before, n, take in reversed(trail):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + take
            at -= n * take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length the runs (first rank, first sequence, pieces in each
    sequence, offset in it) in order of rank."""
    left = {n: c for n, c in histogram.items() if c}
    runs: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in left}
    done = dict.fromkeys(left, 0)
    sequence = 0
    while left:
        bins = fullest(left, capacity)
        times = min(left[n] // m for n, m in bins)
        offset = 0
        for n, m in bins:
            runs[n].append((done[n], sequence, m, offset))
            done[n] += m * times
            left[n] -= m * times
            if not left[n]:
                del left[n]
            offset += m * n
        sequence += times
    return runs


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a stored table of pieces) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    n = shuffle_partitions(spark)
    names = cut.columns
    dealt = stored(cut.repartitionByRange(n, "length", "doc_id", "piece", "ids_crc32")
                   .withColumn("_part", F.spark_partition_id()), "packing-ranged")
    # lengths are ranges of partitions: at most capacity + partitions rows
    counts = dealt.groupBy("length", "_part").count().collect()
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for length, part, c in sorted(map(tuple, counts)):
        before[(length, part)] = histogram.get(length, 0)
        histogram[length] = before[(length, part)] + c
    runs = plan(histogram, capacity)
    ranks = [[r[0] for r in runs[x]] if x in runs else [] for x in range(capacity + 1)]

    # the rows of a (length, partition) get consecutive ranks in file order
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[int, int], int] = {}
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            part = batch.column(len(names)).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for i, (x, p) in enumerate(zip(length.tolist(), part.tolist())):
                rank = at.get((x, p))
                if rank is None:
                    rank = before[(x, p)]
                at[(x, p)] = rank + 1
                first, seq, m, off = runs[x][bisect.bisect_right(ranks[x], rank) - 1]
                sequence[i] = seq + (rank - first) // m
                offset[i] = off + (rank - first) % m * x
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    # a partition's rows must be numbered by one task: one group per partition
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    # in one order, so that a task that runs again gives the same ranks
    order = ["_part", "length", "doc_id", "piece", "ids_crc32"]
    return dealt.repartition(n, "_part").sortWithinPartitions(*order).mapInArrow(assign, schema)


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0,
         key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences."""
    # placing reads the pieces twice: texts are tokenised once
    cut = stored(pieces(df, tokenizer, capacity, separator, key, with_ids), "packing-pieces")
    return place(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from ``pack(..., with_ids=True)``."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
