"""Removal of passages that repeat anywhere in the corpus.

A window is ``WINDOW`` consecutive words of one document; a word goes if some
window over it also starts anywhere else.

1. Anchors.  Each window names the least hash among its ``ANCHOR``-word
   phrases (leftmost on ties), so equal windows name equal phrases and about
   one phrase in twelve words is named.  Phrases named once can't lie in a
   repeated window.
2. Confirm.  Windows that name a recurring phrase are counted by their own
   hash; those found twice or more are the recurring windows, and overlapping
   ones join to passages.
3. Locate.  Documents stream through automata in shards of bounded size: each
   shard compiles the distinct passages confirmed for its documents, as word
   sequences, with Aho-Corasick, and every document of the shard is run through
   it whole.  Words under any occurrence go.

Null and blank texts have no words.  Repeated rows are documents of their own
(rows are joined on an internal row id), so each repeats the other.  Empty
tables give empty results; extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, range_hashes, scan_words, shuffle_partitions, stored

WINDOW = 35
ANCHOR = 12
# Words of the documents in one automaton shard (one longer document is a shard).
SHARD_WORDS = 300_000


def _windows_ok(first: np.ndarray, total: int, window: int) -> np.ndarray:
    """Whether a window of the same document starts at each word."""
    ok = np.zeros(total, dtype=bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= window:
            ok[a:b - window + 1] = True
    return ok


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = g, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def named_phrases(hashes: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """(phrase hash, first window, windows) of each run of windows that name
    the same phrase occurrence."""
    n = len(hashes)
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    s = np.arange(n - anchor + 1)
    g = range_hashes(hashes, s, s + anchor)
    v = _least(g, window - anchor + 1)
    ok = _windows_ok(first, n, window)[:len(v)]
    same = np.zeros(len(v), dtype=bool)  # names the same occurrence as the window before
    same[1:] = ok[1:] & ok[:-1] & (v[1:] == v[:-1]) & (g[:len(v) - 1] != v[:-1])
    start = np.flatnonzero(ok & ~same)
    ends = np.flatnonzero(ok & ~np.append(same[1:], False)) + 1
    return v[start], start, ends - start


def _anchors(window: int, anchor: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy()
            for run in scan_words(b.column(2)):
                v, start, n = named_phrases(run.hashes, run.first, window, anchor)
                doc = np.searchsorted(run.first, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(v)), pa.array(rid[run.row + doc]),
                     pa.array((start - run.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["phrase", "rid", "start", "n"])

    return find


def _window_hashes(window: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, spans = b.column(0).to_numpy(), b.column(3)
            for run in scan_words(b.column(2)):
                at, doc = [], []
                for i in range(len(run)):
                    for sp in spans[run.row + i].as_py():
                        at.append(np.arange(sp["start"], sp["start"] + sp["n"]))
                        doc.append(np.full(sp["n"], i))
                if not at:
                    continue
                at, doc = np.concatenate(at), np.concatenate(doc)
                s = run.first[doc] + at
                h = range_hashes(run.hashes, s, s + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(h)), pa.array(rid[run.row + doc]), pa.array(at.astype(np.int32))],
                    ["w", "rid", "at"])

    return find


def spans_of(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Passages (first word, end) that windows at ``starts`` cover."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [tuple(x) for x in out]


def covered(documents: list[list[str]], spans: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """For each document a mask of the words under any occurrence of any of
    the passages: one automaton over word ids."""
    import ahocorasick

    ids: dict[str, int] = {}
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, parts in zip(documents, spans):
        for a, b in parts:
            seq = tuple(ids.setdefault(w, len(ids) + 1) for w in words[a:b])
            found.add_word(seq, len(seq))
    masks = []
    if ids:
        found.make_automaton()
    for words in documents:
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        if ids:
            for end, n in found.iter(tuple(ids.get(w, 0) for w in words)):
                edge[end + 1 - n] += 1
                edge[end + 1] -= 1
        masks.append(np.cumsum(edge[:-1]) > 0)
    return masks


def located(df_rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """rid, key, text of every row with the starts of its recurring windows."""
    # dealt by row once: the same exchange feeds all three uses of the texts
    base = df_rows.repartition(shuffle_partitions(df_rows.sparkSession), "rid")
    named = base.mapInArrow(_anchors(window, anchor), "phrase long, rid long, start int, n int")
    again = named.groupBy("phrase").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("phrase")
    spans = (named.join(again, "phrase", "left_semi").groupBy("rid")
             .agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    windows = base.join(spans, "rid").mapInArrow(_window_hashes(window), "w long, rid long, at int")
    recurring = windows.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w")
    starts = windows.join(recurring, "w", "left_semi").groupBy("rid").agg(F.collect_list("at").alias("starts"))
    return base.join(starts, "rid", "left")


def cut_repeats(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id",
                with_text: bool = False) -> DataFrame:
    """``key``, n_words, n_removed, kept_sha256 (and, ``with_text``, the kept
    words joined by one space) of every row."""
    key_type = dict(df.dtypes)[key]
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            shard: list[tuple] = []
            size = 0

            def flush():
                for (k, words, _), mask in zip(shard, covered([x[1] for x in shard], [x[2] for x in shard])):
                    kept = b" ".join(w for w, m in zip(words, mask.tolist()) if not m)
                    for col, v in zip(out, (k, len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else b"")):
                        col.append(v)
                shard.clear()

            for k, text, starts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                words = (text.as_py() or "").encode().split()
                parts = spans_of(starts or [], window)
                shard.append((k, words, parts))
                size += len(words)
                if size >= SHARD_WORDS:
                    flush()
                    size = 0
            flush()
            cols = [pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.string())]
            names = [key, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array([x.decode() for x in out[4]], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{key}` {key_type}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return located(rows, window, anchor).select("key", "text", "starts").mapInArrow(cut, schema)
