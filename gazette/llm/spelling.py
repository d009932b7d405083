"""Spelling variants grouped by PartEnum signatures.

A word's letter multiset is a binary vector (one dimension per letter and
repetition).  One inserted or deleted letter changes one dimension, one
replaced letter at most two, so words one edit apart have vectors within
Hamming distance two: one if their lengths differ, two (or none) if they are
equal.  Partition-and-enumerate: the dimensions are dealt to ``P`` parts, and
every choice of ``P - distance`` parts gives a signature of what the vector
holds there; two vectors within the distance agree in one signature at least.

Words built from the same syllables share whole multisets, so each signature
also carries half of the word: an edit in one half leaves the other half as it
is (a necessary condition, no pair is lost).  Signatures are equi-joined and
every candidate is verified by its edit distance.  The groups are over distinct
words; no word, signature or candidate is capped.

Defined results: null and empty texts hold no words; a null ``doc_id`` counts as
the empty string in the hash; repeated rows count each time; ties between forms
go to the word smallest in code-point order; empty tables give no rows; other
columns are never read.  Words of any length are compared whole.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, as_long, mix, range_hashes, stored

# Words of the query: at least so many code points, so many occurrences, and a
# form is so many times as frequent.
MIN_LENGTH = 7
MIN_COUNT = 2
TIMES = 10
# One run in so many has a letter dropped.
DROP = 31
# Parts of the vector for pairs of equal length (two dimensions differ) and of
# lengths that differ by one (one dimension differs).
PARTS = {2: 4, 1: 3}
# Distinct words that a task counts before it passes them on.
HELD = 200_000
# How a row of the signature table takes part: as one of equal words, as the
# shorter or as the longer word.
EQUAL, SHORTER, LONGER = 0, 1, 2

# CRC-32's byte table: the sum of one byte i is ~(table[i ^ 0xFF] ^ 0x00FFFFFF).
_TABLE = ~np.array([zlib.crc32(bytes([i ^ 0xFF])) for i in range(256)], dtype=np.uint32) ^ np.uint32(0x00FFFFFF)


def crc_of_ranges(crc: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``b[start:end]`` continued from ``crc``, for all ranges at once."""
    c = ~crc.astype(np.uint32)
    length = end - start
    order = np.argsort(-length, kind="stable")
    c, at = c[order], start[order]
    left = length[order]
    k, n = 0, len(order)
    while n:
        n = int(np.searchsorted(-left[:n], -k, side="left"))
        if not n:
            break
        c[:n] = _TABLE[(c[:n] ^ b[at[:n] + k]) & np.uint32(0xFF)] ^ (c[:n] >> np.uint32(8))
        k += 1
    out = np.empty_like(c)
    out[order] = ~c
    return out


def _runs(b: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal letter runs of UTF-8 bytes; ``cut``: text bounds."""
    low = b | np.uint8(32)
    lead = b == 0xC3  # the first byte of U+00C0 to U+00FF and of nothing else
    letter = ((low >= 97) & (low <= 122)) | lead
    letter[1:] |= lead[:-1]
    head = letter.copy()
    head[1:] &= ~letter[:-1]
    edge = cut[(cut > 0) & (cut < len(b))]
    head[edge] |= letter[edge]
    tail = letter.copy()
    tail[:-1] &= ~letter[1:]
    tail[edge - 1] |= letter[edge - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def _gathered(b: np.ndarray, start: np.ndarray, end: np.ndarray, drop_at: np.ndarray | None = None,
              drop_to: np.ndarray | None = None) -> pa.Array:
    """The byte ranges as strings, without the bytes ``drop_at:drop_to`` of each."""
    length = end - start
    off = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=off[1:])
    at = np.repeat(start - off[:-1], length) + np.arange(off[-1])
    data = b[at]
    if drop_at is not None:
        gone = (at >= np.repeat(drop_at, length)) & (at < np.repeat(drop_to, length))
        data = data[~gone]
        off[1:] = np.cumsum(length - (drop_to - drop_at))
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(data.tobytes()))


def words_of(ids: list, texts: pa.Array, min_length: int) -> Iterator[pa.Array]:
    """Words (of ``min_length`` code points or more) of the texts, every
    occurrence; runs of about ``STEP_BYTES``, a text is never split."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off_buf, data_buf = texts.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.empty(0, np.uint8)
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    i = 0
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + STEP_BYTES, side="right")) - 1, i + 1), n)
        b = data[off[i]:off[j]]
        cut = off[i:j + 1] - off[i]
        b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
        start, end = _runs(b, cut)
        keep = end - start >= min_length  # in bytes: never fewer than code points
        start, end = start[keep], end[keep]
        if len(start):
            begins = (b & 0xC0) != 0x80
            points = np.concatenate(([0], np.cumsum(begins)))  # code points before a byte
            length = points[end] - points[start]
            doc = i + np.searchsorted(cut, start, side="right") - 1
            h = crc_of_ranges(seeds[doc], b, start, end)
            hit = h % DROP == 0
            plain = ~hit & (length >= min_length)
            if plain.any():
                yield _gathered(b, start[plain], end[plain])
            hit &= length > min_length  # one code point fewer is left
            if hit.any():
                place = np.append(np.flatnonzero(begins), len(b))
                p = points[start[hit]] + (h[hit].astype(np.int64) % length[hit])
                yield _gathered(b, start[hit], end[hit], place[p], place[p + 1])
        i = j


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, key: str = "doc_id") -> DataFrame:
    """(word, n): occurrences of every word over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for words in words_of(batch.column(0).to_pylist(), batch.column(1), min_length):
                v = pc.value_counts(words)
                held.append(pa.table({"word": v.field(0).cast(pa.string()), "n": v.field(1)}))
                size += len(v)
                if size > 4 * HELD:
                    held = [merged()]
                    size = len(held[0])
                    if size > HELD:
                        yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                        held, size = [], 0
        if held:
            yield from merged().combine_chunks().to_batches(max_chunksize=50_000)

    part = docs.select(F.col(key).cast("string").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        count, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def _vectors(points: np.ndarray, first: np.ndarray, parts: int) -> np.ndarray:
    """What each word's vector holds in each part, as one hash per part (a sum,
    so the order of letters does not matter).  ``points``: all code points,
    word ``i`` at ``first[i]:first[i + 1]``."""
    length = np.diff(first)
    word = np.repeat(np.arange(len(length)), length)
    order = np.lexsort((points, word))
    p, w = points[order], word[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1])
    group = np.flatnonzero(new)
    repeat = np.arange(len(p)) - np.repeat(group, np.diff(np.append(group, len(p))))
    dim = mix((p.astype(np.uint64) << np.uint64(32)) + repeat.astype(np.uint64) + np.uint64(1))
    of = (dim >> np.uint64(40)) % np.uint64(parts)
    out = np.zeros((parts, len(length)), dtype=np.uint64)
    for k in range(parts):
        h = np.where(of == k, dim, np.uint64(0))
        out[k] = np.add.reduceat(h, first[:-1]) if len(h) else 0
    return out


def signatures(words: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """(signature of every word, how it takes part) for each signature."""
    text = words.to_pylist()
    size = np.array([len(w) for w in text], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    points = np.frombuffer("".join(text).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    held = {d: _vectors(points, first, PARTS[d]) for d in PARTS}

    def enumerated(distance: int, shorter: np.ndarray, role: int) -> Iterator[tuple[np.ndarray, int]]:
        # the half that the edit leaves alone, by the length of the shorter word
        half = shorter // 2
        for side, (a, z) in enumerate((((first[:-1]), first[:-1] + half), (first[1:] - half, first[1:]))):
            anchor = range_hashes(points, a, z) + mix(shorter.astype(np.uint64) * np.uint64(4) + np.uint64(2 * (distance - 1) + side))
            for number, chosen in enumerate(itertools.combinations(range(PARTS[distance]), PARTS[distance] - distance)):
                got = anchor * np.uint64(2 * number + 3)
                for k in chosen:
                    got = mix(got + held[distance][k])
                yield got, role

    yield from enumerated(2, size, EQUAL)
    yield from enumerated(1, size, SHORTER)
    yield from enumerated(1, size - 1, LONGER)


def signature_rows(words: DataFrame) -> DataFrame:
    """(sig, role, word, n): every signature of every word."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for sig, role in signatures(b.column(0)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_long(sig)), pa.array(np.full(len(sig), role, np.int8)), b.column(0), b.column(1)],
                        ["sig", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(build, "sig long, role byte, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): distinct words one edit apart, both ways."""
    rows = signature_rows(words)
    a = rows.where(F.col("role") != LONGER).select("sig", *[F.col(c).alias("a_" + c) for c in ("role", "word", "n")])
    b = rows.where(F.col("role") != SHORTER).select("sig", *[F.col(c).alias("b_" + c) for c in ("role", "word", "n")])
    meets = (((F.col("a_role") == EQUAL) & (F.col("b_role") == EQUAL) & (F.col("a_word") < F.col("b_word")))
             | ((F.col("a_role") == SHORTER) & (F.col("b_role") == LONGER)))
    one = F.levenshtein("a_word", "b_word", 1) == 1
    found = a.join(b, "sig").where(meets & one).select("a_word", "a_n", "b_word", "b_n").distinct()
    both = F.array(F.struct(F.col("a_word").alias("word"), F.col("a_n").alias("n"), F.col("b_word").alias("other"), F.col("b_n").alias("other_n")),
                   F.struct(F.col("b_word").alias("word"), F.col("b_n").alias("n"), F.col("a_word").alias("other"), F.col("a_n").alias("other_n")))
    return found.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain word -> form -> form's form ...  Each
    step is ``TIMES`` as frequent, so chains are short and never loop; every
    round doubles the reach of all chains and is written out."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(at.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        at = after.select("word", "root")


def group_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                   times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts."""
    words = stored(word_counts(docs, min_length).where(F.col("n") >= min_count), "spelling-words")
    # a word has at most a few thousand words one edit away, so groups are small
    near = near_pairs(words).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other"))).alias("best"))
    enough = -F.col("best.rank") >= F.col("n") * times
    near = stored(near.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"),
                              F.when(enough, -F.col("best.rank")).alias("form_n")), "spelling-near")
    last = roots(near.where(F.col("form").isNotNull()))
    return words.join(near, "word", "left").join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
