"""Near duplicates by SimHash fingerprints, joined over Golay-code keys.

A fingerprint has a bit for each bit position that is set in over half of the
hashes of a text's word shingles.  Fingerprints link at ``BITS`` or fewer
differing bits.  The 64 bits fall into three segments of at most 23 bits, which
the perfect binary Golay code [23, 12] covers with balls of radius three.  A
segment's *own* codeword is the one that it decodes to; its *near* codewords are
all within four bits (its own alone, or six if its own is three bits away).  If two
segments differ in at most one bit, the own codeword of either is a near one of
the other.

Three errors over three segments leave two cases (pigeonhole):

* some segment has none: then another has at most one.  Keys: the equal segment
  whole with each near codeword of the other, for each ordered choice;
* each has exactly one.  Keys: a codeword of each segment (near ones of the first
  for the side whose parities are flipped, near ones of the others for the other).

About 65 keys of 33 bits or more for each distinct fingerprint.  All fingerprints
of a key are compared in the task that holds the key, and only a spanning forest
of their links is passed on, so a group of near copies gives rows in proportion
to its size.  A key of more than ``LARGE`` fingerprints is not held in one task:
its fingerprints are linked through shared neighbours one bit away (two bits for
those outside the largest component), which finds every link of three bits
without comparing pairs.

Defined results: null and blank texts have fingerprint zero and are linked like
any other; repeated rows keep one row each; rows that share a ``doc_id`` count
as linked; a null ``doc_id`` never names a component (null if there is no other);
empty tables give no rows; other columns are never read.  Texts are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, as_long, mix, stored
from .nearup import components

WIDTH = 3
BITS = 3
SEED = 42
# Segments of the fingerprint: (lowest bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fingerprints of one key that a task compares with one another.
LARGE = 8192
# Shingles whose bits are counted in one numpy step.
COUNTED = 1 << 16
# Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    r = words.astype(np.uint32)
    for k in range(22, 10, -1):
        r = np.where((r >> np.uint32(k)) & np.uint32(1), r ^ np.uint32(GENERATOR << (k - 11)), r)
    return r


def _errors() -> np.ndarray:
    """Error patterns of weight four or less for each syndrome, the least first
    (the code is perfect, so one of weight three or less is always there);
    the first one repeated where there are fewer than six."""
    single = [1 << k for k in range(23)]
    patterns = [sum(c) for w in range(5) for c in itertools.combinations(single, w)]
    of: dict[int, list[int]] = {}
    for s, e in zip(_syndromes(np.array(patterns)).tolist(), patterns):
        of.setdefault(s, []).append(e)
    return np.array([(of[s] + [of[s][0]] * 6)[:6] for s in range(1 << 11)], dtype=np.uint32)


ERRORS = _errors()


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within four bits of each segment, one
    row per segment: its own first, repeated where there are fewer than six."""
    x = segment.astype(np.uint32)
    return ((x[:, None] ^ ERRORS[_syndromes(x)]) >> np.uint32(11)).astype(np.uint64)


def keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their keys) of 64-bit fingerprints, one pair of arrays at a time."""
    every = np.arange(len(prints))
    seg = [(prints >> np.uint64(low)) & np.uint64((1 << size) - 1) for low, size in SEGMENTS]
    code = [codewords(s) for s in seg]
    six = [c[:, 1] != c[:, 0] for c in code]

    def marked(s: int, c: np.ndarray) -> np.ndarray:
        return mix(c + np.uint64((s + 1) << 20))

    def with_near(segments: list[int], base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for chosen in itertools.product(range(6), repeat=len(segments)):
            rows = every
            for s, k in zip(segments, chosen):
                rows = rows[six[s][rows]] if k else rows
            if len(rows):
                yield rows, mix(base[rows] + sum(marked(s, code[s][rows, k]) for s, k in zip(segments, chosen)))

    for kind, (i, j) in enumerate(itertools.permutations(range(3), 2)):
        yield from with_near([j], mix((seg[i] << np.uint64(3)) + np.uint64(kind + 1)))
    parity = sum((np.bitwise_count(seg[s]).astype(np.uint64) & np.uint64(1)) << np.uint64(s) for s in range(3))
    own = [marked(s, code[s][:, 0]) for s in range(3)]
    yield from with_near([0], mix((parity ^ np.uint64(7)) + np.uint64(1 << 60)) + own[1] + own[2])
    yield from with_near([1, 2], mix(parity + np.uint64(1 << 60)) + own[0])


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Fingerprint of each text (null: zero)."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    _, off_buf, data_buf = texts.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.empty(0, np.uint8)
    digest = xxhash.xxh64_intdigest
    i = 0
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + STEP_BYTES, side="right")) - 1, i + 1), n)
        b, cut = data[off[i]:off[j]], off[i:j + 1] - off[i]
        b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
        word = (b != 32) & ((b < 9) | (b > 13))
        head, tail = word.copy(), word.copy()
        head[1:] &= ~word[:-1]
        tail[:-1] &= ~word[1:]
        edge = cut[(cut > 0) & (cut < len(b))]
        head[edge] |= word[edge]
        tail[edge - 1] |= word[edge - 1]
        # the text with one blank for each gap
        kept = word.copy()
        kept[1:] |= word[:-1]
        line = np.where(word, b, np.uint8(32))[kept].tobytes()
        place = np.concatenate(([0], np.cumsum(kept)))
        at, to = np.flatnonzero(head), np.flatnonzero(tail)
        first = np.searchsorted(at, cut)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        last = first[1:][doc] - 1  # the document's last word
        k = np.arange(len(at))
        k = k[(k + WIDTH - 1 <= last) | (k == first[:-1][doc])]
        start, end, doc = place[at[k]], place[to[np.minimum(k + WIDTH - 1, last[k])]] + 1, doc[k]
        ones, total = np.zeros((j - i, 64), dtype=np.int64), np.bincount(doc, minlength=j - i)
        for c in range(0, len(k), COUNTED):
            s, e, d = start[c:c + COUNTED].tolist(), end[c:c + COUNTED].tolist(), doc[c:c + COUNTED]
            h = np.fromiter((digest(line[x:y], SEED) for x, y in zip(s, e)), dtype=np.uint64, count=len(s))
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            new = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            ones[d[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
        bits = (2 * ones > total[:, None]).astype(np.uint8)
        out[i:j] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        i = j
    return out


def printed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_long(fingerprints(b.column(1))))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        build, "doc_id long, fp long")


def key_rows(classes: DataFrame) -> DataFrame:
    """(key, fp): every key of every distinct fingerprint."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for rows, key in keys(fp) if len(fp) else ():
                yield pa.RecordBatch.from_arrays([pa.array(as_long(key)), pa.array(as_long(fp[rows]))], ["key", "fp"])

    return classes.select("fp").mapInArrow(build, "key long, fp long")


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of ``fps`` that chains of ``BITS`` bits connect."""
    a, b = [], []
    while len(fps) > 1:
        open_, fps = [fps[0]], fps[1:]
        while open_ and len(fps):
            f = open_.pop()
            close = np.bitwise_count(fps ^ f) <= BITS
            if close.any():
                found = fps[close]
                a.append(np.full(len(found), f, dtype=np.uint64))
                b.append(found)
                open_.extend(found)
                fps = fps[~close]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def linked(rows: DataFrame, large: int) -> DataFrame:
    """(a, b): links among the fingerprints of each key; (a, null) for each
    fingerprint of a key of more than ``large``.  ``rows`` are sorted by key within
    partitions that hold whole keys; at most one key is held at a time."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(a, b=None):
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(as_long(b))
            return pa.RecordBatch.from_arrays([pa.array(as_long(a)), b], ["a", "b"])

        held, held_key, over = np.empty(0, np.uint64), None, False
        for part in batches:
            key = part.column(0).to_numpy()
            fp = part.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            if held_key is not None:
                key = np.concatenate((np.full(len(held), held_key), key))
                fp = np.concatenate((held, fp))
            bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            if over and key[0] != held_key:
                over = False
            size = np.diff(bounds)
            if over or size[0] > large:  # the first key is a large one: nothing of it is held
                yield batch(fp[:bounds[1]])
                over = len(size) == 1
                first = 1
            else:
                first = 0
            done = len(size) - 1
            two = np.flatnonzero(size[first:done] == 2) + first
            x, y = fp[bounds[two]], fp[bounds[two] + 1]
            near = np.bitwise_count(x ^ y) <= BITS
            links = [(x[near], y[near])]
            for g in np.flatnonzero(size[first:done] > 2) + first:
                group = fp[bounds[g]:bounds[g + 1]]
                if len(group) > large:
                    yield batch(group)
                else:
                    links.append(forest(np.unique(group)))
            a, b = (np.concatenate(x) for x in zip(*links))
            if len(a):
                yield batch(a, b)
            held_key = key[-1]
            held = fp[bounds[-2]:] if not over else fp[:0]
            if not over and len(held) > large:
                yield batch(held)
                held, over = fp[:0], True
        if len(held) > 1:
            a, b = forest(np.unique(held))
            if len(a):
                yield batch(a, b)

    return rows.mapInArrow(build, "a long, b long")


def _around(fps: DataFrame, bits: int) -> DataFrame:
    """(z, fp): every word within ``bits`` (one or two) of each fingerprint."""
    one = "transform(sequence(0, 63), k -> shiftleft(1L, k))"
    two = ("flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), "
           "j -> shiftleft(1L, i) ^ shiftleft(1L, j))))")
    masks = F.expr(f"concat(array(0L), {one}" + (f", {two})" if bits == 2 else ")"))
    return fps.select("fp", F.explode(masks).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("z"), "fp")


def large_links(fps: DataFrame, known: DataFrame) -> DataFrame:
    """Links that connect ``fps`` (fp) as chains of three bits do, given the links
    ``known``: all words one bit away name the least fingerprint there as their
    centre; whoever is one bit from a word is at most two from its centre, and
    whoever is two bits from it is at most three from the centre."""
    around = _around(fps, 1)
    centre = around.groupBy("z").agg(F.min("fp").alias("centre"))
    by_one = stored(around.join(centre, "z").where("fp != centre")
                    .select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct(), "simhash-large")
    label = stored(fps.join(components(known.unionByName(by_one)), F.col("fp") == F.col("id"), "left")
                   .select("fp", F.coalesce("label", "fp").alias("label")), "simhash-large")
    most = label.groupBy("label").count().agg(F.max(F.struct("count", "label")).alias("most")).select("most.label")
    outside = label.join(most, "label", "left_anti").select("fp")
    by_two = (_around(outside, 2).join(centre, "z").where("fp != centre")
              .select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct())
    return by_one.unionByName(by_two)


def link(docs: DataFrame, large: int = LARGE, key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    rows = stored(printed(docs, key), "simhash-prints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    dealt = key_rows(classes).repartition("key").sortWithinPartitions("key")
    found = stored(linked(dealt, large).distinct(), "simhash-links")
    links = found.where(F.col("b").isNotNull())
    fps = stored(found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct(), "simhash-hot")
    if not fps.isEmpty():
        links = links.unionByName(large_links(fps, links))
    # rows of one document are one
    named = rows.where(F.col("doc_id").isNotNull())
    several = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a != most")
    same = named.join(several, "doc_id").where("fp != a").select("a", F.col("fp").alias("b"))
    label = components(links.unionByName(same))
    component = stored(classes.join(label, F.col("fp") == F.col("id"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    least = component.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = component.join(least, "label").select("fp", "component_id")
    return rows.join(of_print, "fp").select(
        F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
