"""SimHash near duplicates against a plain-Python version."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from gazette.llm import simhash
from gazette.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    """(doc_id, fingerprint, component_id) of every row; equal ids are one node."""
    prints = [print_of(text) for _, text in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    of_id = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            label[top(i)] = top(of_id.setdefault(doc_id, i))
    fps = np.array(prints, dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 3) + i + 1:
            label[top(i)] = top(int(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, f"{prints[i]:016x}", least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def result(spark, rows, **options):
    prepare(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'x' as key", "2 as label")
    out = simhash.link(docs, **options)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_code_is_perfect():
    """Every 23-bit word is within three bits of one codeword; near codewords are
    all those within four bits."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000).astype(np.uint64)
    weight = np.bitwise_count(simhash.ERRORS)
    assert weight[:, 0].max() == 3 and np.all(np.diff(weight.astype(int), axis=1)[weight[:, 0] == 3] >= 0)
    every = np.arange(1 << 12, dtype=np.uint32) << 11
    book = every ^ simhash._syndromes(every)
    assert min(np.bitwise_count(book[1:])) == 7
    for v, got in zip(x[:200], simhash.codewords(x[:200])):
        d = np.bitwise_count(book ^ np.uint32(v))
        assert set(got.tolist()) == set(np.flatnonzero(d <= 4).tolist()) and d[int(got[0])] <= 3


def test_keys_meet_within_three_bits():
    rng = random.Random(2)
    pairs = []
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << k
        pairs.append((x, y))
    # every choice of one bit in each segment for one word as well
    x = rng.getrandbits(64)
    pairs += [(x, x ^ 1 << a ^ 1 << b ^ 1 << c) for a in range(0, 22, 3) for b in range(22, 43, 4) for c in range(43, 64, 4)]
    held = []
    for side in zip(*pairs):
        sets = [set() for _ in pairs]
        for rows, key in simhash.keys(np.array(side, dtype=np.uint64)):
            for i, k in zip(rows.tolist(), key.tolist()):
                sets[i].add(k)
        held.append(sets)
    assert all(a & b for a, b in zip(*held))


def test_fingerprints(docs):
    rows = [r.text for r in docs.select("text").collect()] + ["", None, " \t\n", "one", "Two  words", "three little words\x0b"]
    import pyarrow as pa

    assert simhash.fingerprints(pa.array(rows)).tolist() == [print_of(t) for t in rows]
    tail = pa.array(["skipped", *rows[-8:]]).slice(1)
    assert simhash.fingerprints(tail).tolist() == [print_of(t) for t in rows[-8:]]


def test_query_on_table(spark):
    from gazette.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_simhash_near_dedup"](spark, sf).collect()), key=str)
    assert got == brute(rows)


def near_copies(n, seed):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(900)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(900)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("large", [3, 40])
def test_large_keys(spark, large):
    """Keys beyond the bound of a task are linked exactly as well."""
    rows = near_copies(120, 5) + [(1000 + i, t) for i, t in near_copies(40, 6)] + [(2000, "something else entirely here")]
    assert result(spark, rows, large=large) == brute(rows)


def test_forest_equals_all_pairs():
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(200):
        x = rng.choice(sorted(fps))
        for k in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << k
        fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    a, b = simhash.forest(fps)
    assert np.all(np.bitwise_count(a ^ b) <= 3)

    def parts(pairs):
        label = {int(f): int(f) for f in fps}

        def top(i):
            while label[i] != i:
                i = label[i]
            return i

        for x, y in pairs:
            label[top(x)] = top(y)
        return {frozenset(int(g) for g in fps if top(int(g)) == t) for t in {top(int(f)) for f in fps}}

    want = parts((int(x), int(y)) for x, y in combinations(fps, 2) if np.bitwise_count(x ^ y) <= 3)
    assert parts(zip(a.tolist(), b.tolist())) == want


def test_odd_rows(spark):
    """Blank and null texts have fingerprint zero and are linked; equal ids are
    one document; a null id names no component."""
    a, b = near_copies(1, 7)[0][1], near_copies(1, 8)[0][1]
    rows = [(9, None), (4, ""), (6, " \n"), (None, "\t"), (12, a), (12, a), (5, a), (20, b), (12, b), (18, b), (None, "alone here now"), (30, "Alone HERE now then")]
    got = result(spark, rows)
    assert got == brute(rows)
    by = {(d, f): c for d, f, c in got}
    assert by[(9, "0" * 16)] == 4 and {c for (d, _), c in by.items() if d in (18, 20)} == {5}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None)]])
def test_next_to_nothing(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_very_long_text(spark):
    text = " ".join(f"w{i * i % 7919}" for i in range(120_000))
    rows = [(1, text), (2, text + " w1"), (3, "short")]
    got = {r[0]: r for r in result(spark, rows)}
    assert got[2][2] == 1 and got[3][2] == 3
