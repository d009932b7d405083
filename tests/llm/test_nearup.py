"""Near duplicates against brute force, and the edge cases."""

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from gazette.llm import nearup


def brute(rows, width=2, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if not w:
            sets[i] = set()
        elif len(w) < width:
            sets[i] = {tuple(w)}
        else:
            sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def result(df):
    return {r[0]: (r[1], r[2], r[3]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_components_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(nearup.link(docs, width=2)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chain_large_group_and_edges(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[i:i + 150])) for i in range(0, 40, 4)]  # a chain of overlaps
    rows += [(1000 + i, " ".join(base[:100] + [f"x{i}"])) for i in range(60)]  # many near copies
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"),
             (2006, "a " * 5000), (2007, "a a"), (2007, "a a")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    assert result(nearup.link(df, width=2)) == brute(rows)


def test_empty_and_null_ids(spark, empty_docs):
    assert nearup.link(empty_docs).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, "a b c"), (4, "a b c")], "doc_id long, text string")
    got = sorted(map(tuple, nearup.link(df, width=2).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 2, None, True), (5, 2, 4, False), (4, 2, 4, True)], key=str)
    assert sorted((r[0] is None, r[0]) for r in nearup.keep_one(df, width=2).collect() if r[0]) == [(False, 4)]
    assert nearup.keep_one(df, width=2).count() == 3


def test_recall_of_trees_at_the_threshold():
    rng = np.random.default_rng(1)
    depth, trees = nearup.shape(10 ** 7)
    hit = 0
    for _ in range(300):
        u = rng.integers(0, 2 ** 63, 500).astype(np.uint64)
        a, b = u[:450], u[50:]  # intersection 400, union 500
        p, _ = nearup.paths(np.sort(a), depth, trees, 0.8)
        q, _ = nearup.paths(np.sort(b), depth, trees, 0.8)
        hit += bool(np.intersect1d(p, q).size)
    assert hit >= 297


def test_shingles_are_words_not_bytes():
    sets = list(nearup.shingle_sets(pa.array(["a b", "A\tB", "ab", None, "a"]), 2))
    assert (sets[0] == sets[1]).all() and len(sets[3]) == 0 and sets[2] != sets[4]


@pytest.mark.parametrize("swap", [False, True])
def test_rows_of_one_id_with_different_texts(spark, swap):
    """Documents 7 and 8 copy the two texts of document 5: all are one group,
    whichever row of 5 comes first; 6 copies a text that only 9 holds too."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, c), (6, c + " more"), (4, "nothing like it")]
    if swap:
        rows[0], rows[1] = rows[1], rows[0]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[2] for r in nearup.link(df, width=2).collect()}
    assert got == {5: 5, 7: 5, 8: 5, 9: 6, 6: 6, 4: 4}


def copies_around_the_threshold(families=1, of=400):
    """Copies of a text with a tenth of the words replaced, and some families of them
    that agree with each other: many are linked to no other copy."""
    rng = np.random.default_rng(3)
    rows = []
    for f in range(families):
        base = [f"b{f}x{i}" for i in range(150)]
        for k in range(of):
            words = list(base)
            for i in rng.choice(150, rng.integers(1, 16), replace=False):
                words[i] = f"w{rng.integers(0, 500)}"
            rows.append((f * 10_000 + 10 * k, " ".join(words)))
            if k % 40 == 0:  # a closer copy of this copy
                words[rng.integers(0, 150)] = "other"
                rows.append((f * 10_000 + 10 * k + 1, " ".join(words)))
    return rows


def test_copies_outside_their_group_are_not_paired_with_all(spark, monkeypatch):
    rows = copies_around_the_threshold()
    confirmed, seen = nearup._confirmed, []

    def counted(pairs, sets, percent):
        seen.append(pairs.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(nearup, "_confirmed", counted)
    got = result(nearup.link(spark.createDataFrame(rows, "doc_id long, text string"), width=2))
    want = brute(rows)
    assert got == want
    largest = max(Counter(root for _, root, _ in want.values()).values())
    alone = len(want) - largest
    print("alone", alone, "pairs", seen)
    assert alone > 20 and seen[-1] * 5 < alone * len(rows)


@pytest.mark.parametrize("percent", [80, 45])
def test_large_groups_lose_no_link(spark, monkeypatch, percent):
    """Every group is compared by tokens."""
    monkeypatch.setattr(nearup, "FEW", 1)
    rows = copies_around_the_threshold(3, 60) + [(90_000 + i, " ".join(f"w{(i * j) % 90}" for j in range(40))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nearup.link(df, width=2, percent=percent)) == brute(rows, percent=percent)


def test_stars_are_left_alone_and_steps_are_few(spark, monkeypatch):
    """Edges that are stars already take no step; copies of edges change nothing."""
    stored, written = nearup.stored, []

    def counted(df, name):
        written.append(name)
        return stored(df, name)

    monkeypatch.setattr(nearup, "stored", counted)

    def labels(edges):
        return sorted(map(tuple, nearup.components(spark.createDataFrame(edges, "a long, b long")).collect()))

    assert labels([(i, i % 3) for i in range(3, 60)] * 2 + [(7, 7)]) == [(i, i % 3) for i in range(60)]
    assert len(written) == 1
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(400, 440)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert labels(edges) == sorted((x, root(x)) for x in up)
    assert labels([]) == []


def test_token_rows_get_their_counts_without_a_join(spark, monkeypatch):
    by_tokens, plans = nearup._by_tokens, []

    def planned(*args):
        pairs = by_tokens(*args)
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return pairs

    joins = []
    stored = nearup.stored

    def seen(df, name):
        if name == "near-tokens":
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return stored(df, name)

    monkeypatch.setattr(nearup, "_by_tokens", planned)
    monkeypatch.setattr(nearup, "stored", seen)
    nearup.link(spark.createDataFrame(copies_around_the_threshold(1, 60), "doc_id long, text string"), width=2).collect()
    assert joins == [1] and plans[0].count("Join ") == 1
