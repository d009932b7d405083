"""The prefix trie against a plain-Python version."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gazette.llm import turntrie
from gazette.llm.common import prepare


def brute(rows):
    """One tuple per node; rows: (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, turntrie_digest(role, text), role or "", text or ""))
    convs = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        block = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(block, [])[:h] + own[h:])
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    children = {p: 0 for p in members}
    leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turntrie_digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def result(spark, rows, **options):
    prepare(spark)
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'k' as key", "1 as depth", "2 as turns")
    out = turntrie.prefix_nodes(convs, **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_findclose_against_a_stack():
    rng = random.Random(1)
    for n in (1, 2, 3, 40, 700, 5000):
        steps, open_ = [1], 1
        for _ in range(n):
            s = 1 if open_ == 1 or rng.random() < 0.52 else -1
            steps.append(s)
            open_ += s
        steps += [-1] * open_
        want, stack = {}, []
        for i, s in enumerate(steps):
            if s == 1:
                stack.append(i)
            else:
                want[stack.pop()] = i
        tree = turntrie.Parentheses(np.array(steps, dtype=np.int8))
        assert dict(zip(tree.opens.tolist(), tree.findclose(tree.opens).tolist())) == want


def test_range_minima():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1000, 100)
    start = rng.integers(0, 99, 300)
    end = np.minimum(start + rng.integers(1, 100, 300), 100)
    assert turntrie._range_minima(v, start, end).tolist() == [int(v[a:b].min()) for a, b in zip(start, end)]


@pytest.mark.parametrize("shard_turns", [90])
def test_whole_table(spark, shard_turns):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in conv.collect()]
    assert result(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_query_on_table(spark):
    from gazette.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_prefix_trie"](spark, sf).collect()), key=str) == brute(rows)


def random_rows(n, seed):
    """Few distinct turns, so paths of every kind repeat and extend one another."""
    rng = random.Random(seed)
    out = []
    for c in range(n):
        start = rng.randrange(3)
        for t in range(rng.randint(1, 9)):
            out.append((c * 7 % 1000 if c % 5 else c * 100, t, "user" if t % 2 else "bot", "ab"[(start + t) % 2] * rng.randint(0, 2)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shard_turns", [5, 60])
def test_shared_spines(spark, shard_turns):
    """Many shards, most of them with paths in common with their neighbours."""
    rows = random_rows(150, 4)
    assert result(spark, rows, shard_turns=shard_turns) == brute(rows)


@pytest.mark.parametrize("shard_turns", [3, 10_000])
def test_copies_over_many_shards(spark, shard_turns):
    """A conversation that most ids repeat, some extended, some cut short."""
    rows = []
    for c in range(0, 20_000, 200):
        for t in range(7 + (c % 1200 == 0) - (c % 1000 == 0)):
            rows.append((c, t, "user", f"turn {t} of all"))
    assert result(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "no block"), (205, 0, None, None), (205, None, "user", "first"), (205, None, "user", "first"),
            (205, 1, "bot", ""), (200, 5, "user", "é𝄞"), (200, 5, "user", "é𝄞"), (200, 7, "", "x"), (None, 0, "user", "lost"),
            (300, 0, "user", "y" * 200_000), (301, 0, "user", "y" * 200_000), (301, 1, "", "z"), (-5, 0, "a", "b"), (-105, 1, "a", "b"),
            (-100, 0, "user", "minus")]
    for shard_turns in (1, 1000):
        assert result(spark, rows, shard_turns=shard_turns) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "a", "b")], [(1, 0, "a", "b")]])
def test_next_to_nothing(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_deep_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in (100, 200) for t in range(3000 + c)]
    got = result(spark, rows, shard_turns=2000)
    assert len(got) == 3201 and max(r[1] for r in got) == 3200
    assert {r[3] for r in got if r[1] <= 3100} == {2} and {r[3] for r in got if r[1] > 3100} == {1}
