"""Prefix trie of conversations, as balanced parentheses per shard.

Conversations are rebuilt, sorted by their turns (a prefix before what extends
it, then by id) and dealt to shards by range.  A shard writes its trie as a
parenthesis sequence: consecutive conversations close the turns they don't share
and open those that are new.  On that sequence

* ``findclose`` delimits a node's subtree: the first place after the node where
  the excess falls below the node's, found through a tree of block minima of the
  excess;
* ``rank`` of ``()`` pairs up to both ends counts the leaves in between;
* cumulative arrays over the nodes in order give subtree sums (savings).

Neighbouring shards share the path (spine) that the last conversation of one and
the first of the next have in common.  Only nodes on a shard's first or last path
can be shared; they carry a key (a digest of their turns) and are merged by sums.
What a shared path makes two shards count twice is taken off per boundary: the
text of every shared node once, the child that leads on, and a leaf that the next
shard holds too.

Turns travel as digests and lengths, never as texts.  A conversation's digests are
one row (20 bytes a turn); a shard holds the trie of its own conversations, and
shards are dealt by (turns, id), so a conversation that thousands repeat is spread
over shards.  The ids of conversations that end at a shared node are digested as a
stream, in chunks.

Defined results: a null role or text is empty, a null ``turn`` comes first, ties
of ``turn`` are ordered by their digests (repeated rows are turns of their own); rows without a ``conv_id`` belong to no conversation and are left out; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Bytes of a turn's digest.
DIGEST = 16
# Turns of a shard (its trie's nodes) that sharding aims at.
SHARD_TURNS = 100_000
# A conversation shares up to so many turns with the first of its block of ids.
BLOCK, SHARED = 100, 6
# Parentheses of a block of the tree of minima, and blocks of a higher one.
FAN = 16
# Ids of one chunk of a shared node's members.
CHUNK = 20_000

NODE = ("shard int, node int, parent int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, on_first boolean, on_last boolean, "
        "length long, along long, chunk int, ids string")


EMPTY_SHA = hashlib.sha256().hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digest and code
    points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 2 * DIGEST))
    one = F.struct(F.col("turn"), digest.alias("digest"), F.length(text).cast("int").alias("n"))
    return (rows.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation (conv_id, digests, lengths) with its first turns taken
    from the first conversation of its block, as many as the hash of its id says."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    heads = convs.where(F.col("conv_id") % BLOCK == 0).select(
        F.col("conv_id").alias("block"), F.slice("turns", 1, SHARED - 1).alias("head"))
    own = F.slice("turns", h + 1, F.size("turns"))
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    both = (convs.withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "block", "left")
            .select("conv_id", F.concat(head, own).alias("turns")))
    return both.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.n").alias("lengths"))


class Parentheses:
    """A balanced sequence (+1 opens, -1 closes) with block minima of its excess."""

    def __init__(self, steps: np.ndarray):
        self.opens = np.flatnonzero(steps == 1)
        self.excess = np.cumsum(steps, dtype=np.int64)
        pairs = np.append((steps[:-1] == 1) & (steps[1:] == -1), False)
        self._leaves = np.concatenate(([0], np.cumsum(pairs)))
        self._minima = [self.excess]
        while len(self._minima[-1]) > 1:
            low = self._minima[-1]
            padded = np.full(-(-len(low) // FAN) * FAN, np.iinfo(np.int64).max)
            padded[:len(low)] = low
            self._minima.append(padded.reshape(-1, FAN).min(axis=1))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The place that closes each opening place ``at``."""
        target = self.excess[at] - 1
        found_at, found_level = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        query, p = np.arange(len(at)), at + 1
        for level, low in enumerate(self._minima):  # up: the first block that falls so low
            up_query, up_p = [], []
            while len(query):
                hit = low[np.minimum(p, len(low) - 1)] <= target[query]
                found_at[query[hit]], found_level[query[hit]] = p[hit], level
                query, p = query[~hit], p[~hit] + 1
                leaves = p % FAN == 0
                up_query.append(query[leaves])
                up_p.append(p[leaves] // FAN)
                query, p = query[~leaves], p[~leaves]
            query = np.concatenate(up_query) if up_query else query
            p = np.concatenate(up_p) if up_p else p
            if not len(query):
                break
        for level in range(int(found_level.max(initial=0)), 0, -1):  # down: the place in it
            low = self._minima[level - 1]
            query = np.flatnonzero(found_level == level)
            found_level[query] = level - 1
            p = found_at[query] * FAN
            while len(query):
                hit = low[p] <= target[query]
                found_at[query[hit]] = p[hit]
                query, p = query[~hit], p[~hit] + 1
        return found_at

    def leaves(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``()`` pairs that begin in ``start:end``."""
        return self._leaves[end] - self._leaves[start]


def _shared_turns(depth: np.ndarray, first: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Turns that each conversation begins with like the one before it."""
    out = np.zeros(len(depth), dtype=np.int64)
    most = np.minimum(depth[1:], depth[:-1])
    k = np.flatnonzero(most) + 1
    if len(k):
        m = most[k - 1]
        start = np.cumsum(m) - m
        place = np.arange(m.sum()) - np.repeat(start, m)
        a, b = np.repeat(first[k - 1], m) + place, np.repeat(first[k], m) + place
        same = (digest[a] == digest[b]).all(axis=1)
        out[k] = np.minimum.reduceat(np.where(same, np.repeat(m, m), place), start)
    return out


def _range_minima(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of ``values[start:end]`` for each range (none is empty)."""
    out = np.empty(len(start), dtype=values.dtype)
    power = np.frexp((end - start).astype(float))[1] - 1
    low = values
    for t in range(int(power.max(initial=0)) + 1):
        q = np.flatnonzero(power == t)
        out[q] = np.minimum(low[start[q]], low[end[q] - (1 << t)])
        if len(low) > 1 << t:
            low = np.minimum(low[:-(1 << t)], low[1 << t:])
    return out


def shard_nodes(shard: int, conv: np.ndarray, depth: np.ndarray, digest: np.ndarray, length: np.ndarray) -> pa.Table:
    """All nodes of a shard's trie.  Conversations are sorted by turns, then id;
    ``digest`` and ``length`` hold all of their turns in a row."""
    first = np.cumsum(depth) - depth
    shared = _shared_turns(depth, first, digest)
    new = depth - shared
    counts = np.empty(2 * len(conv) + 1, dtype=np.int64)  # closed, opened, closed, ..., closed
    counts[0], counts[1::2], counts[2:-1:2], counts[-1] = 0, new, depth[:-1] - shared[1:], depth[-1]
    steps = np.repeat(np.where(np.arange(len(counts)) % 2, 1, -1).astype(np.int8), counts)
    tree = Parentheses(np.concatenate(([1], steps, [-1])).astype(np.int8))
    close = tree.findclose(tree.opens)

    n = len(tree.opens)
    node = np.arange(n)
    level = tree.excess[tree.opens] - 1
    turn = np.repeat(first + shared - (np.cumsum(new) - new), new) + np.arange(n - 1)  # where a node's turn is
    size = np.concatenate(([0], length[turn]))
    after = node + (close - tree.opens + 1) // 2  # the first node outside the subtree
    by_level = np.argsort(level, kind="stable")
    ranked = level[by_level] * n + by_level
    parent = by_level[np.searchsorted(ranked, (level - 1) * n + node) - 1]
    parent[0] = -1

    ends = np.maximum.accumulate(np.where(new > 0, np.cumsum(new), 0))  # the node a conversation ends at
    members, to = np.searchsorted(ends, node), np.searchsorted(ends, after)
    own_to = np.searchsorted(ends, node, side="right")
    least = _range_minima(conv, members, to)
    saving = np.concatenate(([0], np.cumsum((to - members - 1) * size)))

    on_first, on_last = np.zeros(n, bool), np.zeros(n, bool)
    on_first[:depth[0] + 1] = True
    path = [int(ends[-1])]
    while path[-1] > 0:
        path.append(int(parent[path[-1]]))
    on_last[path] = True
    keys: list = [None] * n
    along = np.zeros(n, dtype=np.int64)
    for spine in (range(int(depth[0]) + 1), reversed(path)):
        running, total = hashlib.sha256(), 0
        for v in spine:
            if v:
                running.update(digest[turn[v - 1]].tobytes())
                total += int(size[v])
            keys[v], along[v] = running.digest()[:DIGEST], total
    spine = on_first | on_last

    sha: list = [EMPTY_SHA] * n
    more: list[tuple[int, int, str]] = []
    for v in np.flatnonzero(own_to > members).tolist():
        ids = conv[members[v]:own_to[v]].tolist()
        if spine[v]:
            more += [(v, k, ",".join(map(str, ids[c:c + CHUNK]))) for k, c in enumerate(range(0, len(ids), CHUNK))]
        else:
            sha[v] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    up = np.where(parent >= 0, parent, 0)
    inner = ~spine & ~spine[up]
    table = pa.table({
        "shard": np.full(n, shard, np.int32), "node": node.astype(np.int32), "parent": parent.astype(np.int32), "depth": level,
        "conv_id": least, "parent_conv_id": pa.array(least[up], mask=~inner), "n_convs": to - members,
        "n_children": np.bincount(parent[1:], minlength=n).astype(np.int64), "n_leaves": tree.leaves(tree.opens, close),
        "saved_tokens": saving[after] - saving[node], "ends_sha256": pa.array(sha, pa.string(), mask=spine),
        "key": pa.array(keys, pa.binary()), "parent_key": pa.array([keys[p] if s and p >= 0 else None for s, p in zip(spine, parent.tolist())], pa.binary()),
        "on_first": on_first, "on_last": on_last, "length": size, "along": along,
        "chunk": pa.nulls(n, pa.int32()), "ids": pa.nulls(n, pa.string())})
    if more:
        table = pa.concat_tables([table, pa.table({
            "shard": np.full(len(more), shard, np.int32), "key": pa.array([keys[v] for v, _, _ in more], pa.binary()),
            "chunk": pa.array([k for _, k, _ in more], pa.int32()), "ids": [x for _, _, x in more]})], promote_options="default")
    return table


def shard_tables(convs: DataFrame, shards: int) -> DataFrame:
    """The nodes of every shard (columns ``NODE``)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if parts:
            held = pa.Table.from_batches(parts).combine_chunks()
            digests, lengths = (held.column(c).chunk(0) for c in ("digests", "lengths"))
            depth = np.diff(digests.offsets.to_numpy())
            flat = digests.flatten().cast(pa.binary(DIGEST))
            digest = np.frombuffer(flat.buffers()[1], dtype=np.uint64, count=2 * len(flat), offset=flat.offset * DIGEST).reshape(-1, 2) if len(flat) else np.empty((0, 2), np.uint64)
            yield from shard_nodes(TaskContext.get().partitionId(), held.column("conv_id").to_numpy(), depth.astype(np.int64),
                                   digest, lengths.flatten().to_numpy().astype(np.int64)).to_batches(max_chunksize=20_000)

    dealt = convs.repartitionByRange(shards, "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    return dealt.mapInArrow(build, NODE)


def merged_spines(nodes: DataFrame) -> DataFrame:
    """The nodes that a shard's first or last path holds, each once: sums over the
    shards, less what is counted twice at the boundaries."""
    spine = nodes.where(F.col("key").isNotNull() & F.col("chunk").isNull())
    # one row per shard
    following = spine.where("depth = 0").select("shard", F.lead("shard").over(Window.orderBy("shard")).alias("after"))
    last = spine.where("on_last").select("shard", "key", "depth", "along", "length")
    first = spine.where("on_first").select(F.col("shard").alias("after"), "key")
    common = last.join(following, "shard").join(first, ["after", "key"])
    reach = common.groupBy("shard").agg(F.max("depth").alias("reach"), F.max("along").alias("total"))
    deep = last.groupBy("shard").agg(F.max("depth").alias("deep"))
    twice = common.join(reach, "shard").join(deep, "shard").select(
        "key", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n_convs"),
        F.when(F.col("depth") < F.col("reach"), -1).otherwise(0).cast("long").alias("n_children"),
        F.when(F.col("deep") == F.col("reach"), -1).otherwise(0).cast("long").alias("n_leaves"),
        (F.col("total") - F.col("along") + F.col("length")).alias("saved_tokens"), F.lit(None).cast("binary").alias("parent_key"))
    sums = spine.select(*twice.columns).unionByName(twice).groupBy("key").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    return sums.join(end_digests(nodes), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))


def end_digests(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the shared nodes that conversations end at: their
    chunks of ids, in order, as one stream for each node."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["key", "ends_sha256"])

        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(1)):
                if k != key:
                    if key is not None:
                        yield row()
                    key, running = k, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.as_py().encode())
        if key is not None:
            yield row()

    chunks = nodes.where(F.col("chunk").isNotNull()).select("key", "ids", "shard", "chunk")
    return (chunks.repartition("key").sortWithinPartitions("key", "shard", "chunk").select("key", "ids")
            .mapInArrow(digest, "key binary, ends_sha256 string"))


def prefix_nodes(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    convs = stored(turns(rows), "trie-turns")
    total = convs.agg(F.sum(F.size("turns"))).first()[0] or 0
    nodes = stored(shard_tables(rebuilt(convs), total // shard_turns + 1), "trie-nodes")
    spine = stored(merged_spines(nodes), "trie-spines")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    top = spine.join(above, "parent_key", "left").select(*out)
    inner = nodes.where(F.col("key").isNull())
    # the parent of some is a shared node: its least id is known by now
    held = (nodes.where(F.col("key").isNotNull() & F.col("chunk").isNull()).select("shard", F.col("node").alias("parent"), "key")
            .join(spine.select("key", F.col("conv_id").alias("parent_conv_id")), "key").drop("key"))
    under = inner.where(F.col("parent_conv_id").isNull()).drop("parent_conv_id").join(held, ["shard", "parent"])
    return top.unionByName(under.select(*out)).unionByName(inner.where(F.col("parent_conv_id").isNotNull()).select(*out))
