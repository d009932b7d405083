"""Near-duplicate documents by chosen-path set similarity join.

A document's set is its distinct word shingles.  Documents with equal sets
form a class; classes are branched recursively: in each node a class picks the
tokens whose hash under that node is below ``1 / (similarity * set size)``, and
every picked token is a child.  Two sets at the threshold share one child on
average, dissimilar ones next to none, so after ``depth`` levels (which grow
with the logarithm of the corpus) nodes hold few but true neighbours.
Independent trees repeat this until the target recall at the threshold is met.

Node contents are compared in rounds.  First each class with the pivot
(least class) of its nodes; links join classes to components.  Next each class
outside its node's largest component with a few members of that one.
Then every pair of classes in a node whose components still differ is
compared: pairs inside one component could only repeat a known connection, so
a node full of copies costs no square.  Nodes with the same largest component
are one group here; classes of a group of more than ``FEW`` meet by tokens
(``_by_tokens``, which loses no pair).  Every candidate passes a coarse test on
minimum hashes and is confirmed on full sets.

``doc_id`` names a document: rows that share it count as one node.  A text
without words has an empty set and no links.  A null ``doc_id`` is never
linked (its component is null, it is kept).  Empty tables give empty results;
extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, distinct, mix, range_hashes, scan_words, stored

WIDTH = 5
SIMILARITY = 0.8
RECALL = 0.9995
# Share of a tree level's picks that two unrelated documents have in common.
CHANCE = 0.01
# Tokens that one numpy step of the branching looks at.
BLOCK = 8192
# Share of the minimum hashes' bits that may differ before sets are compared:
# half of them do for unrelated sets, a tenth at similarity 0.8, where a linked
# pair goes beyond this with probability of about 1e-6 (17 trees).
DIFFERENT = 0.41
# Trees whose minimum hash gives a byte of the 24-byte sketch.
SKETCHED = 24
SKETCH = ["l0", "l1", "l2"]
# Members of a node's largest component that the other classes are compared with
# in a turn, and turns before all pairs across components (a second one linked few
# and cost a pass over the sets).
PIVOTS = 4
TURNS = 1
# Classes of a group up to which they are compared pair by pair, and tasks that a
# large group's classes are dealt over when they meet their hub.
FEW = 16
SALTS = 16


def shape(classes: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(depth, trees) for a corpus of so many classes."""
    depth = max(3, math.ceil(math.log(max(classes, 2)) / math.log(1 / CHANCE)))
    alive = 1.0
    for _ in range(depth):  # a pair at the threshold shares one child on average
        alive = 1 - math.exp(-alive)
    return depth, max(17, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    for run in scan_words(texts, fold_case=True):
        h = run.hashes
        start = np.arange(max(len(h) - width + 1, 0))
        grams = range_hashes(h, start, start + width) if len(start) else h[:0]
        for a, b in zip(run.first[:-1].tolist(), run.first[1:].tolist()):
            if a == b:
                yield h[:0]
            elif b - a < width:
                yield range_hashes(h[a:b], np.array([0]), np.array([b - a]))
            else:
                yield distinct(grams[a:b - width + 1])


def _under(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hash of every token under every seed (multiply-shift; tokens are mixed)."""
    return tokens[None, :] * (seeds | np.uint64(1))[:, None]


def paths(tokens: np.ndarray, depth: int, trees: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(node ids after ``depth`` levels, low byte of each tree's minimum hash)."""
    seeds = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rate = min(1.0, 1 / (similarity * len(tokens)))
    limit = np.uint64(min(int(rate * 2.0 ** 64), 2 ** 64 - 1))
    low = np.full(trees, np.iinfo(np.uint64).max, dtype=np.uint64)
    for level in range(depth):
        found = []
        for k in range(0, len(tokens), BLOCK):
            part = tokens[k:k + BLOCK]
            x = _under(part, seeds)
            if level == 0:
                np.minimum(low, x.min(axis=1), out=low)
            i, j = np.divmod(np.flatnonzero(x.ravel() <= limit), len(part))
            found.append(mix(seeds[i] * np.uint64(0x2545F4914F6CDD1D) + part[j]))
        seeds = distinct(np.concatenate(found))
        if not len(seeds):
            break
    return seeds, mix(low).astype(np.uint8)


def _named(s: np.ndarray) -> tuple[int, int, int]:
    """Size and 128-bit hash of a set."""
    return (len(s), int(s.sum(dtype=np.uint64).view(np.int64)),
            int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))


def described(docs: DataFrame, width: int, similarity: float, depth: int, trees: int) -> DataFrame:
    """doc_id, set size, 128-bit set hash, node ids and the sketch (a byte of
    each tree's minimum hash, as three longs)."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ha, hb, nodes, low = [], [], [], [], []
            for s in shingle_sets(b.column(1), width):
                for to, x in zip((n, ha, hb), _named(s)):
                    to.append(x)
                p, q = paths(s, depth, trees, similarity) if len(s) else (s, np.empty(0, np.uint8))
                nodes.append(as_long(p))
                low.append(np.frombuffer(q[:SKETCHED].tobytes().ljust(SKETCHED, b"\0"), dtype="<i8"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ha, pa.int64()), pa.array(hb, pa.int64()),
                 pa.array(nodes, pa.list_(pa.int64())), *[pa.array([x[k] for x in low], pa.int64()) for k in range(3)]],
                ["doc_id", "n", "ha", "hb", "nodes", *SKETCH])

    return docs.mapInArrow(describe, "doc_id long, n long, ha long, hb long, nodes array<long>, l0 long, l1 long, l2 long")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, size and hash of the set, and the set itself, of every row."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(1), width))
            n, ha, hb = zip(*map(_named, sets)) if sets else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ha, pa.int64()), pa.array(hb, pa.int64()),
                 pa.array([as_long(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "ha", "hb", "items"])

    return docs.mapInArrow(build, "doc_id long, n long, ha long, hb long, items array<long>")


def _different(a: str, b: str):
    """Bits in which two sketches differ (column prefixes)."""
    return sum((F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in SKETCH[1:]),
               F.bit_count(F.col(a + SKETCH[0]).bitwiseXOR(F.col(b + SKETCH[0]))))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    sa = sets.select(F.col("cid").alias("a"), F.col("items").alias("sa"))
    sb = sets.select(F.col("cid").alias("b"), F.col("items").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(sa, "a").join(sb, "b")
            .where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b"))


def _by_hub(groups: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The classes of ``groups`` (g, cid, label, n, sketch) with what sets them apart
    from their group's hub (``hubs``: g, hub): ``items`` is the symmetric difference
    of both sets (``far`` false, for similarities of a half or more) or the own set
    (``far`` true).  By the triangle inequality of the Jaccard distance two linked
    classes are both in the first kind or both in the second; some are in both.
    ``on``: linked to the hub, and so labelled as the group's component."""
    held = (hubs.join(sets, F.col("hub") == F.col("cid")).select("g", "hub", F.col("items").alias("h"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    met = (groups.join(sets, "cid").withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
           .join(held, ["g", "salt"])
           .withColumns({"nh": F.size("h").cast("long"), "both": F.size(F.array_intersect("items", "h")).cast("long")})
           .withColumn("union", F.col("n") + F.col("nh") - F.col("both")))
    on = F.col("both") * 100 >= F.col("union") * percent
    kept = ["g", "hub", "cid", "n", *SKETCH, on.alias("on"), F.when(on, F.col("g")).otherwise(F.col("label")).alias("label")]
    near = met.where("2 * both >= union").select(
        *kept, F.lit(False).alias("far"), "nh", (F.col("union") - F.col("both")).alias("d"),
        F.concat(F.array_except("items", "h"), F.array_except("h", "items")).alias("items"))
    far = met.where(F.col("both") * 100 <= F.col("union") * (150 - percent)).select(
        *kept, F.lit(True).alias("far"), F.lit(0).cast("long").alias("nh"), F.col("n").alias("d"), "items")
    return near.unionByName(far)


def _by_tokens(apart: DataFrame, percent: int, alike) -> DataFrame:
    """Pairs (a, b) of classes of ``apart`` (``_by_hub``) that may be linked and whose
    labels differ, one of them neither linked to the hub nor in its component.

    With sizes n and differences d from the hub, linked classes have at least
    ``((d + d') - (n + n') * less / more) / 2`` items in common, ``less`` and ``more``
    being 100 -+ ``percent``; that is above nothing if one isn't linked to the hub.
    So both hold one of these among the rarest ``d - least + 1`` of their items, and
    beyond the first of them there must be room for the others."""
    less, more = 100 - percent, 100 + percent
    key = ["g", "far", "token"]
    n, d, nh = F.col("n"), F.col("d"), F.col("nh")
    stray = ~F.col("on") & (F.col("label") != F.col("g"))

    def rarest(sign: int):
        """Items to look at, the other class being any (1) or one not linked to the hub (-1)."""
        least = F.greatest(F.lit(1), F.ceil(d - n * less / percent),
                           F.ceil((d * more - (n + nh * sign) * less) / (2 * more)))
        return (d - F.when(F.col("far"), F.ceil(n * percent / 100)).otherwise(least) + 1).cast("int")

    apart = apart.withColumns({"stray": stray, "mine": F.when(stray, rarest(1)).otherwise(0), "theirs": rarest(-1)})
    token = apart.select("g", "far", "cid", F.col("d").cast("int").alias("d"), F.greatest("mine", "theirs").alias("first"),
                         F.explode("items").alias("token"))
    # items that no other class of the group has come first and meet nothing
    often = F.count(F.lit(1)).over(Window.partitionBy(*key))
    member = Window.partitionBy("g", "far", "cid")
    place = F.col("d") - F.count(F.lit(1)).over(member) + F.row_number().over(member.orderBy("c", "token")) - 1
    ranked = (token.withColumn("c", often).where("c > 1").withColumn("i", place).where("i < first").select(*key, "cid", "i")
              .join(apart.drop("items", "on", "hub", "nh"), ["g", "far", "cid"]))
    ranked = stored(ranked, "near-tokens")
    carried = ["cid", "label", "n", "d", "i", *SKETCH]
    a = ranked.where("stray and i < mine").select(*key, *[F.col(c).alias("a_" + c) for c in carried])
    b = ranked.where("i < theirs").select(*key, *[F.col(c).alias("b_" + c) for c in carried], "stray")
    room = F.least(F.col("a_d") - F.col("a_i"), F.col("b_d") - F.col("b_i"))
    return (a.join(b, key)
            .where((F.col("a_label") != F.col("b_label")) & (~F.col("stray") | (F.col("a_cid") < F.col("b_cid")))
                   & (room * (2 * more) >= (F.col("a_d") + F.col("b_d")) * more - (F.col("a_n") + F.col("b_n")) * less)
                   & alike("a_", "b_"))
            .select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")))


def _starred(e: DataFrame) -> bool:
    """Whether ``e`` (u, v, u > v) holds stars around least members only."""
    ends = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    odd = ends.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least < u and least != most")
    return odd.agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(id, label): least id reachable, for every id of ``edges`` (a, b), by
    large-star and small-star steps on stored edge tables until stars are left."""
    e = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "near-edges")
    # copies of an edge are dropped where its ends meet, so a step shuffles once
    least = F.min("v").over(Window.partitionBy("u")).alias("least")
    while not _starred(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.select("u", "v", least).distinct().where("v > u")
        e = large.select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        small = e.select("u", "v", least).distinct()
        e = small.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v"))
        e = stored(e, "near-edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct()


def _as_edges(label: DataFrame) -> DataFrame:
    """Components found so far (id, label) as edges."""
    return label.select(F.col("id").alias("a"), F.col("label").alias("b"))


def link(df: DataFrame, width: int = WIDTH, percent: int = 80, recall: float = RECALL,
         key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), "text")
    similarity = percent / 100
    depth, trees = shape(docs.count(), similarity, recall)
    rows = stored(described(docs, width, similarity, depth, trees), "near-sets")
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # a class is a set; rows of one doc_id may hold different ones
    classes = stored(named.groupBy("n", "ha", "hb").agg(
        F.min("doc_id").alias("rep"), F.first("nodes").alias("nodes"), *[F.first(c).alias(c) for c in SKETCH])
        .withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    known = classes.select("cid", "n", *SKETCH)

    def of(prefix: str) -> DataFrame:
        return known.select(*[F.col(c).alias(prefix + c) for c in known.columns])

    member = classes.select("cid", F.explode("nodes").alias("node"))
    pivots = member.groupBy("node").agg(F.min("cid").alias("pivot"), F.count(F.lit(1)).alias("c"))
    shared = stored(member.join(pivots.where("c > 1"), "node").select("node", "cid", "pivot"), "near-nodes")
    # texts of all classes that share a node, as sets
    wanted = classes.select(F.col("rep").alias("doc_id"), "n", "ha", "hb", "cid").join(shared.select("cid").distinct(), "cid", "left_semi")
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = stored(full_sets(texts, width).join(wanted, ["doc_id", "n", "ha", "hb"]).groupBy("cid").agg(F.first("items").alias("items")), "near-full")
    limit = int(DIFFERENT * 8 * min(trees, SKETCHED))

    def alike(a: str, b: str):
        x, y = F.col(a + "n"), F.col(b + "n")
        return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (_different(a, b) <= limit)

    star = (shared.where("cid != pivot").select(F.col("cid").alias("a_cid"), F.col("pivot").alias("b_cid")).distinct()
            .join(of("a_"), "a_cid").join(of("b_"), "b_cid").where(alike("a_", "b_"))
            .groupBy("a_cid").agg(F.min(F.struct(_different("a_", "b_").alias("d"), F.col("b_cid").alias("b"))).alias("best"))
            .select(F.col("a_cid").alias("a"), F.col("best.b").alias("b")))
    first = stored(_confirmed(star, sets, percent), "near-links")
    links, label = first, components(first)
    for turn in range(TURNS + 1):
        # nodes whose classes aren't connected yet
        labelled = (shared.select("node", "cid").join(label, F.col("cid") == F.col("id"), "left")
                    .select("node", "cid", F.coalesce("label", "cid").alias("label")))
        by_label = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
        mixed = (by_label.groupBy("node").agg(F.max(F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
                 .where("labels > 1").select("node", F.col("most.label").alias("major")))
        open_rows = stored(labelled.join(mixed, "node").join(known, "cid"), "near-open")
        if turn == TURNS:
            break
        # classes outside a node's largest component with a few of its members
        order = F.xxhash64("cid", F.lit(turn))
        few = (open_rows.where("label = major").groupBy("node", F.pmod(order, F.lit(PIVOTS)).alias("slice"))
               .agg(F.min(F.struct(order.alias("order"), *known.columns)).alias("m"))
               .select("node", *[F.col("m." + c).alias("b_" + c) for c in known.columns]))
        outside = open_rows.where("label != major").select("node", *[F.col(c).alias("a_" + c) for c in known.columns])
        best = (outside.join(few, "node").where(alike("a_", "b_")).groupBy("a_cid")
                .agg(F.min(F.struct(_different("a_", "b_").alias("d"), F.col("b_cid").alias("b"))).alias("best"))
                .select(F.col("a_cid").alias("a"), F.col("best.b").alias("b")))
        more = stored(_confirmed(best, sets, percent), "near-links")
        links = links.unionByName(more)
        label = components(_as_edges(label).unionByName(more))

    # every pair across components, nodes with one largest component taken together
    groups = stored(open_rows.select(F.col("major").alias("g"), "label", *known.columns).distinct(), "near-groups")
    size = groups.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    small = groups.join(size.where(F.col("c") <= FEW), "g").drop("c")
    large = groups.join(size.where(F.col("c") > FEW), "g").drop("c")
    # written as (a class outside the largest component, any other)
    strays = small.where(F.col("label") != F.col("g")).select(
        "g", *[F.col(c).alias("a_" + c) for c in known.columns], F.col("label").alias("a_label"))
    others = small.select("g", "label", *[F.col(c).alias("b_" + c) for c in known.columns])
    across = (strays.join(others, "g")
              .where((F.col("label") != F.col("a_label")) & alike("a_", "b_")
                     & ((F.col("label") == F.col("g")) | (F.col("a_cid") < F.col("b_cid"))))
              .select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")))
    # hub: the class of the largest component that most others are linked to
    central = (links.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("c")).join(label, "id")
               .groupBy(F.col("label").alias("g")).agg(F.max(F.struct("c", "id")).alias("most")))
    hubs = (size.where(F.col("c") > FEW).select("g").join(central, "g", "left")
            .select("g", F.coalesce("most.id", "g").alias("hub")))
    apart = stored(_by_hub(large, hubs, sets, percent), "near-apart")
    met = apart.where(F.col("on") & (F.col("cid") != F.col("hub"))).select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()
    across = across.unionByName(_by_tokens(apart, percent, alike)).distinct()
    second = _confirmed(across, sets, percent).unionByName(met)
    # rows that share a doc_id are one document
    of_row = named.join(classes.select("n", "ha", "hb", "cid"), ["n", "ha", "hb"]).select("doc_id", "cid")
    several = of_row.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("most")).where("a != most")
    same = of_row.join(several, "doc_id").where("cid != a").select("a", F.col("cid").alias("b")).distinct()
    label = components(_as_edges(label).unionByName(second).unionByName(same))
    labelled = stored(classes.select("n", "ha", "hb", "rep", "cid").join(label, F.col("cid") == F.col("id"), "left")
                      .select("n", "ha", "hb", "rep", F.coalesce("label", "cid").alias("label")), "near-labels")
    least = labelled.groupBy("label").agg(F.min("rep").alias("component"))
    of_class = labelled.join(least, "label").select("n", "ha", "hb", "component")
    # rows without a set or an id are joined with nothing
    linked = rows.select("doc_id", "n", "ha", "hb").join(of_class, ["n", "ha", "hb"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return linked.select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``df`` with one row of each group of near duplicates (rows that share a
    ``key`` are one document), columns unchanged."""
    linked = link(df.select(key, "text"), key=key, **options)
    kept = linked.where(F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("_kept")).distinct()
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"))
    named = (packed.join(kept, F.col("_row")[key] == F.col("_kept"), "left_semi")
             .groupBy(F.col("_row")[key].alias("_key")).agg(F.first("_row").alias("_row")))
    return (named.select("_row.*").unionByName(df.where(F.col(key).isNull())))
