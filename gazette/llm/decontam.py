"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of ``PASSAGE`` words.  Over the vocabulary of
the benchmark, the TF-IDF rows of all passages (a term counts once in a
passage) and of the benchmark's own passages form a matrix whose leading right
singular vectors come from one randomised pass: each task multiplies its rows
with a fixed random matrix, Spark adds the products per term, and the Nystroem
formula turns the sum into singular vectors, to which the benchmark's own
passages are added.  Products of term vectors with the benchmark's passages are
nonzero for few terms each; these make the postings by which all overlapping
passages are searched.  Candidates hold the weight of ``RETRIEVE`` of a
benchmark passage's words, and a candidate is a leak if a longest common
subsequence covers enough of the item's words; in the band of paraphrases the
item's answer (its last sentence) must be there as well.  Paraphrases whose
words lie scattered over much more than a passage may be missed.

Document statistics cover every passage of every document; only the benchmark,
in blocks of ``BLOCK_PASSAGES`` passages (or one item), and its vocabulary's
vectors are held whole.  Null and blank texts have no passages; items without
words leak nowhere; repeated rows are judged one by one; empty tables give
empty results; extra columns are never read.  Very long texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, scan_words

PASSAGE = 48
STRIDE = 16
RANK = 64
# Least weight of a term, as a share of the largest.
FLOOR = 0.7
# Least share of an item passage's words in a candidate, under LCS_PARAPHRASE so
# that a match may reach over the ends of a passage.
RETRIEVE = 0.5
# Share of the item's words in order: a leak, or a paraphrase to be confirmed
# by this share of the answer.
LCS = 0.75
LCS_PARAPHRASE = 0.55
ANSWER = 0.6
# Item passages of a block, whose space has as many dimensions and RANK more.
BLOCK_PASSAGES = 512
# Products (passage, item passage) that one numpy step adds up.
ACCUMULATED = 1 << 17


class Item:
    """Word hashes of a benchmark item and of its answer (last sentence)."""

    def __init__(self, item_id: int, text: str):
        self.id = item_id
        self.words = _hashes(text)
        parts = [p for p in re.split(r"[.?!\n]+", text) if re.search(r"\w", p)]
        self.answer = _hashes(parts[-1]) if parts else self.words


def _hashes(text: str) -> np.ndarray:
    return np.concatenate([r.hashes for r in scan_words(pa.array([text.lower()]), True, True)])


def _places(pattern: list[int]) -> dict[int, int]:
    """Bit set of the places of each word."""
    at: dict[int, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    return at


def lcs(pattern: list[int], text: list[int], at: dict[int, int] | None = None) -> int:
    """Longest common subsequence, bit-parallel over the pattern (whose
    ``_places`` may be given)."""
    at = _places(pattern) if at is None else at
    full = (1 << len(pattern)) - 1
    v = full
    for w in text:
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


class Vocabulary:
    """Sorted word hashes, found by their leading bits."""

    def __init__(self, words: np.ndarray):
        self.words = words
        bits = max(16, len(words).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        # first word with these leading bits or greater ones
        first = np.searchsorted(words >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.first, self.held = first[:-1], np.diff(first) > 0
        self.most = int(np.diff(first).max())

    def terms(self, run) -> tuple[np.ndarray, np.ndarray]:
        """(positions, term ids) of the run's words that the vocabulary has."""
        if not len(self.words) or not len(run.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lead = run.hashes >> self.shift
        pos = np.flatnonzero(self.held[lead])
        at, h = self.first[lead[pos]], run.hashes[pos]
        for _ in range(self.most - 1):  # words that share their leading bits
            at += (self.words[at] < h) & (at + 1 < len(self.words))
        same = self.words[at] == h
        return pos[same], at[same]


def _blocks(run, size: int):
    """Start word of each block of ``size`` words, and each block's document."""
    starts, owner = [], []
    for i, (a, b) in enumerate(zip(run.first[:-1].tolist(), run.first[1:].tolist())):
        s = np.arange(a, b, size)
        starts.append(s)
        owner.append(np.full(len(s), i))
    return np.concatenate(starts), np.concatenate(owner)


def statistics(docs: DataFrame, vocabulary: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """In how many passages each term is, the number of passages, and N'N omega
    for the matrix N that says which passage has which term."""
    known = docs.sparkSession.sparkContext.broadcast((Vocabulary(vocabulary), omega))
    width = omega.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, om = known.value
        size = len(om)
        out, n, total = np.zeros(om.shape), np.zeros(size, dtype=np.int64), 0
        for b in batches:
            for run in scan_words(b.column(0), True, True):
                starts, _ = _blocks(run, PASSAGE)
                total += len(starts)
                pos, term = v.terms(run)
                if not len(pos):
                    continue
                cell = distinct((np.searchsorted(starts, pos, side="right") - 1) * size + term)
                block, term = np.divmod(cell, size)
                edge = np.append(True, block[1:] != block[:-1])
                z = np.add.reduceat(om[term], np.flatnonzero(edge), axis=0)
                order = np.argsort(term, kind="stable")
                t = term[order]
                first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                out[t[first]] += np.add.reduceat(z[(np.cumsum(edge) - 1)[order]], first, axis=0)
                n[t[first]] += np.diff(np.append(first, len(t)))
        some = np.flatnonzero(n)
        rows = np.vstack([out[some], np.zeros((1, width))])  # the last row is the number of passages
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(n[some], total), pa.int64())] + [
                pa.array(np.ascontiguousarray(rows[:, j])) for j in range(width)],
            ["term", "n"] + [f"y{j}" for j in range(width)])

    schema = "term long, n long, " + ", ".join(f"y{j} double" for j in range(width))
    df, passages, y = np.zeros(len(vocabulary), dtype=np.int64), 0, np.zeros(omega.shape)
    sums = docs.select("text").mapInArrow(multiply, schema).groupBy("term").agg(
        *[F.sum(c).alias(c) for c in ["n"] + [f"y{j}" for j in range(width)]])
    for r in sums.collect():
        if r[0] < 0:
            passages = r[1]
        else:
            df[r[0]], y[r[0]] = r[1], r[2:]
    return df, passages, y


def _parts(items: list[Item]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Item index and words of each passage of each item.  A stretch of
    ``PASSAGE - STRIDE`` words lies whole in some passage of its document."""
    owner, parts = [], []
    for i, x in enumerate(items):
        cut = np.array_split(x.words, -(-len(x.words) // (PASSAGE - STRIDE)))
        owner += [i] * len(cut)
        parts += cut
    return np.array(owner), parts


def term_weights(df: np.ndarray, passages: int) -> np.ndarray:
    """Inverse document frequency of each term, never under ``FLOOR`` of the
    largest possible one: copies of an item can't switch its words off."""
    most = np.log(passages + 2)
    return np.maximum(np.log((passages + 2) / (df + 1)), FLOOR * most)


def latent_space(docs: DataFrame, items: list[Item], rank: int = RANK):
    """(vocabulary, passages of each term, term vectors) of the leading singular
    directions and of the benchmark's own passages."""
    vocabulary = np.unique(np.concatenate([x.words for x in items]))
    width = min(rank + 8, len(vocabulary))
    omega = np.random.default_rng(7).standard_normal((len(vocabulary), width))
    df, passages, y = statistics(docs, vocabulary, omega)
    idf = term_weights(df, passages)
    # with A = N diag(idf): A'A (omega / idf) = idf * N'N omega
    y *= idf[:, None]
    omega /= idf[:, None]
    _, parts = _parts(items)
    own = np.zeros((len(parts), len(vocabulary)))
    for i, words in enumerate(parts):
        np.add.at(own[i], np.searchsorted(vocabulary, words), 1)
    own *= idf
    # the benchmark's rows weigh as much as all of the corpus
    weight = 1 + (df * idf ** 2).sum() / max((own ** 2).sum(), 1e-9)
    y += weight * (own.T @ (own @ omega))
    shift = np.sqrt(len(vocabulary)) * 2.0 ** -40 * max(np.linalg.norm(y), 1e-9)
    y += shift * omega
    core = omega.T @ y
    core = np.linalg.cholesky((core + core.T) / 2 + np.eye(width) * 1e-9 * np.trace(core) / width)
    u, _, _ = np.linalg.svd(np.linalg.solve(core, y.T).T, full_matrices=False)
    # the benchmark's own passages are kept whole, so that its size costs none
    # of them its length in the space
    basis, _ = np.linalg.qr(np.hstack([u[:, :rank], own.T]))
    return vocabulary, df, (basis * idf[:, None]).astype(np.float32)


class Postings:
    """The benchmark's passages as queries: per term, the passages that get part
    of their product with a document's passage from it.

    ``need`` is what the least heavy ``RETRIEVE`` of a query's words add up to:
    a passage with that share of the words has no less.  The terms that most
    documents have, up to half of ``need``, are left out of the postings; the
    other terms then hold at least the other half in every passage sought."""

    def __init__(self, items: list[Item], vocabulary: np.ndarray, df: np.ndarray, vectors: np.ndarray):
        self.owner, parts = _parts(items)
        at = [np.searchsorted(vocabulary, p) for p in parts]
        self.query = np.array([vectors[x].sum(axis=0) for x in at], dtype=np.float32)
        self.need = np.empty(len(parts))
        self.terms, self.adds = [], []  # of each query: its terms, and what each adds to the product
        term, query, add = [], [], []
        for j, x in enumerate(at):
            u, place, c = np.unique(x, return_inverse=True, return_counts=True)
            w = np.maximum(vectors[u].astype(np.float64) @ self.query[j], 1e-9)
            self.need[j] = np.sort((w / c)[place])[:math.ceil(RETRIEVE * len(x) - 1e-9)].sum() * (1 - 1e-4)
            self.terms.append(u)
            self.adds.append(w)
            order = np.lexsort((u, -df[u]))
            kept = order[np.cumsum(w[order]) > self.need[j] / 2]
            term.append(u[kept])
            query.append(np.full(len(kept), j))
            add.append(w[kept])
        term, query, add = (np.concatenate(x) for x in (term, query, add))
        order = np.argsort(term, kind="stable")
        self.of, self.add = query[order], add[order]
        self.count = np.bincount(term, minlength=len(vocabulary))
        self.first = np.cumsum(self.count) - self.count

    def candidates(self, run, pos: np.ndarray, term: np.ndarray, starts: np.ndarray, doc: np.ndarray):
        """(passage, query) pairs whose product reaches the query's need, each
        term counted once in a passage; a passage is the blocks that start at
        ``starts`` and the next ones of its document."""
        n = len(self.need)
        bits = len(self.count).bit_length()  # of a term in a cell
        block = np.searchsorted(starts, pos, side="right") - 1
        cells, cell_block, telling = [], [], []
        posted = self.count[term] > 0
        for k in range(PASSAGE // STRIDE):
            b = block - k
            ok = (b >= 0) & (doc[np.maximum(b, 0)] == doc[block])
            cell = b << bits | term
            cells.append(cell[ok])
            cell_block.append(b[ok])
            telling.append(cell[ok & posted])
        cells, cell_block, telling = np.concatenate(cells), np.concatenate(cell_block), distinct(np.concatenate(telling))
        found_p, found_q = [], []
        step = max(1, ACCUMULATED // n)
        cut = np.searchsorted(telling, np.append(np.arange(0, len(starts), step), len(starts)) << bits)
        for i, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if lo == hi:
                continue
            p, t = telling[lo:hi] >> bits, telling[lo:hi] & (1 << bits) - 1
            c = self.count[t]
            at = np.arange(c.sum()) + np.repeat(self.first[t] - (np.cumsum(c) - c), c)
            got = np.bincount(np.repeat((p - i * step) * n, c) + self.of[at], weights=self.add[at])
            hit = np.flatnonzero(got > 0)
            hit = hit[got[hit] >= self.need[hit % n] / 2]
            found_p.append(hit // n + i * step)
            found_q.append(hit % n)
        if not found_p:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        p, q = np.concatenate(found_p), np.concatenate(found_q)
        # the whole product of those pairs
        wanted = np.zeros(len(starts), dtype=bool)
        wanted[p] = True
        held = np.sort(cells[wanted[cell_block]])
        length = np.array([len(self.terms[j]) for j in q.tolist()], dtype=np.int64)
        if not len(length):
            return p, q
        probe = np.repeat(p << bits, length) + np.concatenate([self.terms[j] for j in q.tolist()])
        at = np.minimum(np.searchsorted(held, probe), len(held) - 1)
        add = np.concatenate([self.adds[j] for j in q.tolist()]) * (held[at] == probe)
        whole = np.add.reduceat(add, np.cumsum(length) - length)
        ok = whole >= self.need[q]
        return p[ok], q[ok]


def _search(docs: DataFrame, items: list[Item], key: str) -> DataFrame:
    vocabulary, df, vectors = latent_space(docs, items)
    held = docs.sparkSession.sparkContext.broadcast((Vocabulary(vocabulary), vectors, items, Postings(items, vocabulary, df, vectors)))
    key_type = dict(docs.dtypes)[key]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, vectors, items, postings = held.value
        owner = postings.owner
        size = np.linalg.norm(postings.query, axis=1)
        words = [x.words.tolist() for x in items]
        answers = [x.answer.tolist() for x in items]
        places = [_places(w) for w in words]
        sets = [frozenset(w) for w in words]
        most = [max(x.bit_count() for x in p.values()) for p in places]  # places of one word
        for b in batches:
            best: dict[tuple[int, int], tuple] = {}
            for run in scan_words(b.column(1), True, True):
                pos, term = vocabulary.terms(run)
                if not len(pos):
                    continue
                starts, doc = _blocks(run, STRIDE)
                # words that no item has are in no common subsequence
                held_hashes, before = run.hashes[pos], np.zeros(len(run.hashes) + 1, dtype=np.int64)
                before[pos + 1] = 1
                before = np.cumsum(before)
                last, seen = -1, {}
                for p, j in zip(*(x.tolist() for x in postings.candidates(run, pos, term, starts, doc))):
                    i, d = int(owner[j]), int(doc[p])
                    n = len(words[i])
                    lo, hi = int(run.first[d]), int(run.first[d + 1])
                    if p != last:
                        last, seen = p, {}
                    if n not in seen:
                        at = before[[max(lo, int(starts[p]) - n), min(hi, int(starts[p]) + PASSAGE + n)]]
                        text = held_hashes[at[0]:at[1]].tolist()
                        seen[n] = text, frozenset(text)
                    text, held_words = seen[n]
                    both = sets[i] & held_words
                    if len(both) * most[i] < LCS_PARAPHRASE * n:
                        continue
                    bits = 0
                    for w in both:
                        bits |= places[i][w]
                    if bits.bit_count() < LCS_PARAPHRASE * n:  # no subsequence is longer
                        continue
                    share = lcs(words[i], text, places[i]) / n
                    if share < LCS_PARAPHRASE:
                        continue
                    answer = lcs(answers[i], text) / len(answers[i])
                    if share < LCS and answer < ANSWER:
                        continue
                    inside = np.unique(term[slice(*np.searchsorted(pos, [starts[p], min(hi, starts[p] + PASSAGE)]))])
                    vector = vectors[inside].sum(axis=0)
                    cosine = float(vector @ postings.query[j]) / (float(np.linalg.norm(vector)) * float(size[j]))
                    got = (share, answer, cosine, int(starts[p]) - lo)
                    k = (run.row + d, i)
                    if k not in best or got[:3] > best[k][:3]:
                        best[k] = got
            rows = [(r, items[i].id, *v) for (r, i), v in best.items()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()),
                 *[pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4)],
                 pa.array([r[5] for r in rows], pa.int64())],
                [key, "item_id", "lcs_share", "answer_share", "cosine", "start"])

    return docs.mapInArrow(search, f"`{key}` {key_type}, item_id long, lcs_share double, answer_share double, cosine double, start long")


def item_blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """Items in blocks of ``BLOCK_PASSAGES`` passages or one item, by ``item_id``."""
    block, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        item = Item(r[0], r[1])
        if not len(item.words):
            continue
        n = len(_parts([item])[1])
        if block and size + n > BLOCK_PASSAGES:
            yield block
            block, size = [], 0
        block.append(item)
        size += n
    if block:
        yield block


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, item_id, lcs_share, answer_share, cosine and start (word) of
    the best match of each item that a document holds."""
    docs = df.select(key, F.lower("text").alias("text"))
    out = None
    for block in item_blocks(benchmark):
        found = _search(docs, block, key)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.where("false").select(key, *[F.lit(0).cast(t).alias(c) for c, t in (
            ("item_id", "long"), ("lcs_share", "double"), ("answer_share", "double"), ("cosine", "double"), ("start", "long"))])
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` that hold no benchmark item, columns unchanged (a null
    ``key`` can't be named and stays)."""
    found = leaks(df, benchmark, key).select(F.col(key).alias("_leak")).distinct()
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"))
    return packed.join(found, F.col("_row")[key] == F.col("_leak"), "left_anti").select("_row.*")
