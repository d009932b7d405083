"""Spelling variants against a plain-Python version."""

import re
import zlib
from collections import Counter

import pytest

from gazette.llm import spelling
from gazette.llm.common import prepare

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_length=7):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= 2}
    by_gap = {}
    for w in n:  # equal after the loss of one letter, or one is the other's loss
        for i in range(len(w)):
            by_gap.setdefault(w[:i] + w[i + 1:], set()).add(w)
        by_gap.setdefault(w, set()).add(w)
    near = {w: set() for w in n}
    for group in by_gap.values():
        for a in group:
            near[a].update(b for b in group if one_apart(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def result(spark, rows, **extra):
    prepare(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in extra:
        docs = docs.selectExpr("*", f"{extra[name]} as {name}")
    out = spelling.group_variants(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in out.collect()]


def test_crc():
    import numpy as np

    text = "aéb hello".encode()
    b = np.frombuffer(text, dtype=np.uint8)
    start, end = np.array([0, 5, 3]), np.array([4, 10, 3])
    seeds = np.array([zlib.crc32(b"1:"), zlib.crc32(b"22:"), 9], dtype=np.uint32)
    want = [zlib.crc32(text[s:e], int(c)) for s, e, c in zip(start, end, seeds)]
    assert spelling.crc_of_ranges(seeds, b, start, end).tolist() == want


def test_query_on_table(spark):
    from gazette.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_spelling_variants"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 1000


def test_forms_and_chains(spark):
    """Each form is ten times as frequent; ties take the smaller word."""
    def plain(word, n, start):
        ids = (i for i in range(start, start + 10 * n) if zlib.crc32(f"{i}:{word}".encode()) % 31)
        return [(next(ids), word) for _ in range(n)]

    counts = {"kolorado": 600, "koloradu": 45, "kolxradu": 3, "abcdefgh": 50, "abcdefgi": 50, "abcdefgj": 2,
              "étéèàçûî": 50, "étéèàçûi": 2}
    rows = [row for k, (word, n) in enumerate(counts.items()) for row in plain(word, n, 10_000 * k)]
    got = result(spark, rows)
    assert set(got) == brute(rows)
    by = {r[0]: r for r in got}
    assert by["kolxradu"][1:3] == ("koloradu", "kolorado") and by["abcdefgj"][1] == "abcdefgh"


def test_anagrams_are_not_near(spark):
    rows = [(i, w) for i, w in enumerate(["thonanster", "anthonster", "sterthonan", "onthanster", "thonanstes"] * 4)]
    assert set(result(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    """Null id and text, empty text, repeated rows, case, clashing columns."""
    rows = [(None, "Similarity SIMILARITY"), (1, None), (2, ""), (3, "Étalages étalages"), (3, "Étalages étalages"),
            (4, "similarity9similarity"), (4, "similarity9similarity"), (5, "x" * 7 + " ×÷ÿ" * 3)]
    got = result(spark, rows, n="1", word="'w'", sig="2", n_near="3")
    assert set(got) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short words")]])
def test_no_words(spark, rows):
    assert result(spark, rows) == []


def test_very_long_text_and_word(spark):
    long_run = "ab" * 30_000
    rows = [(1, "wordswords " * 60_000), (2, long_run), (2, long_run), (7, long_run + "c"), (7, long_run + "c"), (9, "wordzwords " * 3)]
    got = result(spark, rows)
    n = {r[0]: r for r in got}
    assert n["wordswords"][3] + sum(r[3] for r in got if len(r[0]) == 9) >= 59_000
    assert n["wordzwords"][1] == "wordswords"
    h = [zlib.crc32(f"{i}:{w}".encode()) % 31 for i, w in ((2, long_run), (7, long_run + "c"))]
    if 0 not in h:
        assert n[long_run][4] == 1 and n[long_run + "c"][4] == 1
