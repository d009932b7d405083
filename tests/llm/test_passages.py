"""Repeated passages against brute force, and the edge cases."""

import hashlib
from collections import Counter

import pytest

from gazette.llm import passages


def brute(rows, window=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(passages.cut_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base[:35])), (2, "x " + " ".join(base[:35]) + " y"), (3, " ".join(base[1:35])),
            (4, "same " * 36), (5, "solo " * 35), (6, " ".join(base[100:300])), (7, " ".join(base[150:350])),
            (8, None), (9, ""), (10, " \t\n"), (11, " ".join(base[360:400])), (11, " ".join(base[360:400])),
            (12, " ".join([f"p{i % 3}" for i in range(90)])), (None, " ".join(f"q{i}" for i in range(60))),
            (13, " ".join(f"v{i}" for i in range(20000)))]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int")
    assert result(passages.cut_repeats(df)) == brute(rows)
    texts = {r.doc_id: r.kept_text for r in passages.cut_repeats(df, with_text=True).collect()}
    assert texts[2] == "x y" and texts[3] == " ".join(base[1:35])


def test_empty(spark, empty_docs):
    assert passages.cut_repeats(empty_docs).collect() == []
