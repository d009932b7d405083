"""Quality, line dedup, licences and pseudonyms: edge cases and brute force."""

import re

import pytest

from pyspark.sql import functions as F

from gazette.llm import licenses, lines, pii, quality


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    twice = {g for g in grams if grams.count(g) > 1}
    hit = {p for i, g in enumerate(grams) if g in twice for p in range(i, i + 8)}
    base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(hit), base)


TEXTS = [None, "", " \t\n", "one", "a b c d e f g h a b c d e f g h", "x " * 50, "é ü " * 30, "l\nl\n l\nm\n\n",
         "#a *b $c %d &e |f <g >h" * 3, " ".join(f"w{i}" for i in range(100)), "\x0bv\x0cw\r" * 25,
         " ".join(f"w{i % 9}" for i in range(40)), "p\xa0q " * 22, "long " + "z" * 50000]


def test_quality_counts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(1, "", 2)], "doc_id long, text string, n_words int")
    got = quality.judge(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert tuple(r)[1:7] == brute_quality(TEXTS[r.doc_id]), (r, TEXTS[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_order_never_changes_the_verdict(spark, docs):
    words = quality.with_words(docs, ["doc_id"])
    cond = quality.rules()
    order = quality.cascade_order(words, cond)
    assert sorted(order) == sorted(cond)
    kept = [{r[0] for r in words.where(quality.first_failure(cond, o).isNull()).select("doc_id").collect()}
            for o in (order, order[::-1])]
    assert kept[0] == kept[1] == {r[0] for r in quality.keep_good(docs).select("doc_id").collect()}
    assert kept[0] == {r.doc_id for r in quality.judge(docs).collect() if r.kept}


def test_quality_empty(spark, empty_docs):
    assert quality.judge(empty_docs).collect() == []
    out = quality.keep_good(empty_docs)
    assert out.columns == empty_docs.columns and out.collect() == []


def test_lines(spark):
    note = "cookie notice for all"
    own = ["\n".join(f"own line {k} of document {i}" for k in range(4)) for i in range(40)]
    rows = [(i, f"{own[i]}\n {note} \n\nend {i}", f"s{i % 8}", 0) for i in range(40)]
    rows += [(100 + i, f"{note}\n{note}", f"s{i % 8}", 0) for i in range(8)]  # nothing else: left whole
    rows += [(200, None, "s1", 0), (201, "", "s1", 0), (202, " \n\t", None, 0), (203, f"own text here and more of it\n{note}", None, 0)]
    rows += [(300, "only here and there", "s1", 0), (301, "only here and there", "s2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_cut int")
    out = {r.doc_id: r for r in lines.clean(df, min_sites=6, max_share=50).collect()}
    assert len(out) == len(rows) and lines.clean(df).columns == df.columns
    assert note not in out[3].text and out[3].text.endswith("\n\nend 3")
    assert out[100].text == f"{note}\n{note}" and out[203].text == "own text here and more of it"
    assert (out[200].text, out[201].text, out[202].text) == (None, "", " \n\t")
    assert out[300].text == "only here and there"


def test_lines_near_threshold_are_exact(spark):
    rows = [(i * 100 + s, f"line {i}", f"s{s}") for i in range(2, 12) for s in range(i)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert lines.spread(df, min_sites=6).count() == 6  # those on 6 to 11 sites


def test_lines_empty(empty_docs):
    assert lines.clean(empty_docs).collect() == []


def test_licenses(spark):
    mit = [t for i, t in licenses.KNOWN if i == "MIT"][1]
    rows = [(1, mit), (2, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace("LICENSE", "LICENCE")),
            (3, "text\n\nReleased under\n the MIT licence\n\nmore text"), (10, "text\n\n" + mit), (4, "code\nreleased under the MIT Licence\nReleased under the MIT License.\ncode"),
            (5, None), (6, ""), (7, "Released under the MIT License. And more."), (8, "© me\n\n\n"), (9, "x " * 100000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows] + [(4, "Licensed under CC BY NC 4.0", "z")], "doc_id long, text string, digest string")
    got = sorted((r.doc_id, r.license_ids, r.n_units, r.whole) for r in licenses.scan(df, licenses.known_digests(spark)).collect())
    assert got == [(1, ["MIT"], 1, True), (2, ["MIT"], 1, True), (3, ["MIT"], 1, False), (4, ["CC-BY-NC-4.0"], 1, True),
                   (4, ["MIT"], 1, False)] + [(i, [], 0, False) for i in (5, 6, 7, 8, 9, 10)]


def test_licenses_canonical_lines(spark):
    lines = {"Released under the MIT LICENCE": "released under the mit license", "v2.0 V.3 v 4 av2 version 5": "version 2 0 version 3 version 4 av2 version 5",
             " (c) me": "", "-- Copyright me": "copyright me", "the Copyright Holder's favour": "the copyright owner s favor", "a  b&c": "a b and c",
             "anon-commercial non-Commercial": "anon commercial noncommercial", "https://x\t--": "http x", "": "", "\u00c9t\u00e9, \u03a3": "\u00e9t\u00e9 \u03c3", "v": "v"}
    df = spark.createDataFrame([("\n".join(lines),), ("\r\n".join(lines),), (None,)], "text string")
    got = [r[0] for r in df.select(licenses.canonical_lines(F.col("text"))).collect()]
    assert got == [list(lines.values())] * 2 + [None]


def test_licenses_units_computed_once(spark):
    df = spark.range(10).selectExpr("id as doc_id", "cast(id as string) as text")
    out = licenses.scan(df, licenses.known_digests(spark))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(" in plan
    assert "Filter (size(" not in plan  # a test of the size, pushed down, computes the units again


def test_licenses_empty(spark, empty_docs):
    assert licenses.scan(empty_docs, licenses.known_digests(spark)).collect() == []


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


PRIVATE = "mail jo.doe7@mail.example.com, call +1 (203) 555-8282 or 203-555-0101, card 4041894974608795, 4041 8949 7460 8795, " \
          "ip 39.197.112.39, ssn 123-45-6789, on 2024-02-29."


@pytest.mark.parametrize("key", ["k1", "k2"])
def test_pseudonyms(spark, key):
    rows = [(1, PRIVATE), (2, "again 4041894974608795 and jo.doe7@mail.example.com"), (3, None), (4, ""), (5, "no data 12 a@b"),
            (6, "bad 4041894974608796 2024-02-30 999.1.1.1 000-12-3456"), (7, "x " * 50000 + "8.8.8.8"), (2, "4041894974608795")]
    df = spark.createDataFrame([(i, t, "keep") for i, t in rows], "doc_id long, text string, row string")
    new = pii.pseudonymise(df, key, count="n")
    got = [r for r in new.collect()]
    by = {r.doc_id: r for r in got if r.doc_id != 2 or r.text.startswith("again")}
    text = by[1].text
    for value in re.findall(r"jo\.doe7|203\) 555-8282|4041894974608795|39\.197\.112\.39|123-45-6789|2024-02-29", PRIVATE):
        assert value not in text
    m = re.fullmatch(r"mail ([a-z]{2}\.[a-z]{3}\d)@mail\.example\.com, call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}, card (\d{16}), "
                     r"(\d{4} \d{4} \d{4} \d{4}), ip \d+\.\d+\.\d+\.\d+, ssn \d{3}-\d\d-\d{4}, on \d{4}-\d\d-\d\d\.", text)
    assert m and luhn(m[2]) % 10 == 0 and m[3].replace(" ", "") == m[2]
    assert m[2] in by[2].text and m[1] + "@" in by[2].text  # equal values stay linked
    assert (by[3].text, by[4].text, by[5].text, by[6].text) == (None, "", rows[4][1], rows[5][1])
    assert by[1].n == 8 and by[5].n == 0 and len(got) == len(rows)
    back = pii.pseudonymise(new.select("doc_id", "text", "row"), key, undo=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_pseudonyms_are_a_permutation(spark):
    df = spark.range(0, 3000).selectExpr("id as doc_id", "date_format(date_add(date'1990-01-01', cast(id as int)), 'yyyy-MM-dd') as text")
    got = [r.text for r in pii.pseudonymise(df, "k").collect()]
    assert len(set(got)) == 3000 and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in got)
