"""The named queries of this package (``opN_<name>``) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, lines, nearup, packing, passages, pii, quality, simhash, spelling, tokens, turntrie, urlrules
from .common import prepare, table
from .encoders import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return deco


@query("op1_packing")
def op1(spark, sf_dir):
    """Every piece of every document with its place in the packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op2_license_scan")
def op2(spark, sf_dir):
    """Known licences found in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


# The queries' key; a corpus of one's own takes a secret one.
PSEUDONYM_KEY = "example key"


@query("op3_pii_pseudonyms")
def op3(spark, sf_dir):
    """Every document with personal data replaced by pseudonyms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY, count="n_replaced")


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

URL_SQL = r"""
with u as (select page_id, coalesce(instr(url, '://'), 0) > 0 as ok, url from pages),
p as (select page_id,
             case when ok then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
             case when ok then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from u),
r(rh, rp, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select p.*, rh || rp as rule, v from p left join r
        on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
      qualify row_number() over (partition by page_id order by length(rh || rp) desc) = 1)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m"""


@query("op4_url_filter", URL_SQL)
def op4(spark, sf_dir):
    """Host, path, winning rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


QUALITY_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, i, w[i:i+7] as gram from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as c from g) where c > 1),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from r) group by doc_id),
m as (select w.doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines,
             coalesce(c.n, 0)::bigint as n_repeat_words from w left join c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or word_chars < 2 * n_words
            or word_chars > 12 * n_words or 100 * n_symbols > 10 * n_words
            or 100 * n_dup_lines > 30 * n_lines) as kept
from m"""


@query("op5_quality", QUALITY_SQL)
def op5(spark, sf_dir):
    """Counts and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


BOILERPLATE_SQL = r"""
with d as (select doc_id, text, source, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, text, source, list_filter(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: length(x) > 0) as ls,
             ls as raw from d),
b as (select x from (select unnest(ls) as x, coalesce(source, chr(0)) as s from l) group by x having count(distinct s) >= 6),
bl as (select coalesce(list(x), []) as bad from b),
c as (select doc_id, text, len(ls) as n_lines, raw, list_sum(list_transform(ls, lambda x: length(x))) as total,
             list_filter(ls, lambda x: list_contains(bad, x)) as gone, bad from l, bl),
k as (select *, len(gone) > 0 and 100 * list_sum(list_transform(gone, lambda x: length(x))) <= 50 * total as cuts from c)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, (case when cuts then len(gone) else 0 end)::bigint as n_cut,
       sha256(case when cuts then array_to_string(list_filter(raw, lambda y: not list_contains(bad, trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))), chr(10)) else text end) as text_sha256
from k"""


@query("op6_line_dedup", BOILERPLATE_SQL)
def op6(spark, sf_dir):
    """Lines and cut lines of every document, and a digest of its new text."""
    out = lines.cut_boilerplate(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_cut",
                      F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("op10_token_count")
def op10(spark, sf_dir):
    """Bytes and tokens of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op9_minhash_near_dedup")
def op9(spark, sf_dir):
    """Component of near duplicates of every document (2-word shingles)."""
    return nearup.link(table(spark, sf_dir, "documents"), width=2)


@query("op7_substring_dedup")
def op7(spark, sf_dir):
    """Words of every document and how many of them lie in repeated passages."""
    return passages.cut_repeats(table(spark, sf_dir, "documents"))


@query("op8_decontaminate")
def op8(spark, sf_dir):
    """Benchmark items that each document holds, one row per document and item."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    """Every frequent word with its near words, form and root."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query("op13_simhash_near_dedup")
def op13(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash.link(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie")
def op12(spark, sf_dir):
    """Every node of the trie of the conversations' turns."""
    return turntrie.prefix_nodes(table(spark, sf_dir, "conversations"))
