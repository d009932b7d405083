"""Token counts from pre-token frequencies; ids are never materialised.

A SentencePiece BPE whose pieces never carry a space mark after their first
letter can't merge across the start of a run of spaces, so a text's token
count is the sum over its pre-tokens (a run of spaces and what follows it).
Each distinct pre-token is encoded once.  Pre-tokens of a bounded sample form a
head table of at most ``HEAD_TOKENS`` entries and ``HEAD_BYTES`` bytes, which every
task holds.  All others are dealt by pre-token with the documents' frequencies: the
task that holds a pre-token's rows encodes it once and joins the count to them in
sorted order, one pre-token at a time.  The head only moves work (a pre-token that
many documents share is in it): results are the same for any head, the empty one
included.

Null text counts as empty.  Repeated rows are counted one by one (rows are
joined on an internal row id); extra columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoders import sentence_pieces

# Bounds of the head table: documents sampled, entries, bytes of all entries.
HEAD_DOCUMENTS = 4000
HEAD_TOKENS = 200_000
HEAD_BYTES = 8 << 20
# Longest entry of the head.
HEAD_ENTRY = 4096

_PRE = re.compile(" +[^ ]*|[^ ]+")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens, each with its leading run of spaces; the model's dummy
    space begins the first."""
    text = " " + text.replace("▁", " ")
    if "  " not in text:
        return text[1:].split(" ")  # one space before each, left out
    return [x[1:] for x in _PRE.findall(text)]


def count_pieces(model: str, tokens: list[str]) -> list[int]:
    """Pieces of pre-tokens written without their first space."""
    # the model adds that space itself, but gives nothing for an empty string
    return [len(x) or 1 for x in sentence_pieces(model).encode(tokens, num_threads=1)]


def _text_pre_tokens(text: str) -> list[str]:
    return pre_tokens(text) if text else []


def safe_model(model: str) -> bool:
    """Whether no piece of the model has a space mark after another letter."""
    sp = sentence_pieces(model)
    return not any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


def head_table(rows: DataFrame, model: str) -> dict[str, int]:
    """Pieces of the commonest short pre-tokens of a hash-chosen sample."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Counter()
            for t in b.column(0):
                c.update(_text_pre_tokens(t.as_py() or ""))
            c = {k: v for k, v in c.items() if len(k) <= HEAD_ENTRY}
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["token", "n"])

    part = F.pmod(F.xxhash64("text"), F.lit(HEAD_DOCUMENTS))
    sample = rows.groupBy(part.alias("p")).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text")
    top = (sample.mapInArrow(words, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "token").limit(HEAD_TOKENS))
    # the commonest ones, as far as their bytes go
    top = top.select("token", F.sum(F.octet_length("token")).over(
        Window.orderBy(F.desc("n"), "token").rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"))
    tokens = [r[0] for r in top.where(F.col("bytes") <= HEAD_BYTES).select("token").collect()]
    return dict(zip(tokens, count_pieces(model, tokens))) if tokens else {}


def count_tokens(df: DataFrame, model: str, limit: int = 4096, key: str = "doc_id",
                 head: dict[str, int] | None = None) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit of every row."""
    if not safe_model(model):
        raise ValueError("pieces of this model cross spaces; pre-token counts don't add up")
    spark = df.sparkSession
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"),
                     F.coalesce("text", F.lit("")).alias("text"))
    known = spark.sparkContext.broadcast(head_table(rows, model) if head is None else head)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the pieces of the pre-tokens that the head
        has, and one for each other distinct pre-token of it."""
        have = known.value
        for b in batches:
            rid, token, n, covered = [], [], [], []
            for r, t in zip(b.column(0).to_pylist(), b.column(2)):
                pieces = 0
                for k, c in Counter(_text_pre_tokens(t.as_py())).items():
                    known_pieces = have.get(k)
                    if known_pieces is None:
                        rid.append(r)
                        token.append(k)
                        n.append(c)
                    else:
                        pieces += c * known_pieces
                covered.append(pieces)
            m = len(rid)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([b.column(0), pa.array(rid, pa.int64())]),
                 pa.concat_arrays([b.column(1), pa.nulls(m, b.column(1).type)]),
                 pa.concat_arrays([b.column(3), pa.nulls(m, pa.int64())]),
                 pa.array([None] * b.num_rows + token, pa.string()), pa.array(covered + n, pa.int64())],
                ["rid", "key", "n_bytes", "token", "n"])

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequencies times pieces; equal pre-tokens follow one another, so each
        is encoded once."""
        last, last_pieces = None, 0
        for b in batches:
            d = b.column(3).dictionary_encode()
            tokens = d.dictionary.to_pylist()
            seen = bool(tokens) and tokens[0] == last
            pieces = ([last_pieces] if seen else []) + count_pieces(model, tokens[seen:])
            if tokens:
                last, last_pieces = tokens[-1], pieces[-1]
            each = pa.array([*pieces, 1], pa.int64()).take(d.indices.fill_null(len(pieces)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pc.multiply(b.column(4), each)],
                                             ["rid", "key", "n_bytes", "n"])

    kind = dict(rows.dtypes)["key"]
    counts = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        frequencies, f"rid long, key {kind}, n_bytes long, token string, n long")
    # documents' own rows are spread by row id
    dealt = counts.repartition(F.xxhash64("token", F.when(F.col("token").isNull(), F.col("rid")))).sortWithinPartitions("token")
    counted = dealt.mapInArrow(priced, f"rid long, key {kind}, n_bytes long, n long").groupBy("rid").agg(
        F.max("key").alias(key), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return counted.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
