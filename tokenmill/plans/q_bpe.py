"""Registered queries: BPE vocabulary, encoding, decoding and the vocab dump
format (V6, V8, E1, E9, E11, S3)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from tokenmill.constants import MAX_TGT_LEN
from tokenmill.functions import ids_text
from tokenmill.operators import bpe as BP
from tokenmill.operators import vocab as V
from tokenmill.plans import fixtures as FX
from tokenmill.sources.corpus import corpus_flatten
from tokenmill.plans.registry import register, with_ctes
from tokenmill.sources import read_table
from tokenmill.session import checkpoint_dir
from tokenmill.sources.vocab_files import dump_lines, parse_vocab_lines, read_vocab, write_vocab

VOCAB_SIZE = 8000  # 4 specials + the corpus characters + the rest merges
_memo: dict = {}


def trained(spark, sf):
    """BPE vocabulary of the parallel corpus (both sides), memoised per
    session and scale so the encode/decode queries reuse one training run."""
    key = (spark.sparkContext.applicationId, sf, VOCAB_SIZE)
    if key not in _memo:
        corpus = corpus_flatten(FX.pairs(spark, sf))
        vocab, merges = BP.bpe_train(corpus, "text", VOCAB_SIZE)
        _memo[key] = (vocab.cache(), merges.cache())
    return _memo[key]


@register("bpe_train")
def q_bpe_train(spark, sf):
    """V6 (always trains; the encode/decode queries share a memoised run)."""
    corpus = corpus_flatten(FX.pairs(spark, sf))
    vocab, _ = BP.bpe_train(corpus, "text", VOCAB_SIZE)
    return vocab


@register("bpe_encode")
def q_bpe_encode(spark, sf):
    vocab, _ = trained(spark, sf)
    e = BP.bpe_encode(FX.pairs(spark, sf), "src", vocab, "ids")
    return e.select("pair_id", ids_text("ids").alias("src_ids"), F.size("ids").cast("bigint").alias("n_ids"))


@register("bpe_decode")
def q_bpe_decode(spark, sf):
    vocab, _ = trained(spark, sf)
    e = BP.bpe_encode(FX.pairs(spark, sf), "src", vocab, "ids")
    return e.select("pair_id", BP.bpe_decode("ids", vocab).alias("text"))


@register("roundtrip_refs")
def q_roundtrip_refs(spark, sf):
    """References as the reference scores them: encode, wrap/truncate,
    shift, clean, decode (long targets come back cut, unknowns as ' ⁇ ')."""
    vocab, _ = trained(spark, sf)
    return BP.roundtrip_refs(FX.pairs(spark, sf), "tgt", vocab, MAX_TGT_LEN).select("pair_id", "ref")


@register("load_or_train")
def q_load_or_train(spark, sf):
    from tokenmill.operators.vocab_store import load_or_train
    from tokenmill.session import checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/vocab-store/pairs-{hashlib.md5(sf.encode()).hexdigest()[:12]}-{VOCAB_SIZE}"
    corpus = corpus_flatten(FX.pairs(spark, sf))
    return load_or_train(spark, path, corpus, "text", VOCAB_SIZE)


_SQL_DOC_CHARS = """doc_chars AS (SELECT unnest(string_split(text, '')) AS token FROM documents WHERE text <> '')"""


@register("read_vocab", sql=with_ctes(_SQL_DOC_CHARS) + """,
v AS (SELECT * FROM (VALUES (0, '<pad>'), (1, '<s>'), (2, '</s>'), (3, '<unk>')) s(id, piece)
      UNION ALL SELECT row_number() OVER (ORDER BY token) + 3, token FROM (SELECT DISTINCT token FROM doc_chars))
SELECT CAST(id AS BIGINT) AS id, piece, CAST(CASE WHEN id < 4 THEN 0 ELSE -(id - 4) END AS BIGINT) AS score,
       CASE WHEN id < 4 THEN 'special' ELSE 'piece' END AS kind FROM v""".replace("\n,\nv", ",\nv"))
def q_read_vocab(spark, sf):
    """S3: a vocabulary dump written as a file (piece TAB score, one line each) and
    read back: id = 4 - score, the four specials by name. The characters of the
    documents include line breaks, which the format cannot hold and S5 flattens:
    those pieces are read from their lines, the others from the file."""
    v = V.with_specials(V.char_vocab(read_table(spark, sf, "documents"), "text"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/vocab-dump-{uuid.uuid4()}"
    breaks = F.col("piece").rlike("[\\r\\n]")
    write_vocab(v.where(~breaks), path)
    return read_vocab(spark, path).unionByName(parse_vocab_lines(dump_lines(v.where(breaks))))
