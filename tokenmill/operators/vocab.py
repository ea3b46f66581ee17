"""Vocabulary operators (V1-V4, V7) and character encoding.

Vocabularies are small by construction (bounded by the number of distinct
characters or by ``vocab_size``); corpora are never collected. A character
vocabulary becomes arrays indexed by code point, so a lookup takes one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.constants import N_SPECIAL, SPECIAL_PIECES
from tokenmill.functions import char_tokens, whitespace_words

# Largest piece list inlined as a literal array inside expressions.


def char_vocab(df: DataFrame, col: str = "text", offset: int = 0) -> DataFrame:
    """V1: distinct characters sorted by code point, id = rank from ``offset``.
    Only the distinct set reaches the (single-partition) rank window."""
    chars = (df.select(F.explode(char_tokens(col)).alias("token"))
             .groupBy("token").agg(F.count(F.lit(1)).alias("_n")).select("token"))
    return chars.select((F.row_number().over(Window.orderBy("token")) - 1 + offset).cast("bigint").alias("id"),
                        "token")


def char_counts(df: DataFrame, col: str = "text") -> DataFrame:
    """Character occurrence counts (map-side combined)."""
    return (df.select(F.explode(char_tokens(col)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def char_coverage(df: DataFrame, col: str = "text", coverage: float = 0.9995) -> DataFrame:
    """V2: keep the most frequent characters (count desc, code point asc) while
    the share covered by the characters before them is below ``coverage``."""
    c = char_counts(df, col)
    w = Window.orderBy(F.col("n").desc(), F.col("token"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    return c.select("token", "n", F.row_number().over(w).alias("rank"),
                    ((before / total) < F.lit(float(coverage))).alias("kept"))


def specials(spark) -> DataFrame:
    """Fixed rows pad/bos/eos/unk = 0..3."""
    return spark.createDataFrame([(i, p, "special") for i, p in enumerate(SPECIAL_PIECES)],
                                 "id bigint, piece string, kind string")


def with_specials(vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """V3: specials first, the vocabulary's ids shifted by 4."""
    body = vocab.select((F.col("id") + N_SPECIAL).cast("bigint").alias("id"),
                        F.col(token_col).alias("piece"), F.lit("char").alias("kind"))
    return specials(vocab.sparkSession).unionByName(body)


def word_freq(df: DataFrame, col: str = "text") -> DataFrame:
    """V4: whitespace words with counts."""
    return (df.select(F.explode(whitespace_words(col)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def vocab_profile(vocab: DataFrame) -> DataFrame:
    """V7: piece count by kind and length (the total is the sum over rows)."""
    return (vocab.groupBy("kind", F.length("piece").alias("piece_len"))
            .agg(F.count(F.lit(1)).alias("n_pieces")))


def literal_pieces(vocab: DataFrame, id_col: str = "id", piece_col: str = "piece") -> Column:
    """Pieces as one array constant indexed by id (ids must be dense from 0). The
    vocabulary is collected (its size is a parameter of its training); the
    constant is one folded literal whatever its size, split at a character that no
    piece has."""
    rows = vocab.select(id_col, piece_col).orderBy(id_col).collect()
    if [r[0] for r in rows] != list(range(len(rows))):
        raise ValueError("ids must be dense from 0")
    pieces = [r[1] for r in rows]
    used = set().union(*pieces) if pieces else set()
    mark = next(chr(c) for c in range(0xE000, 0x110000) if chr(c) not in used)
    return F.split(F.lit(mark.join(pieces)), mark) if pieces else F.array().cast("array<string>")


def char_lookup(vocab: DataFrame, unk_id: int | None = None):
    """A function text column -> array of ids. The vocabulary (at most every
    Unicode character) is collected once and becomes two arrays indexed by code
    point, 256 to a page, so a lookup costs the same whatever its size. A
    character outside it gives ``unk_id``, or fails if that is None."""
    rows = vocab.select("token", "id").collect()
    pages, flat = [0] * ((0x10FFFF >> 8) + 1), ["-1"] * 256  # page 0: nothing known
    for token, i in rows:
        at = ord(token)
        if not pages[at >> 8]:
            pages[at >> 8] = len(flat) // 256
            flat += ["-1"] * 256
        flat[pages[at >> 8] * 256 + (at & 255)] = str(i)
    # one foldable literal each
    of_page = F.split(F.lit(",".join(map(str, pages))), ",").cast("array<int>")
    ids = F.split(F.lit(",".join(flat)), ",").cast("array<bigint>")

    def look(ch):
        at = F.ascii(ch)
        got = F.get(ids, F.get(of_page, F.shiftright(at, 8)) * 256 + at.bitwiseAND(F.lit(255)))
        if unk_id is None:
            bad = F.raise_error(F.concat(F.lit("unknown character: "), ch)).cast("bigint")
        else:
            bad = F.lit(unk_id).cast("bigint")
        return F.when(got >= 0, got).otherwise(bad)
    return lambda col: F.transform(char_tokens(col), look)


def char_encode(df: DataFrame, col: str, vocab: DataFrame, out: str = "ids",
                on_unknown: str = "error", unk_id: int | None = None) -> DataFrame:
    """Characters -> ids. An unseen character is an error (the reference
    raises KeyError) unless ``on_unknown='unk'``."""
    return df.withColumn(out, char_lookup(vocab, None if on_unknown == "error" else unk_id)(col))
