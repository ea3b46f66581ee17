"""Vocabulary dump format (S3): one ``piece<TAB>score`` line per piece, in id
order; specials score 0, then -0, -1, -2, ... so id = 4 - score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.constants import N_SPECIAL, SPECIAL_PIECES


def dump_lines(vocab: DataFrame) -> DataFrame:
    """Render (id, piece) rows as dump lines with their raw score text."""
    score = F.when(F.col("id") < N_SPECIAL, F.lit("0")).otherwise(
        F.concat(F.lit("-"), (F.col("id") - N_SPECIAL).cast("string")))
    return vocab.select(F.concat(F.col("piece"), F.lit("\t"), score).alias("value"))


def parse_vocab_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse dump lines without relying on file order: the score text '0'
    marks a special (its id comes from its name), '-k' is id 4 + k."""
    v = F.col(col)
    tab = F.length(v) - F.locate("\t", F.reverse(v)) + 1
    piece = F.substring(v, F.lit(1), tab - 1)
    raw = F.substring(v, tab + 1, F.lit(1 << 20))
    special = F.array_position(F.array(*[F.lit(p) for p in SPECIAL_PIECES]), piece) - 1
    is_special = raw == "0"
    score = raw.cast("bigint")
    ident = F.when(is_special, special).otherwise(F.lit(N_SPECIAL) - score)
    return lines.select(ident.cast("bigint").alias("id"), piece.alias("piece"), score.alias("score"),
                        F.when(is_special, "special").otherwise("piece").alias("kind"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Read a ``.vocab`` dump. The file contains a bare '"' piece, so it is
    read as text lines (no CSV quoting)."""
    return parse_vocab_lines(spark.read.text(path))


def write_vocab(vocab: DataFrame, path: str) -> None:
    dump_lines(vocab.orderBy("id")).coalesce(1).write.mode("overwrite").text(path)
