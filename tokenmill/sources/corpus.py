"""Parallel corpora and documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions import flatten_newlines
from tokenmill.sources.text_files import local_folder, read_whole, write_text_by

PAIR_SCHEMA = "pair_id bigint, split string, translation struct<en: string, zh: string>"


def shape_pairs(pairs: DataFrame, src_lang: str = "en", tgt_lang: str = "zh", split_col: str = "split") -> DataFrame:
    """(pair_id, split, src, tgt) -> the nested corpus layout."""
    return pairs.select("pair_id", split_col, F.struct(F.col("src").alias(src_lang), F.col("tgt").alias(tgt_lang))
                        .alias("translation"))


def select_pairs(corpus: DataFrame, src: str = "en", tgt: str = "zh", split: str | None = None) -> DataFrame:
    """Pick the two language fields of the nested struct, optionally one split."""
    c = corpus if split is None else corpus.where(F.col("split") == split)
    return c.select("pair_id", "split", F.col(f"translation.{src}").alias("src"), F.col(f"translation.{tgt}").alias("tgt"))


def read_pairs(spark: SparkSession, path: str, src: str = "en", tgt: str = "zh", split: str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read a split-partitioned corpus; the split filter prunes partitions
    and only the two language fields are read."""
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.schema(PAIR_SCHEMA)
    return select_pairs(reader.load(path), src, tgt, split)


def write_pairs(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").partitionBy("split").parquet(path)


def write_documents(docs: DataFrame, key: str, col: str, path: str) -> None:
    """Every document a text file of its own, named after its key."""
    write_text_by(docs.select(key, col).sortWithinPartitions(key), key, col, path, folders=False)


def read_document(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Each file, in whatever folder below, as ONE string (doc = file path), by ``partitions``
    tasks. Tasks list and read ``file:`` folders; other stores go by Spark's reader, which
    keeps every file's entry in the driver."""
    top = local_folder(spark, path)
    if top is not None:
        n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        return read_whole(spark, top, n)
    docs = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))
    return docs.coalesce(partitions) if partitions else docs


def read_document_pieces(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """S2 for files of any size: every file as ordered pieces, (doc, piece, len,
    part, off) with ``off`` = characters before the piece over all files in path
    order (``document_ranges`` has each file's place). A file is read by byte ranges
    like any text, so a huge one is many tasks, and its text is exactly the
    pieces one after the other, whether it ends with a line break or not."""
    from tokenmill.operators.longtext import pieces_with_offsets
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    numbered = raw.withColumn("nth", F.monotonically_increasing_id())
    fields = "doc string, start long, size long, text string, nth long"

    def breaks(batches):
        """A line break before every line but a file's first: the first row of the
        range that starts at 0 (a task reads its ranges one after the other)."""
        last = None
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                here = (r["doc"], r["start"])
                if here == last or r["start"] > 0:
                    r["text"] = "\n" + r["text"]
                last = here
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    lines = numbered.mapInArrow(breaks, fields)
    # a file whose lines and breaks fall short of its size by one byte ends with a break
    ends = lines.groupBy("doc").agg(F.max("size").alias("size"), F.sum(F.octet_length("text")).alias("bytes")) \
        .where(F.col("bytes") < F.col("size"))
    last = F.lit((1 << 63) - 1)
    lines = lines.select("doc", "start", "nth", "text").unionByName(
        ends.select("doc", last.alias("start"), last.alias("nth"), F.lit("\n").alias("text")))
    return pieces_with_offsets(lines, ["doc", "start", "nth"], "text", partitions).drop("start", "nth", "k")


def document_ranges(pieces: DataFrame) -> DataFrame:
    """(doc, first, n_chars, n_lines) of every file: where its characters begin in
    ``off``, how many there are, and its lines as split on line breaks."""
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    return pieces.groupBy("doc").agg(F.min("off").alias("first"), F.sum("len").alias("n_chars"),
                                     (F.sum(breaks) + 1).cast("bigint").alias("n_lines"))


def write_training_text(df: DataFrame, col: str, path: str) -> None:
    """One sentence per line, newlines flattened."""
    df.select(flatten_newlines(col).alias("value")).write.mode("overwrite").text(path)


def corpus_flatten(pairs: DataFrame) -> DataFrame:
    """T4: both sides of each pair in one column, src then tgt, in one pass
    (a posexplode, not a union of two scans)."""
    return pairs.select("pair_id", F.posexplode(F.array("src", "tgt")).alias("side", "text"))
