"""Corpus pipeline: toxicity filter, language filter, near-duplicate removal,
benchmark decontamination, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm import langid, simhash, sp_codec, toxicity, winnow
from tokenmill.session import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents (score 0.7 or more) go."""
    checkpoint_dir(spark)
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language (``und`` or a score under 0.5)
    go."""
    checkpoint_dir(spark)
    return langid.keep_recognised(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id."""
    checkpoint_dir(spark)
    return simhash.one_per_group(docs, "doc_id", "text", 3, 3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of ten words with the benchmark go."""
    checkpoint_dir(spark)
    return winnow.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of the text, and how many they are."""
    out = sp_codec.encode(docs, "text", "ids", keep=["doc_id"])
    return out.select("doc_id", "ids", F.size("ids").alias("n_ids"))


STAGES = [("toxicity", clean), ("language", language), ("near_duplicates", deduplicate),
          ("decontamination", decontaminate), ("encode", encode)]
#: Two stages are learned and one is a numpy Viterbi: no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; what each keeps is
    written to the shared folder and read again, so a lost executor never sends
    the work further back than one stage."""
    sf_dir = sf_dir.rstrip("/")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
