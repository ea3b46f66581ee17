"""V8: reuse a saved vocabulary when it fits, else train and save it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop FileSystem of the path (HDFS, S3, local)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def fingerprint(corpus: DataFrame, col: str, vocab_size: int, coverage: float) -> str:
    """What a vocabulary depends on: the multiset of texts (count and sum of
    hashes, one light pass), the size and the coverage."""
    h = F.xxhash64(F.lit(7), F.col(col)).cast("decimal(38,0)")
    n, total = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0))).first()
    return hashlib.md5(f"{n}:{total}:{vocab_size}:{coverage!r}".encode()).hexdigest()


def load_or_train(spark: SparkSession, path: str, corpus: DataFrame, col: str, vocab_size: int,
                  coverage: float = 0.9995) -> DataFrame:
    """The vocabulary under ``path`` that was trained on these texts with these
    settings; one is trained and stored there if none was. Vocabularies of other
    corpora or sizes lie beside it and are never returned."""
    from tokenmill.operators.bpe import bpe_train
    place = f"{path.rstrip('/')}/fit={fingerprint(corpus, col, vocab_size, coverage)}"
    if not path_exists(spark, place):
        vocab, _ = bpe_train(corpus, col, vocab_size, coverage)
        vocab.coalesce(1).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
