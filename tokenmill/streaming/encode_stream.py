"""ST1: the request loop as a stream: strip, drop blanks, encode per
micro-batch. Encoding needs a vocabulary lookup (and BPE needs per-task
state), so each micro-batch runs the batch operators in ``foreachBatch``; the
output of batch N is written to ``batch_id=N`` with overwrite, so a replayed
batch after a failure replaces its own output instead of duplicating it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenmill.functions import ids_text, strip_text


def encode_stream(stream: DataFrame, encode, out_path: str, checkpoint: str, key_cols=("key",),
                  col: str = "text", available_now: bool = True) -> StreamingQuery:
    """``encode(df, col) -> df`` with an ``ids`` column (char or BPE encoder)."""
    keys = list(key_cols)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        s = batch.select(*keys, strip_text(col).alias("clean")).where(F.col("clean") != "")
        e = encode(s, "clean")
        (e.select(*keys, ids_text("ids").alias("ids"), F.lit(batch_id).alias("batch_id"))
         .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}"))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_encoded(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path)
