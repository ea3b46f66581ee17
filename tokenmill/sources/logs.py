"""Run logs (S4) and result/metric sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.sources.text_files import write_text_by

STDOUT_MARK = "=== STDOUT ==="
STDERR_MARK = "=== STDERR ==="


def write_run_logs(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """One log folder per run (run=<id>/part-*.txt): stdout header, the run's
    lines in order, a blank line, the stderr header. Rows are range-partitioned
    on (run, line_no), so a hot run is written by several tasks as several
    part files whose names sort in line order."""
    spark = lines.sparkSession
    n = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    head = lines.select("run").distinct()
    hdr = head.select("run", F.lit(-1).cast("bigint").alias("line_no"), F.lit(STDOUT_MARK).alias("line"))
    tail = head.select("run", F.lit(1 << 62).cast("bigint").alias("line_no"), F.lit("\n" + STDERR_MARK).alias("line"))
    allr = hdr.unionByName(lines.select("run", "line_no", "line")).unionByName(tail)
    write_text_by(allr.repartitionByRange(n, "run", "line_no").sortWithinPartitions("run", "line_no"), "run", "line", path, folders=True)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, line_no, section, line). A run is a folder ``run=<id>`` (all its
    files, in name order) or one flat file, named after it: ``<run>_log.txt`` or
    ``<run>.log``. Files are read by lines and split like any text (a huge log is
    many tasks): a line's place is (file, start of its split, order in the split),
    ``line_no`` counts from 0 per run, and the stderr section starts at its
    marker (a running max over the run's lines). Without markers all is stdout."""
    from tokenmill.operators.indexing import grouped_scan, sequence_index
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"),
        F.col("value").alias("line"))
    folder = F.regexp_extract("path", r"/run=([^/]+)/", 1)
    flat = F.regexp_replace("file", r"(_log\.txt|\.log|\.txt)$", "")
    raw = raw.select(F.when(folder != "", folder).otherwise(flat).alias("run"), "file", "start", "nth", "line")
    ex = sequence_index(raw, ["file", "start", "nth"], ["run"], name="line_no", start=0).select(
        "run", "line_no", "line", (F.col("line") == STDERR_MARK).cast("int").alias("_m"))
    ex = grouped_scan(ex, ["run"], ["line_no"], "_m", "max", "_err", inclusive=True)
    section = F.when(F.col("_err") > 0, "stderr").otherwise("stdout")
    return ex.where(~F.col("line").isin(STDOUT_MARK, STDERR_MARK)).select(
        "run", F.col("line_no").cast("bigint").alias("line_no"), section.alias("section"), "line")


def write_leaderboard(df: DataFrame, path: str, rank: str = "rank") -> None:
    """CSV with header, no index, in rank order. The global sort range-
    partitions the rows, so part files in name order are in rank order."""
    df.orderBy(rank).write.mode("overwrite").option("header", True).csv(path)


def append_metrics(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Append (run, tag, step, value) scalars. Folders are hash buckets of
    the run id as text (a folder per run would mean millions of tiny files at
    scale); rows are range-partitioned inside them, so a hot run is written by
    several tasks, and sorted, so a run's series is found by parquet min/max."""
    spark = df.sparkSession
    n = max(int(buckets), int(spark.conf.get("spark.sql.shuffle.partitions")))
    b = F.pmod(F.xxhash64(F.col("run").cast("string")), F.lit(int(buckets)))
    (df.select("run", "tag", "step", "value").withColumn("run_bucket", b)
     .repartitionByRange(n, "run_bucket", "run", "tag", "step").sortWithinPartitions("run_bucket", "run", "tag", "step")
     .write.mode("append").partitionBy("run_bucket").parquet(path))


def read_metrics(spark: SparkSession, path: str, run=None) -> DataFrame:
    """The scalars of one run (any id type, any number of buckets: the run
    column's parquet statistics prune the files), or all."""
    m = spark.read.parquet(path)
    if run is not None:
        m = m.where(F.col("run") == F.lit(run))
    return m.select("run", "tag", "step", "value")
