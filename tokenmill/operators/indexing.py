"""Exact row numbers without a single-partition window (2.10-D).

``row_number() over (order by k)`` with no partition clause funnels every row
through one task; ``row_number() over (partition by g order by k)`` puts a hot
group into one task. Instead the rows are range-partitioned on the sort key,
the partition layout is frozen with a reliable checkpoint (range bounds are
sampled, so two evaluations could otherwise disagree), and each row's number is
its position inside its partition plus the rows before it in earlier partitions.
The offsets table has at most one row per partition, so broadcasting it is
size-safe at any data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.session import cut_lineage


def _parts(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return int(partitions)
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def sequence_index(df: DataFrame, order_cols, group_cols=(), name: str = "idx",
                   start: int = 0, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = exact 0-based (+start) position of each row in the order
    ``order_cols`` (ties must be broken by the caller), restarting per
    ``group_cols`` when given."""
    order_cols = list(order_cols)
    group_cols = list(group_cols)
    keys = group_cols + order_cols
    n = _parts(df, partitions)
    pid = F.spark_partition_id()
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", pid)
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33)))
    ranged = cut_lineage(ranged)
    before = Window.unboundedPreceding
    if not group_cols:
        counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        offs = counts.select("_pid", F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(before, -1)), F.lit(0)).alias("_off"))
        out = ranged.join(F.broadcast(offs), "_pid", "left")
        idx = F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos") + F.lit(start)
    else:
        counts = ranged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(before, -1)
        # Only a group that began in an earlier partition has a non-zero offset:
        # at most one such group per partition.
        offs = (counts.select("_pid", *group_cols, F.sum("_n").over(w).alias("_off"))
                .where(F.col("_off") > 0))
        out = ranged.join(F.broadcast(offs), ["_pid", *group_cols], "left")
        rn = F.row_number().over(Window.partitionBy("_pid", *group_cols).orderBy("_pos"))
        idx = F.coalesce(F.col("_off"), F.lit(0)) + rn - F.lit(1) + F.lit(start)
    return out.withColumn(name, idx.cast("bigint")).drop("_pid", "_pos", "_off")


def running_offset(df: DataFrame, order_cols, weight: str, name: str = "off",
                   partitions: int | None = None) -> DataFrame:
    """Exclusive prefix sum of ``weight`` in the order ``order_cols`` (e.g.
    the character offset of each line of one huge text), computed like
    ``sequence_index``: partition totals are prefix-summed over a table of at
    most one row per partition (broadcast), and rows are summed inside their
    own partition (a window bounded by one partition)."""
    order_cols = list(order_cols)
    n = _parts(df, partitions)
    pid = F.spark_partition_id()
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", pid)
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33)))
    ranged = cut_lineage(ranged)
    before = Window.unboundedPreceding
    tots = ranged.groupBy("_pid").agg(F.sum(weight).alias("_t"))
    offs = tots.select("_pid", F.coalesce(F.sum("_t").over(Window.orderBy("_pid").rowsBetween(before, -1)),
                                          F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum(weight).over(Window.partitionBy("_pid").orderBy("_pos").rowsBetween(before, -1)),
                       F.lit(0))
    out = ranged.withColumn("_in", inner).join(F.broadcast(offs), "_pid", "left")
    return out.withColumn(name, (F.col("_base") + F.col("_in")).cast("bigint")).drop("_pid", "_pos", "_base", "_in")


def grouped_scan(df: DataFrame, group_cols, order_cols, value: str, op: str, name: str,
                 inclusive: bool = False, partitions: int | None = None) -> DataFrame:
    """Running ``op`` (sum, min, max, or last = last non-null) of ``value``
    per group in ``order_cols`` order, exclusive of the row unless
    ``inclusive``. A hot group is spread over many range partitions: each
    partition scans its own rows, and the carry from earlier partitions comes
    from a table with at most one row per partition (broadcast)."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    keys = group_cols + order_cols
    n = _parts(df, partitions)
    pid = F.spark_partition_id()
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", pid)
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33)))
    ranged = cut_lineage(ranged)
    v = F.col(value)

    def agg(c, order):
        if op == "sum":
            return F.sum(c)
        if op == "min":
            return F.min(c)
        if op == "max":
            return F.max(c)
        if op == "last":
            return F.max_by(c, F.when(c.isNotNull(), order))
        raise ValueError(op)

    def combine(carry, within):
        if op == "sum":
            return F.coalesce(carry, F.lit(0)) + F.coalesce(within, F.lit(0))
        if op in ("min", "max"):
            return (F.least if op == "min" else F.greatest)(carry, within)
        return F.coalesce(within, carry)

    before = Window.unboundedPreceding
    part = ranged.groupBy("_pid", *group_cols).agg(agg(v, F.col("_pos")).alias("_pa"))
    wc = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(before, -1)
    carry = part.select("_pid", *group_cols, agg(F.col("_pa"), F.col("_pid")).over(wc).alias("_carry")) \
        .where(F.col("_carry").isNotNull())
    # only a group that began in an earlier partition carries: <= 1 row per partition
    out = ranged.join(F.broadcast(carry), ["_pid", *group_cols], "left")
    ww = Window.partitionBy("_pid", *group_cols).orderBy("_pos").rowsBetween(before, 0 if inclusive else -1)
    res = combine(F.col("_carry"), agg(v, F.col("_pos")).over(ww))
    return out.withColumn(name, res).drop("_pid", "_pos", "_carry")
