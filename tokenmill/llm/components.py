"""Connected components by alternating star contractions.

Only the edge table moves: a large-star round links every neighbour to the
smallest node seen, a small-star round contracts the result, and the rounds end
when the table no longer changes (logarithmically many in practice). The minima
are map-side aggregates; the joins on a hub's key are plain equi-joins, which
adaptive execution splits. Each round is cut with a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.session import cut_lineage


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another one and is not
    its component's smallest node; root is that smallest node. Loops, repeated
    and null edges are ignored; no edges give an empty table."""
    cur = cut_lineage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                      .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    state = _state(cur)
    while state[0]:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u") \
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(first, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        cur = cut_lineage(rest.union(first.select("a", F.col("m").alias("b"))).distinct())
        now = _state(cur)
        if now == state:
            break
        state = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
