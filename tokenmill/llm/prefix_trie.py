"""Trie of conversation prefixes with subtree totals by depth bands.

Every conversation is rebuilt (its opening may be taken from the first one of
its block of twenty), and every distinct prefix of a rebuilt conversation is a node. The
key of a prefix is the sum of hashes of (position, role, text), four sums of 32
bits, so keys come from running sums over bounded blocks of turns and a
conversation that holds a third of all turns is spread like any other.

Totals over subtrees are rolled up by depth bands of fixed height. Inside a band
a node is credited to its ancestors of that band, along the path of its smallest
member; credits that share such a path are added up on the way. The tops of the
bands form a tree whose depth is smaller by the band's height and is rolled up
the same way; the completed totals of the tops are then credited to their
ancestors in the band above. A node is therefore credited to at most ``BAND``
ancestors per level, and a tree of depth d takes log(d) / log(BAND) levels.

Cases: a null role or text is empty; rows with a null conversation id belong to no
conversation and are left out; turns are ordered null first, equal turns of a
conversation by a hash of role and text, and repeated rows each count as a turn.
An empty table has no conversation and no root. Texts enter as two 64-bit
hashes and a word count in the first step, however long they are. Other columns
are not read. The list of the conversations that end at a node is hashed as a
stream of blocks, never held whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.operators.indexing import sequence_index
from tokenmill.session import cut_lineage

BAND = 32
BLOCK = 1024      # turns of one conversation summed together
ID_BITS = 12      # conversation ids hashed together: 2^12
SHARE = 1000      # a parent of more than 1/SHARE of all nodes is joined by broadcast: under SHARE rows
GROUP = 20
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["k1", "k2"]
SUMS = ["s1", "s2", "s3", "s4"]


def _halves(*cols) -> list[Column]:
    """Four 32-bit numbers out of two 64-bit hashes of ``cols``."""
    low = 0xFFFFFFFF
    return [x for seed in (11, 12) for h in [F.xxhash64(F.lit(seed), *cols)]
            for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(low)))]


def _key(depth: Column, sums) -> list[Column]:
    return [F.xxhash64(F.lit(seed), depth, *sums) for seed in (21, 22)]


def head_turns(c: Column) -> Column:
    """How many turns conversation ``c`` takes from the first of its block."""
    return (F.crc32(c.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(every conversation id c; the turns of the rebuilt conversations: c, d
    from 1, g1 and g2 (hashes of role and text), words)."""
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("c"), F.col(turn).alias("t"),
        F.xxhash64(F.lit(1), role_, text_).alias("g1"), F.xxhash64(F.lit(2), role_, text_).alias("g2"),
        F.regexp_count(text_, F.lit(WORD)).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("row"))
    # the texts are read once: the index below looks at its input twice
    rows = sequence_index(cut_lineage(rows), ["t", "g1", "g2", "row"], ["c"], name="pos", start=1) \
        .select("c", "pos", "g1", "g2", "words")
    convs = rows.groupBy("c").agg(F.max("pos").alias("len"))
    base = convs.where(F.col("c") % GROUP == 0).select(F.col("c").alias("base"), F.col("len").alias("base_len"))
    convs = cut_lineage(convs.withColumn("base", F.col("c") - F.col("c") % GROUP).join(base, "base", "left").select(
        "c", "base", "len", F.least(head_turns(F.col("c")).cast("bigint"), F.coalesce("base_len", F.lit(0))).alias("taken")))
    part = F.floor(F.col("pos") / BLOCK)
    shift = convs.select("c", "taken", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("len") / BLOCK))).alias("part"))
    own = rows.where(F.col("pos") > head_turns(F.col("c"))).withColumn("part", part).join(shift, ["c", "part"]).select(
        "c", (F.col("pos") - head_turns(F.col("c")) + F.col("taken")).alias("d"), "g1", "g2", "words")
    heads = rows.where((F.col("c") % GROUP == 0) & (F.col("pos") <= 3)).withColumnRenamed("c", "base") \
        .withColumnRenamed("pos", "d")
    taken = convs.where("taken > 0").select("c", "base", F.explode(F.sequence(F.lit(1).cast("bigint"), "taken")).alias("d")) \
        .join(heads, ["base", "d"]).select("c", "d", "g1", "g2", "words")
    return convs.select("c"), own.unionByName(taken)


def paths(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: c, d, its key k1 k2, its
    parent's key p1 p2, words of its last turn. The textless prefix (d = 0) is
    one row per conversation, without parent."""
    x = rows.select("c", "d", "words", *[h.alias(s) for h, s in zip(_halves("d", "g1", "g2"), SUMS)],
                    F.floor((F.col("d") - 1) / BLOCK).alias("part"))
    block = x.groupBy("c", "part").agg(*[F.sum(s).alias(s) for s in SUMS])
    later = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only conversations of several blocks have a carry
    carry = block.select("c", "part", *[F.sum(s).over(later).alias("b" + s) for s in SUMS]).where("part > 0")
    inside = Window.partitionBy("c", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    total = [F.sum(s).over(inside) + F.coalesce("b" + s, F.lit(0)) for s in SUMS]
    x = x.join(carry, ["c", "part"], "left").select("c", "d", "words", *SUMS, *[t.alias("t" + s) for t, s in zip(total, SUMS)])
    here, there = [F.col("t" + s) for s in SUMS], [F.col("t" + s) - F.col(s) for s in SUMS]
    x = x.select("c", "d", "words", *[k.alias(n) for k, n in zip(_key(F.col("d"), here), KEY)],
                 *[k.alias(n) for k, n in zip(_key(F.col("d") - 1, there), ("p1", "p2"))])
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    top = convs.select("c", zero.alias("d"), zero.alias("words"),
                       *[k.alias(n) for k, n in zip(_key(zero, [zero] * 4), KEY)], none.alias("p1"), none.alias("p2"))
    return x.unionByName(top)


def _in_bands(path: DataFrame, nodes: DataFrame, band: int) -> DataFrame:
    """k1, k2, m, d, leaves, saved of every node: totals over its descendants
    inside its band, itself included."""
    zero = F.lit(0).cast("bigint")
    both = path.select("c", "d", *KEY, zero.alias("leaves"), zero.alias("saved"), zero.alias("own")).unionByName(
        nodes.select(F.col("m").alias("c"), "d", *KEY, "leaves", "saved", F.lit(1).cast("bigint").alias("own")))
    below = Window.partitionBy("c", "band").orderBy(F.col("d").desc()).rangeBetween(Window.unboundedPreceding, 0)
    add = ["leaves", "saved", "own"]
    got = both.withColumn("band", F.floor(F.col("d") / band)).select(
        "c", "d", *KEY, F.col("own").alias("node"), *[F.sum(a).over(below).alias(a) for a in add])
    return got.where("node = 0 AND own > 0").groupBy(*KEY).agg(
        F.min("c").alias("m"), F.min("d").alias("d"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def roll_up(path: DataFrame, nodes: DataFrame, deepest: int, band: int = BAND) -> DataFrame:
    """k1, k2, m, d, leaves, saved of every node summed over its whole subtree.
    ``path``: c, d, k1, k2 of every prefix; ``nodes``: m (smallest member), d,
    k1, k2 and the node's own leaves and saved."""
    inner = _in_bands(path, nodes, band)
    if deepest < band:
        return inner
    inner = cut_lineage(inner)
    up = (F.col("d") / band).cast("bigint")
    tops = roll_up(path.where(F.col("d") % band == 0).withColumn("d", up),
                   inner.where(F.col("d") % band == 0).withColumn("d", up), deepest // band, band)
    above = tops.where("d > 0").select(F.col("m").alias("c"), (F.col("d") - 1).alias("band"), "leaves", "saved")
    credit = path.withColumn("band", F.floor(F.col("d") / band)).join(above, ["c", "band"]) \
        .select(*KEY, F.lit(None).cast("bigint").alias("m"), "d", "leaves", "saved")
    return cut_lineage(inner.select(*KEY, "m", "d", "leaves", "saved").unionByName(credit).groupBy(*KEY).agg(
        F.min("m").alias("m"), F.min("d").alias("d"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))


def _digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the nodes where conversations end: ids ascending,
    comma-joined. Ids come as blocks of at most 2^ID_BITS, in order, and are
    hashed one block after the other."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    blocks = ends.groupBy(*KEY, F.shiftright("c", ID_BITS).alias("block")).agg(text.alias("ids"))
    blocks = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")

    def run(batches):
        now, digest, out = None, None, []

        def flush():
            k1, k2, hexes = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(hexes)],
                                              names=[*KEY, "ends_sha256"])
        for b in batches:
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids"))):
                if (k1, k2) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (k1, k2), hashlib.sha256(ids.encode())
            if len(out) > 4096:
                yield flush()
                out = []
        if now is not None:
            out.append((*now, digest.hexdigest()))
            yield flush()

    return blocks.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                band: int = BAND) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    path = cut_lineage(paths(*rebuilt(turns, conv, turn, role, text)))
    nodes = cut_lineage(path.groupBy(*KEY).agg(
        F.min("c").alias("m"), F.count(F.lit(1)).alias("n_convs"), F.min("d").alias("d"), F.min("words").alias("words"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2")))
    below = nodes.where("d > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(below, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))
    count, deepest = nodes.agg(F.count(F.lit(1)), F.max("d")).first()
    own = nodes.select("m", "d", *KEY, (F.col("n_children") == 0).cast("bigint").alias("leaves"),
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    total = roll_up(path.select("c", "d", *KEY), own, deepest or 0, band).select(*KEY, "leaves", "saved")
    last = path.groupBy("c").agg(F.max_by(F.struct(*KEY), "d").alias("k")).select("c", "k.*")
    parent = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                                                  F.col("m").alias("parent_conv_id"), F.col("n_children").alias("children"))
    # parents of many children (fewer than SHARE) are joined by broadcast, so the shuffle meets small keys only
    many = F.col("children") > (count or 0) // SHARE
    big, small = (F.broadcast(parent.where(many)).drop("children"), parent.where(~many).drop("children"))
    named = nodes.join(big, ["p1", "p2"]).unionByName(
        nodes.join(big.drop("parent_conv_id"), ["p1", "p2"], "left_anti").join(small, ["p1", "p2"], "left"))
    return named.join(total, KEY).join(_digests(last), KEY, "left").select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
