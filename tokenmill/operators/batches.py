"""Windows, splits, batches, sampling and limits (W1-W10, E6, E9 stats)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.constants import PAD_ID, SEED_ORDER, SEED_SUBSET
from tokenmill.functions import order_hash, pad_to, uniform_hash
from tokenmill.operators.indexing import sequence_index


def chunk_windows(df: DataFrame, col: str = "text", seq_len: int = 128, stride: int | None = None,
                  key: str = "doc_id") -> DataFrame:
    """Fixed-length windows: count = max(0, (n - seq_len) div stride);
    x = [i*stride, +seq_len), y = x shifted by one character."""
    stride = stride or seq_len
    n = F.length(col)
    count = F.floor(F.greatest((n - F.lit(seq_len)).cast("double") / F.lit(float(stride)), F.lit(0.0))).cast("int")
    # Code-point substrings of a long UTF-8 string are found by walking from
    # its start, so cutting every window from the whole text is quadratic in
    # the document length. The text is cut once into stride-sized blocks
    # (one regex pass); each window joins the few blocks it spans.
    span = -(-(seq_len + 1) // stride)  # blocks covering x and the shifted y
    src = df.select(key, count.alias("_cnt"),
                    F.regexp_extract_all(col, F.lit(f"(?s).{{1,{int(stride)}}}"), 0).alias("_b")).where(F.col("_cnt") > 0)
    w = src.select(key, F.explode(F.expr(
        f"transform(sequence(0, _cnt - 1), i -> named_struct('window_id', i, 'start', CAST(i * {int(stride)} AS BIGINT), "
        f"'s', array_join(slice(_b, i + 1, {span}), '')))")).alias("w"))
    return w.select(key, "w.window_id", "w.start", F.substring("w.s", 1, seq_len).alias("x"),
                    F.substring("w.s", 2, seq_len).alias("y"))


def offset_split(df: DataFrame, col: str = "text", fracs=(0.8, 0.9), key: str = "doc_id") -> DataFrame:
    """Contiguous split by character offset [0,a), [a,b), [b,n) with
    a = int(0.8 n), b = int(0.9 n) computed in double like the reference."""
    n = F.length(col).cast("double")
    a = F.floor(F.lit(float(fracs[0])) * n).cast("int")
    b = F.floor(F.lit(float(fracs[1])) * n).cast("int")
    parts = F.array(
        F.struct(F.lit("train").alias("split"), F.expr("1").alias("_s"), a.alias("_l")),
        F.struct(F.lit("val").alias("split"), (a + 1).alias("_s"), (b - a).alias("_l")),
        F.struct(F.lit("test").alias("split"), (b + 1).alias("_s"), (F.length(col) - b).alias("_l")))
    ex = df.select(key, col, F.explode(parts).alias("p"))
    return ex.select(key, F.col("p.split").alias("split"),
                     F.expr(f"substring({col}, p._s, p._l)").alias("part"))


def assign_split(df: DataFrame, key: str, seed: int = SEED_ORDER, fracs=(0.8, 0.9)) -> DataFrame:
    """Hash-defined named split per key: train / validation / test."""
    u = uniform_hash(seed, key)
    return df.withColumn("split", F.when(u < fracs[0], "train").when(u < fracs[1], "validation").otherwise("test"))


def pick_split(df: DataFrame, split: str) -> DataFrame:
    """Named split choice ('val' is an alias of 'validation')."""
    name = {"val": "validation"}.get(split, split)
    return df.where(F.col("split") == name)


def sequential_batches(df: DataFrame, order, size: int = 32) -> DataFrame:
    """Unshuffled order; batch = row index div size (last batch may be short)."""
    order = [order] if isinstance(order, str) else list(order)
    ix = sequence_index(df, order, name="row_idx")
    return ix.withColumn("batch", F.expr(f"row_idx div {int(size)}"))


def shuffled_batches(df: DataFrame, key: str, size: int = 32, seed: int = SEED_ORDER,
                     epoch: int = 1) -> DataFrame:
    """Seeded shuffle (md5('seed:epoch:key'), key) then W4; a new order per epoch."""
    keyed = df.withColumn("_ord", order_hash(seed, F.lit(epoch), key))
    return sequential_batches(keyed, ["_ord", key], size).drop("_ord")


def capped_sample(df: DataFrame, key_cols, max_batches: int = 200, size: int = 32,
                  seed: int = SEED_SUBSET) -> DataFrame:
    """Seeded sample without replacement of min(n, max_batches*size) rows.
    The limit is the feature; Spark plans it as a bounded top-k."""
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    k = int(max_batches) * int(size)
    return (df.withColumn("_ord", order_hash(seed, *key_cols))
            .orderBy("_ord", *key_cols).limit(k).drop("_ord"))


def first_n(df: DataFrame, order, n: int | None = -1) -> DataFrame:
    """First n rows in order; n <= 0 or None keeps all."""
    order = [order] if isinstance(order, str) else list(order)
    if n is None or n <= 0:
        return df
    return df.orderBy(*order).limit(int(n))


def pad_batches(df: DataFrame, batch: str = "batch", src: str = "src_ids", tgt: str = "tgt_ids",
                pad: int = PAD_ID) -> DataFrame:
    """Pad src to the batch max, tgt_in/tgt_out to batch max - 1. A batch
    holds at most ``size`` rows, so the batch window is bounded."""
    w = Window.partitionBy(batch)
    max_src = F.max(F.size(src)).over(w)
    max_tgt = F.max(F.size(tgt)).over(w)
    n = F.greatest(F.size(tgt) - 1, F.lit(0))
    tin = F.slice(tgt, F.lit(1), n)
    tout = F.slice(tgt, F.lit(2), n)
    return df.select("*", pad_to(src, max_src, pad).alias("src_pad"),
                     pad_to(tin, max_tgt - 1, pad).alias("tgt_in_pad"),
                     pad_to(tout, max_tgt - 1, pad).alias("tgt_out_pad"))


def batch_stats(df: DataFrame, batch: str = "batch", src: str = "src_ids", tgt: str = "tgt_ids") -> DataFrame:
    """Per batch rows, max src length, max tgt length, non-pad target tokens."""
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size(src)).cast("bigint").alias("max_src"),
        F.max(F.size(tgt)).cast("bigint").alias("max_tgt"),
        F.sum(F.greatest(F.size(tgt) - 1, F.lit(0))).cast("bigint").alias("target_tokens"))


def global_step(batches: DataFrame, n_epochs: int, batch: str = "batch") -> DataFrame:
    """step = (epoch-1)*n_batches + batch + 1 for every epoch and batch."""
    # batches are dense 0..nb-1, so nb is one scalar aggregate
    nb = batches.agg(F.max(batch)).first()[0]
    nb = 0 if nb is None else int(nb) + 1
    b = batches.select(batch).distinct()
    e = b.select(batch, F.explode(F.sequence(F.lit(1), F.lit(int(n_epochs)))).alias("epoch"))
    return e.select("epoch", batch,
                    ((F.col("epoch") - 1) * F.lit(nb) + F.col(batch) + 1).cast("bigint").alias("step"))
