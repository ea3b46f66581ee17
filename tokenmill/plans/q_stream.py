"""Registered queries: the streaming operators run to completion with an
availableNow trigger over files derived from the tables (ST1, ST2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tokenmill.constants import UNK_ID
from tokenmill.functions import WS_CLASS, round6
from tokenmill.operators import vocab as V
from tokenmill.plans import fixtures as FX
from tokenmill.plans.q_runs import _SQL_EARLY
from tokenmill.plans.registry import register
from tokenmill.session import checkpoint_dir, cut_lineage
from tokenmill.sources import read_table
from tokenmill.streaming.early_stop_stream import early_stop_stream, latest_state
from tokenmill.streaming.encode_stream import encode_stream, read_encoded

N_FILES = 4


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def arrivals(df, path, order_col, n=N_FILES):
    """Write ``df`` in n parts, one write per range of ``order_col`` (in order), and
    hand over after each, so a file stream sees them arrive one after another: a part
    is one micro-batch, however many files its tasks wrote. The bounds are
    approximate (bounded sketches); rows without an order value come first."""
    bounds = sorted(set(df.approxQuantile(order_col, [i / n for i in range(1, n)], 0.01)))
    lo = None
    for i, hi in enumerate(bounds + [None]):
        part = df
        if lo is not None:
            part = part.where(F.col(order_col) > lo)
        if hi is not None:
            part = part.where((F.col(order_col) <= hi) | (F.col(order_col).isNull() & F.lit(lo is None)))
        elif lo is None:
            part = df
        part.write.mode("overwrite").parquet(f"{path}/part={i:04d}")
        yield i
        lo = hi


@register("encode_stream", sql=f"""
WITH cv AS (SELECT row_number() OVER (ORDER BY token) - 1 AS id, token FROM (
   SELECT DISTINCT unnest(string_split(text, '')) AS token FROM conversations WHERE text <> '')),
cvm AS (SELECT map_from_entries(list({{'k': token, 'v': id}})) AS m FROM cv),
s AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g') AS clean
      FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(string_split(clean, ''), lambda c: m[c]), ' ') AS ids
FROM s, cvm WHERE clean <> ''""")
def q_encode_stream(spark, sf):
    """ST1 over conversations arriving as several files."""
    conv = read_table(spark, sf, "conversations")
    look = V.char_lookup(V.char_vocab(conv, "text"), unk_id=UNK_ID)  # the vocabulary is collected once
    src = _scratch(spark, "conv-in")
    out, ck = _scratch(spark, "conv-out"), _scratch(spark, "conv-ck")
    for _ in arrivals(conv, src, "conv_id"):
        stream = spark.readStream.schema(conv.schema).parquet(src)
        q = encode_stream(stream,
                          lambda df, col: df.withColumn("ids", look(col)), out, ck, ("conv_id", "turn"))
        q.awaitTermination()
    return read_encoded(spark, out).select("conv_id", "turn", "ids")


@register("early_stop_stream", sql=_SQL_EARLY)
def q_early_stop_stream(spark, sf):
    """ST2 over the epochs fixture arriving in several parts, the stream going on from
    its checkpoint after each; the final state per run must equal the batch
    early_stop."""
    # every part is cut from the same rows, which are numbered once
    ep = cut_lineage(FX.epochs(spark, sf).select("run", "epoch", "val"))
    src = _scratch(spark, "epochs-in")
    out, ck = _scratch(spark, "es-out"), _scratch(spark, "es-ck")
    for _ in arrivals(ep, src, "epoch"):
        stream = spark.readStream.schema("run bigint, epoch bigint, val double").parquet(src)
        q = early_stop_stream(stream, out, ck, patience=5, min_delta=0.001)
        q.awaitTermination()
    st = latest_state(spark, out)
    return st.select("run", round6("best").alias("best"), "best_epoch", "stop_epoch", "last_epoch")
