"""Fixtures derived from the driver tables (FIXTURES.md), each with the
DuckDB CTE that defines the same rows for the oracle.

Every fixture reads whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.functions import char_tokens, flatten_newlines
from tokenmill.operators.indexing import sequence_index
from tokenmill.sources import read_table


# ---------------------------------------------------------------- F1 pairs
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turn + the assistant turn that follows it. "Follows" is the
    equi-join on turn + 1 (turns are dense), which partitions on
    (conv_id, turn) so one enormous conversation cannot land in one task, as a
    ``lead`` window partitioned by conv_id would."""
    conv = read_table(spark, sf, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"), "src", "tgt")


SQL_PAIRS = """pairs AS (
  SELECT u.conv_id * 100 + u.turn AS pair_id, u.text AS src, a.text AS tgt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


# ---------------------------------------------------------------- F3 scores
def scores(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select(
        "vec_id",
        F.expr("vec_id div 10").alias("seq_id"),
        (F.col("vec_id") % 10).alias("pos"),
        F.expr("vec_id div 32").alias("batch"),
        F.col("embedding").alias("logits"),
        F.col("label").cast("bigint").alias("target"),
    )


SQL_SCORES = """scores AS (
  SELECT vec_id, vec_id // 10 AS seq_id, vec_id % 10 AS pos, vec_id // 32 AS batch,
         embedding AS logits, CAST(label AS BIGINT) AS target FROM embeddings)"""


# ---------------------------------------------------------------- F4 next_scores
def next_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Character bigram log-probabilities per language over WHOLE documents:
    <s> + characters (newline -> space) + </s>."""
    d = read_table(spark, sf, "documents")
    toks = F.concat(F.array(F.lit("<s>")), char_tokens(flatten_newlines("text")), F.array(F.lit("</s>")))
    t = d.select("lang", toks.alias("t"))
    pairs_ = t.select("lang", F.explode(F.arrays_zip(
        F.slice("t", F.lit(1), F.size("t") - 1).alias("prev"),
        F.slice("t", F.lit(2), F.size("t") - 1).alias("nxt"))).alias("p"))
    counts = pairs_.groupBy("lang", F.col("p.prev").alias("prev"), F.col("p.nxt").alias("nxt")).agg(
        F.count(F.lit(1)).alias("n"))
    # The grouped bigram table is bounded by languages x characters^2.
    tot = F.sum("n").over(Window.partitionBy("lang", "prev"))
    return counts.select("lang", "prev", "nxt", F.round(F.ln(F.col("n") / tot), 9).alias("logp"))


SQL_NEXT_SCORES = """nx_tok AS (
  SELECT lang, list_concat(['<s>'], CASE WHEN text = '' THEN []::VARCHAR[]
           ELSE string_split(replace(text, chr(10), ' '), '') END, ['</s>']) AS t FROM documents),
nx_pair AS (SELECT lang, t[i] AS prev, t[i + 1] AS nxt
            FROM (SELECT lang, t, unnest(generate_series(1, len(t) - 1)) AS i FROM nx_tok)),
nx_cnt AS (SELECT lang, prev, nxt, count(*) AS n FROM nx_pair GROUP BY ALL),
next_scores AS (SELECT lang, prev, nxt, round(ln(n / sum(n) OVER (PARTITION BY lang, prev)), 9) AS logp
                FROM nx_cnt)"""


# ---------------------------------------------------------------- F5 hyp/ref
def hyp_ref(spark: SparkSession, sf: str) -> DataFrame:
    """ref = assistant text of F1; hyp = ref without every 7th space-split word."""
    p = pairs(spark, sf)
    words = F.split(F.col("tgt"), " ")
    hyp = F.array_join(F.filter(words, lambda w, i: (i + 1) % 7 != 0), " ")
    return p.select("pair_id", hyp.alias("hyp"), F.col("tgt").alias("ref"))


SQL_HYP_REF = SQL_PAIRS + """,
hyp_ref AS (
  SELECT pair_id, array_to_string(list_filter(string_split(tgt, ' '), lambda w, i: i % 7 <> 0), ' ') AS hyp,
         tgt AS ref FROM pairs)"""


# ---------------------------------------------------------------- F6 epochs
def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """run = user, epoch = 1-based order of the user's events by (ts, event_id)."""
    ev = read_table(spark, sf, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id", "event_type", F.col("value").alias("val"))
    ix = sequence_index(ev, ["ts", "event_id"], ["run"], name="epoch", start=1)
    return ix.select("run", "epoch", "val", "event_type", "event_id")


SQL_EPOCHS = """epochs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
         value AS val, event_type, event_id FROM events)"""


# ---------------------------------------------------------------- F7 log lines
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = epochs(spark, sf)
    loss = F.col("val") / F.lit(100.0)
    line = (F.when(F.col("event_type") == "purchase",
                   F.format_string("VAL BLEU (full test set): %.2f", F.col("val")))
            .when(F.col("event_type") == "error", F.lit("VAL loss: nan, ppl=nan"))
            .otherwise(F.format_string("VAL loss: %.4f, ppl=%.2f", loss, F.exp(loss))))
    return e.select("run", F.col("epoch").alias("line_no"), line.alias("line"))


SQL_LOG_LINES = SQL_EPOCHS + """,
log_lines AS (
  SELECT run, epoch AS line_no,
         CASE WHEN event_type = 'purchase' THEN printf('VAL BLEU (full test set): %.2f', val)
              WHEN event_type = 'error' THEN 'VAL loss: nan, ppl=nan'
              ELSE printf('VAL loss: %.4f, ppl=%.2f', val / 100.0, exp(val / 100.0)) END AS line
  FROM epochs)"""
