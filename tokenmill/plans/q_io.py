"""Registered queries: sources and sinks (S1, S2, S4-S7), bulk translation
(D8) and the user-scorer plumbing (U1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tokenmill.constants import PAD_ID
from tokenmill.functions import wrap_truncate
from tokenmill.operators import bpe as BP
from tokenmill.operators import frontier as FR
from tokenmill.operators import decode as D
from tokenmill.operators import runs as R
from tokenmill.operators.batches import assign_split, pad_batches, sequential_batches
from tokenmill.plans import fixtures as FX
from tokenmill.plans.q_bpe import trained
from tokenmill.plans.q_runs import SQL_RESULTS, metrics, results
from tokenmill.sources.corpus import corpus_flatten
from tokenmill.plans.registry import register, with_ctes
from tokenmill.session import checkpoint_dir, cut_lineage
from tokenmill.sources import corpus as C
from tokenmill.sources import logs as LG
from tokenmill.sources import read_table


def _scratch(spark, name):
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex}"


_SQL_SPLIT = "(('0x' || substr(md5('1337:' || CAST(pair_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"


@register("read_pairs", sql=with_ctes(FX.SQL_PAIRS) + f"""
SELECT pair_id, 'train' AS split, src, tgt FROM pairs WHERE {_SQL_SPLIT} < 0.8::DOUBLE""")
def q_read_pairs(spark, sf):
    """The nested corpus written partitioned by split and read back with
    the 'train' split pruned at the scan."""
    path = _scratch(spark, "pairs")
    C.write_pairs(C.shape_pairs(assign_split(FX.pairs(spark, sf), "pair_id")), path)
    return C.read_pairs(spark, path, "en", "zh", "train").select("pair_id", "split", "src", "tgt")


@register("read_document", sql="""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents""")
def q_read_document(spark, sf):
    """Every document written as a file and read back whole: its characters and
    lines (``read_document_pieces`` is the reader for files too large for a row)."""
    path = _scratch(spark, "docs")
    docs = read_table(spark, sf, "documents")
    C.write_documents(docs, "doc_id", "text", path)
    # a task may read as many files as one has written: Spark's own packing takes 32 at most
    back = C.read_document(spark, path, max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    # the writer ends each file with a line break, which is not the document's
    return back.select(
        F.nullif(F.regexp_extract("doc", "doc_id=(-?[0-9]+)", 1), F.lit("")).cast("bigint").alias("doc_id"),
        (F.length("text") - 1).cast("bigint").alias("n_chars"), (F.size(F.split("text", "\n")) - 1).cast("bigint").alias("n_lines"))


@register("read_run_logs", sql=with_ctes(FX.SQL_LOG_LINES) + """
SELECT CAST(run AS VARCHAR) AS run, line_no, line, 'stdout' AS section FROM log_lines""")
def q_read_run_logs(spark, sf):
    """Per-run log files written from the log-line fixture, read back."""
    path = _scratch(spark, "logs")
    LG.write_run_logs(FX.log_lines(spark, sf), path)
    back = LG.read_run_logs(spark, path)
    # the file's first line is the stdout marker, so the n-th line is line n
    return back.where(F.col("line") != "").select("run", "line_no", "line", "section")


@register("write_training_text", sql=with_ctes(FX.SQL_PAIRS) + """
SELECT replace(src, chr(10), ' ') AS value FROM pairs UNION ALL SELECT replace(tgt, chr(10), ' ') FROM pairs""")
def q_write_training_text(spark, sf):
    """The training text written and read back line by line."""
    path = _scratch(spark, "train-text")
    C.write_training_text(corpus_flatten(FX.pairs(spark, sf)), "text", path)
    return spark.read.text(path)


@register("write_leaderboard", sql=with_ctes(SQL_RESULTS) + """
SELECT run, returncode, round(eval_loss, 6) AS eval_loss, round(eval_bleu, 6) AS eval_bleu,
       row_number() OVER (ORDER BY eval_loss IS NULL, eval_loss, run) AS rank FROM results""")
def q_write_leaderboard(spark, sf):
    """Leaderboard CSV (header, rank order) read back with its schema."""
    path = _scratch(spark, "leaderboard")
    lb = R.leaderboard(results(spark, sf)).select("run", "returncode", "eval_loss", "eval_bleu", "rank")
    LG.write_leaderboard(lb, path)
    back = spark.read.option("header", True).schema(
        "run bigint, returncode int, eval_loss double, eval_bleu double, rank bigint").csv(path)
    return back.select("run", "returncode", F.round("eval_loss", 6).alias("eval_loss"),
                       F.round("eval_bleu", 6).alias("eval_bleu"), "rank")


@register("append_metrics", sql=with_ctes(FX.SQL_EPOCHS) + """
SELECT run, 'event/' || event_type AS tag, epoch AS step, CASE WHEN epoch % 7 <> 3 THEN val END AS value FROM epochs""")
def q_append_metrics(spark, sf):
    """Metric scalars appended twice (even and odd steps) and read back."""
    path = _scratch(spark, "metrics")
    m = cut_lineage(metrics(spark, sf))
    LG.append_metrics(m.where(F.col("step") % 2 == 0), path)
    LG.append_metrics(m.where(F.col("step") % 2 == 1), path)
    return LG.read_metrics(spark, path)


# ------------------------------------------------------------------ D8, U1
@register("bulk_translate")
def q_bulk_translate(spark, sf):
    vocab, _ = trained(spark, sf)
    p = FX.pairs(spark, sf)
    enc = BP.bpe_encode(BP.bpe_encode(p, "src", vocab, "src_raw"), "tgt", vocab, "tgt_raw")
    return D.bulk_translate(p, vocab, D.translation_scores(enc), "beam", max_len=128)


@register("score_batches")
def q_score_batches(spark, sf):
    """Padded batches (E6) through a user scorer that sees the whole prefix
    of every target, in the form that ``corpus_loss`` takes (target, logp). The
    scorer's table part comes by a join (``table_scores``), the prefix part from the
    hook."""
    vocab, _ = trained(spark, sf)
    p = FX.pairs(spark, sf)
    enc = cut_lineage(BP.bpe_encode(BP.bpe_encode(p, "src", vocab, "src_raw"), "tgt", vocab, "tgt_raw"))
    ids = enc.select("pair_id", wrap_truncate("src_raw", 128).alias("src_ids"), wrap_truncate("tgt_raw", 128).alias("tgt_ids"))
    # only the key and the id arrays reach the index checkpoint
    padded = pad_batches(sequential_batches(ids, "pair_id", 16), "batch", "src_ids", "tgt_ids")
    bigram = D.translation_scores(enc).groupBy("prev", "nxt").agg(F.max("logp").alias("logp"))
    base = D.table_scores(padded, bigram, "pair_id", "tgt_in_pad", "tgt_out_pad")
    # at most 128 targets a row; those that are not padding come first
    base = base.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("pos", "logp"))).alias("b"))
    rows = padded.join(base.select("pair_id", F.col("b.logp").alias("base")), "pair_id", "left")
    scored = FR.forced_scores(rows, lambda: FR.cached_scores, "pair_id", "tgt_in_pad", "tgt_out_pad", ("base",), pad=PAD_ID)
    return scored.select("pair_id", "pos", "target", F.round("logp", 6).alias("logp"))
