"""Scoring and aggregation over score tables (L1-L9) and per-row picks
(D1, D2, D6). Score table: one row per (sequence, position) with
``logits array<float>`` and a 0-based ``target``. Every aggregate here is a
partial + final hash aggregate (map-side combine), so a hot batch or sequence
never lands whole in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.constants import PAD_ID
from tokenmill.functions.scores import argmax, let, logsumexp, softmax, token_xent, top_k, uniform_hash


def with_xent(scores: DataFrame, logits: str = "logits", target: str = "target") -> DataFrame:
    return scores.withColumn("xent", token_xent(logits, target))


def token_xent_table(scores: DataFrame, ignore_id: int = PAD_ID) -> DataFrame:
    """L1: per-token cross-entropy; rows whose target is the ignore id drop out."""
    return with_xent(scores.where(F.col("target") != ignore_id))


def corpus_loss(scores: DataFrame, ignore_id: int = PAD_ID) -> DataFrame:
    """L2: sum(loss) / max(1, non-pad tokens) over the whole corpus. ``scores``
    holds logits, or the targets' logp as a scorer (U1) gives them."""
    if "logits" in scores.columns:
        x = token_xent_table(scores, ignore_id)
    else:
        x = scores.where(F.col("target") != ignore_id).select((-F.col("logp")).alias("xent"))
    return x.agg((F.coalesce(F.sum("xent"), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("loss"),
                 F.count(F.lit(1)).alias("ntok"))


def step_loss(scores: DataFrame, batch: str = "batch", ignore_id: int = PAD_ID) -> DataFrame:
    """L3: per batch loss_sum / max(1, ntok); a batch of only pads gives 0."""
    x = with_xent(scores)
    keep = F.col("target") != ignore_id
    return x.groupBy(batch).agg(
        F.sum(F.when(keep, F.col("xent")).otherwise(0.0)).alias("loss_sum"),
        F.sum(F.when(keep, 1).otherwise(0)).cast("bigint").alias("ntok"),
    ).withColumn("loss", F.col("loss_sum") / F.greatest(F.col("ntok"), F.lit(1)))


def mean_of_batch_means(scores: DataFrame, batch: str = "batch") -> DataFrame:
    """L4 (char-LM estimator): unweighted mean of per-batch mean loss with NO
    pad masking; a short last batch counts as much as a full one."""
    per = with_xent(scores).groupBy(batch).agg(F.avg("xent").alias("batch_loss"))
    return per.agg(F.avg("batch_loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def perplexity(loss_col) -> F.Column:
    """exp(mean loss)."""
    return F.exp(F.col(loss_col) if isinstance(loss_col, str) else loss_col)


def softmax_profile(scores: DataFrame, temperature: float = 0.8) -> DataFrame:
    """Log-softmax and tempered softmax summaries per row."""
    lse = logsumexp("logits")
    p = softmax("logits", temperature)
    return scores.select(
        "vec_id", lse.alias("lse"),
        (F.element_at("logits", (F.col("target") + 1).cast("int")).cast("double") - lse).alias("logp_target"),
        (F.array_max("logits").cast("double") - lse).alias("logp_max"),
        F.array_max(p).alias("p_max_temp"),
        (-F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))).alias("entropy_temp"))


def prefix_diff(a: DataFrame, b: DataFrame, prefix_len: int = 6, tol: float = 1e-5,
                seq: str = "seq_id", pos: str = "pos", logits: str = "logits") -> DataFrame:
    """Max |a - b| over positions < prefix_len per sequence; pass when
    <= tol. Full outer join, so a cell missing on either side fails."""
    la = a.where(F.col(pos) < prefix_len).select(seq, pos, F.col(logits).alias("la"))
    lb = b.where(F.col(pos) < prefix_len).select(seq, pos, F.col(logits).alias("lb"))
    j = la.join(lb, [seq, pos], "full_outer")
    d = F.when(F.col("la").isNull() | F.col("lb").isNull() | (F.size("la") != F.size("lb")), F.lit(float("inf"))) \
        .otherwise(F.array_max(F.zip_with("la", "lb", lambda x, y: F.abs(x.cast("double") - y.cast("double")))))
    per = j.groupBy(seq).agg(F.max(d).alias("max_diff"))
    return per.withColumn("passed", (F.col("max_diff") <= F.lit(tol)).cast("int"))


def length_stats(lengths: DataFrame, col: str = "len") -> DataFrame:
    """N, mean, UPPER median (sorted[n//2]), share of 0 and share <= 2."""
    n = F.count(F.lit(1))
    return lengths.agg(
        n.alias("n"), F.avg(col).alias("avg_len"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col} DESC)").cast("bigint").alias("p50"),
        (F.sum(F.when(F.col(col) == 0, 1).otherwise(0)) / n).alias("zero_ratio"),
        (F.sum(F.when(F.col(col) <= 2, 1).otherwise(0)) / n).alias("le2_ratio"))


def argmax_next(scores: DataFrame) -> DataFrame:
    """Best id per row (ties -> lowest id)."""
    return scores.select("vec_id", argmax("logits").alias("best_id"),
                         F.array_max("logits").cast("double").alias("best_score"))


def top_k_table(scores: DataFrame, k: int) -> DataFrame:
    """The k best ids per row with their scores, best first."""
    return scores.select("vec_id", top_k("logits", k).alias("top"))


def topk_sample(scores: DataFrame, key: str = "vec_id", k: int = 50, temperature: float = 0.8,
                seed: int = 1337) -> DataFrame:
    """softmax(logits/T) -> top k -> renormalise -> draw with a seeded
    hash-uniform u: the first id whose running probability (prob desc, id asc)
    exceeds u; the last one if rounding leaves none."""
    p = softmax("logits", temperature)
    keyed = F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.cast("bigint").alias("id")))
    u = uniform_hash(seed, key)

    def draw(best):
        def with_total(tot):
            init = F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("bigint").alias("pick"))

            def step(st, s):
                acc = st["acc"] - s["neg"] / tot
                return F.struct(acc.alias("acc"),
                                F.when(st["pick"].isNull() & (acc > F.col("_u")), s["id"]).otherwise(st["pick"]).alias("pick"))
            return F.coalesce(F.aggregate(best, init, step)["pick"], F.element_at(best, -1)["id"])
        return let(F.aggregate(best, F.lit(0.0), lambda a, s: a - s["neg"]), with_total)

    drawn = let(F.slice(F.array_sort(keyed), 1, k), draw)
    return scores.withColumn("_u", u).select(key, F.col("_u").alias("u"), drawn.alias("sampled_id"))
