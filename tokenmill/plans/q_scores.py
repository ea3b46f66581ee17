"""Registered queries: scoring over the score fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.functions import round6
from tokenmill.operators import scoring as S
from tokenmill.plans import fixtures as FX
from tokenmill.plans.registry import register, with_ctes
from tokenmill.functions import clean_ids, wrap_truncate

# DuckDB: per-row max-shifted log-sum-exp over FLOAT logits, in double.
_SQL_X = FX.SQL_SCORES + """,
sm AS (SELECT *, list_max(logits)::DOUBLE AS m FROM scores),
sx AS (SELECT *, m + ln(list_sum(list_transform(logits, lambda v: exp(v::DOUBLE - m)))) AS lse FROM sm),
xe AS (SELECT *, lse - logits[target + 1]::DOUBLE AS xent FROM sx)"""


@register("token_xent", sql=with_ctes(_SQL_X) + "SELECT vec_id, round(xent, 6) AS xent FROM xe WHERE target <> 0")
def q_token_xent(spark, sf):
    x = S.token_xent_table(FX.scores(spark, sf))
    return x.select("vec_id", round6("xent").alias("xent"))


@register("corpus_loss", sql=with_ctes(_SQL_X) + """
SELECT round(coalesce(sum(xent), 0) / greatest(count(*), 1), 6) AS loss, count(*) AS ntok FROM xe WHERE target <> 0""")
def q_corpus_loss(spark, sf):
    c = S.corpus_loss(FX.scores(spark, sf))
    return c.select(round6("loss").alias("loss"), "ntok")


@register("step_loss", sql=with_ctes(_SQL_X) + """
SELECT batch, round(sum(CASE WHEN target <> 0 THEN xent ELSE 0 END), 6) AS loss_sum,
       CAST(sum(CASE WHEN target <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS ntok,
       round(sum(CASE WHEN target <> 0 THEN xent ELSE 0 END) / greatest(sum(CASE WHEN target <> 0 THEN 1 ELSE 0 END), 1), 6) AS loss
FROM xe GROUP BY batch""")
def q_step_loss(spark, sf):
    s = S.step_loss(FX.scores(spark, sf))
    return s.select("batch", round6("loss_sum").alias("loss_sum"), "ntok", round6("loss").alias("loss"))


@register("mean_of_batch_means", sql=with_ctes(_SQL_X) + """
SELECT round(avg(bl), 6) AS loss, count(*) AS n_batches FROM (SELECT batch, avg(xent) AS bl FROM xe GROUP BY batch)""")
def q_mean_of_batch_means(spark, sf):
    m = S.mean_of_batch_means(FX.scores(spark, sf))
    return m.select(round6("loss").alias("loss"), "n_batches")


@register("perplexity", sql=with_ctes(_SQL_X) + """
SELECT round(l, 6) AS loss, round(exp(l), 6) AS ppl FROM (
  SELECT coalesce(sum(xent), 0) / greatest(count(*), 1) AS l FROM xe WHERE target <> 0)""")
def q_perplexity(spark, sf):
    c = S.corpus_loss(FX.scores(spark, sf))
    return c.select(round6("loss").alias("loss"), round6(S.perplexity("loss")).alias("ppl"))


@register("log_softmax", sql=with_ctes(_SQL_X) + """,
tp AS (SELECT *, list_transform(logits, lambda v: exp((v::DOUBLE - m) / 0.8::DOUBLE)) AS ex FROM xe),
tq AS (SELECT *, list_transform(ex, lambda v: v / list_sum(ex)) AS p FROM tp)
SELECT vec_id, round(lse, 6) AS lse, round(logits[target + 1]::DOUBLE - lse, 6) AS logp_target,
       round(m - lse, 6) AS logp_max, round(list_max(p), 6) AS p_max_temp,
       round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 6) AS entropy_temp
FROM tq""".replace("\n,\ntp", ",\ntp"))
def q_log_softmax(spark, sf):
    p = S.softmax_profile(FX.scores(spark, sf), 0.8)
    return p.select("vec_id", *[round6(c).alias(c) for c in ["lse", "logp_target", "logp_max", "p_max_temp", "entropy_temp"]])


def _perturbed(scores, where):
    return scores.withColumn("logits", F.when(where, F.transform("logits", lambda x: x + F.lit(1e-3).cast("float")))
                             .otherwise(F.col("logits")))


@register("prefix_diff", sql=with_ctes(FX.SQL_SCORES) + """,
b1 AS (SELECT seq_id, pos, CASE WHEN pos >= 6 THEN list_transform(logits, lambda x: x + 0.001::FLOAT) ELSE logits END AS lb FROM scores),
b2 AS (SELECT seq_id, pos, CASE WHEN pos = 3 THEN list_transform(logits, lambda x: x + 0.001::FLOAT) ELSE logits END AS lb FROM scores),
d AS (
  SELECT 'suffix' AS probe, s.seq_id, s.pos, s.logits AS la, b.lb FROM scores s JOIN b1 b USING (seq_id, pos) WHERE s.pos < 6
  UNION ALL
  SELECT 'prefix', s.seq_id, s.pos, s.logits, b.lb FROM scores s JOIN b2 b USING (seq_id, pos) WHERE s.pos < 6)
SELECT probe, seq_id, round(max(list_max(list_transform(list_zip(la, lb), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)))), 6) AS max_diff,
       CAST(max(list_max(list_transform(list_zip(la, lb), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)))) <= 1e-5 AS INT) AS passed
FROM d GROUP BY probe, seq_id""".replace("\n,\nb1", ",\nb1"))
def q_prefix_diff(spark, sf):
    s = FX.scores(spark, sf)
    out = None
    for probe, where in [("suffix", F.col("pos") >= 6), ("prefix", F.col("pos") == 3)]:
        r = S.prefix_diff(s, _perturbed(s, where), 6, 1e-5).select(
            F.lit(probe).alias("probe"), "seq_id", round6("max_diff").alias("max_diff"), "passed")
        out = r if out is None else out.unionByName(r)
    return out


@register("length_stats", sql=with_ctes(FX.SQL_HYP_REF) + """
SELECT count(*) AS n, round(avg(len), 6) AS avg_len, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY len DESC) AS BIGINT) AS p50,
       round(sum(CASE WHEN len = 0 THEN 1 ELSE 0 END) / count(*), 6) AS zero_ratio,
       round(sum(CASE WHEN len <= 2 THEN 1 ELSE 0 END) / count(*), 6) AS le2_ratio
FROM (SELECT least(length(hyp), 126) AS len FROM hyp_ref)""")
def q_length_stats(spark, sf):
    """Lengths of cleaned hypothesis ids (char-encoded, wrapped at 128)."""
    from tokenmill.operators import vocab as V
    from tokenmill.plans.q_text import pair_vocab
    h = FX.hyp_ref(spark, sf)
    v = pair_vocab(FX.pairs(spark, sf))
    e = V.char_encode(h, "hyp", v, "hyp_raw")
    lens = e.select(F.size(clean_ids(wrap_truncate("hyp_raw", 128))).alias("len"))
    st = S.length_stats(lens, "len")
    return st.select("n", round6("avg_len").alias("avg_len"), "p50", round6("zero_ratio").alias("zero_ratio"),
                     round6("le2_ratio").alias("le2_ratio"))


@register("argmax_next", sql=with_ctes(FX.SQL_SCORES) + """
SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS best_id, round(list_max(logits)::DOUBLE, 6) AS best_score
FROM scores""")
def q_argmax_next(spark, sf):
    a = S.argmax_next(FX.scores(spark, sf))
    return a.select("vec_id", "best_id", round6("best_score").alias("best_score"))


@register("top_k", sql=with_ctes(FX.SQL_SCORES) + """
SELECT vec_id, array_to_string(list_transform(list_slice(list_sort(list_transform(logits, lambda x, i: {'neg': -x::DOUBLE, 'id': i - 1})), 1, 4),
                                        lambda s: s.id), ' ') AS top_ids,
       round(-list_sort(list_transform(logits, lambda x, i: {'neg': -x::DOUBLE, 'id': i - 1}))[4].neg, 6) AS fourth_score
FROM scores""")
def q_top_k(spark, sf):
    t = S.top_k_table(FX.scores(spark, sf), 4)
    return t.select("vec_id", F.array_join(F.transform("top", lambda s: s["id"].cast("string")), " ").alias("top_ids"),
                    round6(F.element_at("top", 4)["score"]).alias("fourth_score"))


@register("topk_sample", sql=with_ctes(_SQL_X) + """,
tp AS (SELECT vec_id, list_transform(logits, lambda v: exp((v::DOUBLE - m) / 0.8::DOUBLE)) AS ex FROM xe),
tq AS (SELECT vec_id, list_transform(ex, lambda v: v / list_sum(ex)) AS p FROM tp),
tk AS (SELECT vec_id, list_slice(list_sort(list_transform(p, lambda x, i: {'neg': -x, 'id': i - 1})), 1, 50) AS best,
              (('0x' || substr(md5('1337:' || CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0) AS u FROM tq),
tt AS (SELECT *, list_sum(list_transform(best, lambda s: -s.neg)) AS tot FROM tk),
run AS (SELECT vec_id, u, unnest(best).id AS id, unnest(generate_series(1, len(best))) AS k,
               unnest(list_transform(best, lambda s: -s.neg / tot)) AS q FROM tt),
cum AS (SELECT vec_id, u, id, k, sum(q) OVER (PARTITION BY vec_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS acc FROM run)
SELECT vec_id, round(u, 6) AS u, coalesce(min_by(id, k) FILTER (WHERE acc > u), max_by(id, k)) AS sampled_id
FROM cum GROUP BY vec_id, u""".replace("\n,\ntp", ",\ntp"))
def q_topk_sample(spark, sf):
    t = S.topk_sample(FX.scores(spark, sf), "vec_id", 50, 0.8, 1337)
    return t.select("vec_id", round6("u").alias("u"), "sampled_id")
