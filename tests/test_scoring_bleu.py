"""Scoring identities and BLEU rules (2.10-E)."""

import math

from pyspark.sql import functions as F

from tokenmill.operators import bleu as BL
from tokenmill.operators import scoring as S


def scores_df(spark):
    rows = [(i, i // 3, i % 3, i // 4, [float((i * 7 + j * 3) % 5) for j in range(6)], (i % 6)) for i in range(24)]
    return spark.createDataFrame(rows, "vec_id bigint, seq_id bigint, pos bigint, batch bigint, logits array<float>, target bigint")


def py_xent(logits, t):
    m = max(logits)
    return m + math.log(sum(math.exp(x - m) for x in logits)) - logits[t]


def test_corpus_loss_is_token_weighted_step_loss(spark):
    df = scores_df(spark)
    rows = df.collect()
    xs = [py_xent(r.logits, r.target) for r in rows if r.target != 0]
    loss = S.corpus_loss(df).first()
    assert abs(loss.loss - sum(xs) / len(xs)) < 1e-9 and loss.ntok == len(xs)
    st = S.step_loss(df).collect()
    assert abs(sum(r.loss_sum for r in st) / sum(r.ntok for r in st) - loss.loss) < 1e-9


def test_mean_of_batch_means_counts_pads(spark):
    df = scores_df(spark)
    rows = df.collect()
    per = {}
    for r in rows:
        per.setdefault(r.batch, []).append(py_xent(r.logits, r.target))
    want = sum(sum(v) / len(v) for v in per.values()) / len(per)
    assert abs(S.mean_of_batch_means(df).first().loss - want) < 1e-9


def test_prefix_diff_pass_and_fail(spark):
    df = scores_df(spark)
    bumped = df.withColumn("logits", F.when(F.col("pos") >= 2, F.transform("logits", lambda x: x + 1.0))
                           .otherwise(F.col("logits")))
    assert all(r.passed == 1 for r in S.prefix_diff(df, bumped, 2).collect())
    assert all(r.passed == 0 for r in S.prefix_diff(df, bumped, 3).collect())
    missing = df.where("pos <> 1")
    assert all(r.passed == 0 for r in S.prefix_diff(df, missing, 2).collect())


def test_length_stats_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in [0, 1, 5, 9]], "len bigint")
    r = S.length_stats(df).first()
    assert r.n == 4 and r.p50 == 5 and r.zero_ratio == 0.25 and r.le2_ratio == 0.5


def tok(spark, s):
    return spark.createDataFrame([(s,)], "x string").select(BL.zh_tokenize("x").alias("t")).first().t


def test_zh_tokenizer_rules(spark):
    assert tok(spark, "我爱你。Hello, world.") == ["我", "爱", "你", "。", "Hello", ",", "world", "."]
    assert tok(spark, "3.14 and 1,000 items-5 2-3") == ["3.14", "and", "1,000", "items-5", "2", "-", "3"]
    assert tok(spark, "  (a) ") == ["(", "a", ")"]
    assert tok(spark, "") == []


def bleu(spark, pairs):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "pair_id bigint, hyp string, ref string")
    return BL.corpus_bleu(df).first()


def test_bleu_identity_and_zero(spark):
    assert abs(bleu(spark, [("the cat sat on the mat", "the cat sat on the mat")]).bleu - 100.0) < 1e-9
    assert bleu(spark, [("a b c d", "e f g h")]).bleu == 0.0
    # hypothesis too short for 4-grams: precision 0 for n=4 -> BLEU 0
    assert bleu(spark, [("the cat", "the cat sat")]).bleu == 0.0


def test_bleu_smoothing_and_brevity(spark):
    r = bleu(spark, [("the cat sat on a mat", "the cat sat on the mat today")])
    c = [r.correct_1, r.correct_2, r.correct_3, r.correct_4]
    t = [r.total_1, r.total_2, r.total_3, r.total_4]
    assert c == [5, 3, 2, 1] and t == [6, 5, 4, 3]
    p = [100.0 * c[i] / t[i] for i in range(4)]
    want = math.exp(1 - 7 / 6) * math.exp(sum(math.log(x) for x in p) / 4)
    assert abs(r.bleu - want) < 1e-9
    r2 = bleu(spark, [("a b c x d", "a b c d e")])
    # 3-grams: 'a b c' matches; 4-grams none -> exp smoothing 100 / (2 * 2)
    p = [100 * 4 / 5, 100 * 2 / 4, 100 * 1 / 3, 100 / (2 * 2)]
    assert abs(r2.bleu - math.exp(sum(math.log(x) for x in p) / 4)) < 1e-9


def test_counts_in_the_row_equal_counters(spark):
    import random
    from collections import Counter
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "d.", "的", "1,000", "x-y"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(25))), " ".join(word() for _ in range(rng.randrange(25)))) for i in range(60)]
    rows += [(100, "", ""), (101, None, "a b"), (102, "a b", None), (103, "a " * 3000, "a " * 2000), (104, None, None)]
    df = spark.createDataFrame(rows, "pair_id long, hyp string, ref string")
    from pyspark.sql import functions as F
    toks = {r.pair_id: (r.h or [], r.r or []) for r in df.select(
        "pair_id", BL.zh_tokenize(F.coalesce("hyp", F.lit(""))).alias("h"), BL.zh_tokenize(F.coalesce("ref", F.lit(""))).alias("r")).collect()}
    want, clipped = {}, {}
    for k, sides in toks.items():
        h, r = (Counter((n, " ".join(t[i:i + n])) for n in range(1, 5) for i in range(len(t) - n + 1)) for t in sides)
        for g in h.keys() | r.keys():
            want[k, *g] = (h[g], r[g])
            c = clipped.setdefault((k, g[0]), [0, 0])
            c[0] += min(h[g], r[g])
            c[1] += h[g]
    assert {(r.pair_id, r.n, r.ngram): (r.hyp_count, r.ref_count) for r in BL.ngram_counts(df).collect()} == want
    got = {(r.pair_id, r.n): [r.correct, r.total] for r in BL.clipped_rows(df).collect()}
    assert got == clipped
    assert got == {(r.pair_id, r.n): [r.correct, r.total] for r in BL.clipped_matches(BL.ngram_counts(df)).collect()}
