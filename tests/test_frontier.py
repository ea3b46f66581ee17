"""Decoding by a scorer that sees whole prefixes, the recency
window of generation."""

import hashlib
import itertools
import math
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenmill.operators import decode as D
from tokenmill.operators import frontier as FR
from tokenmill.plans.catalog import QUERIES

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import tests
WORDS = ["a", "b", "c", "</s>"]


def logps(ctx, prefix):
    """A scorer's model: depends on every token of the prefix."""
    raw = [1 + hashlib.md5(f"{ctx}|{'|'.join(prefix)}|{t}".encode()).digest()[0] % 7 for t in WORDS]
    return {t: math.log(x / sum(raw)) for t, x in zip(WORDS, raw)}


def make_scorer():
    calls = []

    def scorer(rows):
        calls.append(rows.num_rows)
        out = [(i, t, p) for i, (c, s) in enumerate(zip(rows.column("lang").to_pylist(), rows.column("prefix").to_pylist()))
               if s[-1] != "dead" for t, p in reversed(logps(c, s).items())]
        return pa.table({"row": pa.array([r[0] for r in out], pa.int64()), "nxt": pa.array([r[1] for r in out], pa.string()),
                         "logp": pa.array([r[2] for r in out], pa.float64())})
    return scorer


def brute(ctx, seq, beam, steps, alpha):
    norm = lambda s, n: round(s / ((5.0 + n) / 6.0) ** alpha, 9)
    beams = [(list(seq or ()), 0.0, not seq)]
    for _ in range(steps):
        cands = []
        for s, p, ended in beams:
            after = [] if ended or s[-1] == "dead" else sorted(logps(ctx, s).items(), key=lambda x: (-x[1], x[0]))[:beam]
            cands += [([*s, t], p + q, t == "</s>") for t, q in after] or [(s, p, True)]
        beams = sorted(cands, key=lambda c: (-norm(c[1], len(c[0])), c[0]))[:beam]
    return beams[0]


@pytest.mark.parametrize("beam, alpha, rows", [(1, 0.0, 256), (3, 0.6, 256), (4, 0.6, 3)])
def test_scorer_that_sees_the_whole_prefix(spark, beam, alpha, rows):
    starts = [(i, lang, [f"s{i % 5}", "x"][: 1 + i % 2]) for i, lang in enumerate("xyz" * 7)]
    starts += [(50, None, ["q"]), (51, "x", []), (52, "x", None), (53, "y", ["dead"])]
    df = spark.createDataFrame(starts, "key long, lang string, seq array<string>").repartition(3)
    got = {r.key: r for r in FR.scorer_decode(df, make_scorer, beam, 6, alpha, rows=rows).collect()}
    for k, lang, seq in starts:
        s, score, ended = brute(lang, seq, beam, 6, alpha)
        assert list(got[k].seq) == s and abs(got[k].score - score) < 1e-12 and got[k].ended == ended
    assert FR.scorer_decode(df.limit(0), make_scorer, 2, 3).count() == 0
    first = FR.scorer_decode(df, make_scorer, 2, 0).where("key = 0").first()
    assert list(first.seq) == ["s0"] and first.score == 0


def test_prefix_cache_and_forced_scores_agree(spark):
    table = {("x", p): [(t, math.log(0.25)) for t in "abcd"] for p in "abcd"}
    scorer = FR.PrefixCache(table, ("lang",))
    text = list("abacabadab")
    rows = pa.table({"prefix": pa.array([text[:i] for i in range(1, 10)]), "lang": ["x"] * 9})
    got = scorer(rows).to_pylist()
    by = {(r["row"], r["nxt"]): r["logp"] for r in got}
    forced = FR.cached_scores(pa.table({"prefix": [text[:-1]], "target": [text[1:]], "base": [[math.log(0.25)] * 9]}))[0]
    assert forced == pytest.approx([by[i, text[i + 1]] for i in range(9)])
    df = spark.createDataFrame([(1, [1, 5, 6], [5, 6, 0], [-1.0, -2.0]), (2, None, None, None)],
                               "k long, i array<long>, o array<long>, base array<double>")
    out = FR.forced_scores(df, lambda: FR.cached_scores, "k", "i", "o", ("base",), pad=0).collect()
    assert [(r.k, r.pos, r.target, r.logp) for r in out] == [(1, 0, 5, -1.0), (1, 1, 6, -2.0)]


def test_generation_looks_back_over_the_window(spark):
    scores = spark.createDataFrame([("x", p, t, math.log(q)) for p in "abc" for t, q in (("a", .4), ("b", .35), ("c", .25))],
                                   "lang string, prev string, nxt string, logp double")
    rows = [(k, "x", list(s)) for k, s in enumerate(["ab", "abababab", "acacacac", "cab" * 40, "a"] * 8)]
    df = spark.createDataFrame(rows, "key long, lang string, seq array<string>")
    weights = {t: math.exp((math.log(q) - math.log(.4)) / .8) for t, q in (("a", .4), ("b", .35), ("c", .25))}

    def plain(key, seq, window, recent):
        seq = list(seq)
        for step in range(1, 9):
            u = int(hashlib.md5(f"1337:{key}:{step}".encode()).hexdigest()[:8], 16) / 4294967296.0
            tail = seq[-window:]
            after = [b for a, b in zip(tail, tail[1:]) if a == seq[-1]]
            w = [weights[t] * (1 + recent * after.count(t)) for t in "abc"]
            run = list(itertools.accumulate(w))
            seq.append("abc"[min(sum(r / run[-1] <= u for r in run), 2)])
        return seq
    for window, recent in ((64, 1.0), (64, 0.0), (5, 3.0)):
        want = {k: plain(k, s, window, recent) for k, _, s in rows}
        for limit in (0, D.BROADCAST_BYTES):
            out = D.generate(df, scores, 8, window=window, recent=recent, broadcast_bytes=limit).collect()
            assert {r.key: list(r.seq) for r in out} == want
    assert len({tuple(plain(0, s, 64, 1.0)[-8:]) for s in ("ab" * 4, "acab" * 4, "ccab")}) > 1


def test_registered_queries_run_the_hook(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    out = QUERIES["scorer_decode"](spark, sf)
    starts = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 0").count()
    assert out.count() == starts and out.where("n_tokens < 1 OR n_tokens > 65").count() == 0
    called = []
    real = FR.forced_scores
    monkeypatch.setattr(FR, "forced_scores", lambda *a, **b: called.append(1) or real(*a, **b))
    got = QUERIES["score_batches"](spark, sf)
    assert called and got.columns == ["pair_id", "pos", "target", "logp"]
    assert got.where((F.col("logp") > 0) | (F.col("target") == 0)).count() == 0 and got.count() > 1000
