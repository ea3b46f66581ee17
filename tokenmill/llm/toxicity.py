"""Toxicity by maximum-scoring segments.

Every token has a log-odds score between toxic and other training documents,
shrunk by a Dirichlet prior (the pooled counts) and lowered to its confidence
bound, minus a small drift, so that the expected score of clean text is
negative. A linear scan finds every maximal-scoring segment (none can be
extended or cut without losing score). Under such scores the best segment of n
clean tokens follows an extreme-value law: a segment of score S is expected
E = K n exp(-lambda S) times, lambda solves sum p exp(lambda s) = 1 over the
clean token distribution and K comes from the best segments of clean training
texts. A text's statistic is the sum of lambda S - ln(K n) over its segments with
E below ``max_e``, and a logistic curve of ln(1 + statistic) gives the score.

Fit: token counts cover all labelled training rows (a token counts once a text,
so one text that repeats a word cannot carry it), every token by itself. A token
whose confidence bound is 0 scores like one never met, so only the others (some
three toxic texts, or several dozen clean ones) reach the driver and the tasks;
that loses nothing. Only K and the two logistic weights come from
a bounded sample of about ``fit_rows`` labelled training rows.

Cases: null and empty texts score like a text without any toxic passage. A key
labelled more than once counts as toxic if any label says so; labels that are
null are ignored. If one class has no training row the score is that of an
uninformed prior, 0. Repeated rows are scored each by itself; other columns of
the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tokenmill.llm.common import (as_text, dictionary, free_name, map_arrow, held_out, quoted, sample_rows, slices, split_words,
                                  text_batches, with_fields)
from tokenmill.llm.langid import letters
from tokenmill.session import cut_lineage

PRIOR = 0.1  # prior mass as a share of the counted tokens
CONFIDENCE = 1.96
DRIFT = 0.5
THRESHOLD = 0.7
BROADCAST_LABELS = 1_000_000  # (key, label) rows, about 80 MB as a hash table


def token_codes(texts: pa.Array):
    """(distinct tokens, code of every token, tokens per text). A token is the
    lower-cased letters of a word; words without letters share the token '',
    which has code 0."""
    flat, n = split_words(texts, lower=False)
    dic, code = dictionary(flat)
    names, of = dictionary(pa.concat_arrays([pa.array([""], pa.large_string()), letters(dic).cast(pa.large_string())]))
    return names, of[1:][code], n


def token_buckets(texts: pa.Array):
    """Code of every token of the texts, and tokens per text."""
    return token_codes(texts)[1:]


class TokenScores:
    """Scores of the listed tokens, found by hash and confirmed by the token
    itself; any other token has the common score."""

    def __init__(self, tokens: pa.Array, scores: np.ndarray, other: float = -DRIFT):
        h = self.hashes(tokens)
        order = np.argsort(h, kind="stable")
        self.h, self.tokens, self.scores, self.other = h[order], tokens.take(pa.array(order)), scores[order], other

    def parts(self) -> tuple:
        """The plain arrays, for a broadcast: a worker need not have this package."""
        return self.h, self.tokens, self.scores, self.other

    @classmethod
    def of_parts(cls, parts: tuple):
        self = cls.__new__(cls)
        self.h, self.tokens, self.scores, self.other = parts
        return self

    @staticmethod
    def hashes(tokens: pa.Array) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in tokens.to_pylist()), dtype=np.uint64, count=len(tokens))

    def of(self, tokens: pa.Array) -> np.ndarray:
        out = np.full(len(tokens), self.other)
        h = self.hashes(tokens)
        at, todo = np.searchsorted(self.h, h), np.arange(len(h))
        while True:
            todo = todo[at[todo] < len(self.h)]
            todo = todo[self.h[at[todo]] == h[todo]]
            if not len(todo):
                return out
            same = pc.equal(self.tokens.take(pa.array(at[todo])), tokens.take(pa.array(todo))) \
                .to_numpy(zero_copy_only=False)
            out[todo[same]] = self.scores[at[todo[same]]]
            todo = todo[~same]  # another token of the same hash may follow
            at[todo] += 1


def max_segments(score: np.ndarray):
    """All maximal-scoring segments of one score sequence in linear time:
    (start, end, score) with end exclusive, in text order."""
    pos = np.flatnonzero(score > 0)
    if not len(pos):
        return []
    total = np.concatenate(([0.0], np.cumsum(score)))
    segs: list = []  # start, end, left sum, right sum, index of the last earlier one with a smaller left sum
    for p in pos.tolist():
        start, end, left, right = p, p + 1, total[p], total[p + 1]
        j = len(segs) - 1
        while True:
            while j >= 0 and segs[j][2] >= left:
                j = segs[j][4]
            if j < 0 or segs[j][3] >= right:
                segs.append((start, end, left, right, j))
                break
            start, left = segs[j][0], segs[j][2]
            back = segs[j][4]
            del segs[j:]
            j = back
    return [(s, e, r - x) for s, e, x, r, _ in segs]


def token_bound(toxic, other, n1, n0, log=np.log, sqrt=np.sqrt):
    """(log-odds, its slack) of tokens counted in ``toxic`` and ``other``
    documents, of ``n1`` and ``n0`` counts in all; numbers, arrays or columns."""
    mass = PRIOR * (n1 + n0)
    a1, a0 = toxic + (toxic + other) * PRIOR, other + (toxic + other) * PRIOR
    return log(a1 / (n1 + mass - a1)) - log(a0 / (n0 + mass - a0)), sqrt(1 / a1 + 1 / a0) * CONFIDENCE


def token_scores(toxic: np.ndarray, other: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Score per token from the counts in toxic and other documents."""
    odds, slack = token_bound(toxic, other, n1, n0)
    return np.maximum(np.sign(odds) * np.maximum(np.abs(odds) - slack, 0), -1.0) - DRIFT


def rate(score: np.ndarray, weight: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1 (bisection)."""
    p = weight / weight.sum()
    lo, hi = 0.0, 1.0
    f = lambda x: float(p @ np.exp(np.minimum(x * score, 700))) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x, y):
    """Weights (a, b) of sigmoid(a + b x); a small pull keeps separable data
    finite."""
    xs = np.stack([np.ones(len(x)), x], axis=1)
    w = np.zeros(2)
    pull = np.array([1e-6, 1e-4]) * len(x)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -500, 500)))
        grad = xs.T @ (p - y) + pull * w
        hess = (xs * (p * (1 - p))[:, None]).T @ xs + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def passages(texts: pa.Array, scores: TokenScores):
    """The maximal segments of every text, and its token count."""
    names, code, n = token_codes(texts)
    s = scores.of(names)[code]
    ends = np.cumsum(n)
    up = np.concatenate(([0], np.cumsum(s > 0)))
    found = [max_segments(s[e - k:e]) if up[e] > up[e - k] else [] for e, k in zip(ends.tolist(), n.tolist())]
    return found, n


def statistic(segments, n: int, model: dict) -> float:
    """ln(1 + sum of lambda S - ln(K n) over the significant segments)."""
    base = math.log(max(model["k"] * max(n, 1), 1e-300))
    bits = [model["rate"] * s - base for _, _, s in segments]
    return math.log1p(sum(b for b in bits if b > -math.log(model["max_e"])))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, fit_rows: int = 20_000,
        max_e: float = 0.05) -> dict | None:
    """The model, from labelled rows that are not held out; None if a class is
    missing."""
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("__k")) \
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    known = cut_lineage(known.where(F.col("y").isin(0, 1) & ~held_out("__k", 3)))
    if known.count() <= BROADCAST_LABELS:  # else a shuffle join
        known = F.broadcast(known)
    train = docs.where(~held_out(key, 3)).select(F.col(key).alias("k"), F.col(text).alias("t")) \
        .join(known, F.col("k") == F.col("__k")).select("k", "t", "y")

    def count(batches):
        for b in batches:
            texts, y = as_text(b.column("t")), b.column("y").to_numpy(zero_copy_only=False)
            for at, n in slices(texts):
                names, code, size = token_codes(texts.slice(at, n))
                once = np.unique(np.repeat(np.arange(n), size) * len(names) + code)
                of = y[at:at + n].astype(np.int64)[once // len(names)]
                total = np.bincount(of * len(names) + once % len(names), minlength=2 * len(names)).reshape(2, -1)
                met = np.flatnonzero(total.sum(axis=0))
                rows = np.bincount(y[at:at + n], minlength=2)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([names.take(pa.array(met)).cast(pa.string()), pa.array([None], pa.string())]),
                     pa.array(np.append(total[0, met], rows[0])), pa.array(np.append(total[1, met], rows[1]))],
                    names=["token", "n0", "n1"])

    # one row a token; the null token counts the texts
    counts = cut_lineage(train.mapInArrow(count, "token string, n0 long, n1 long").groupBy("token")
                         .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    sums = {r.texts: (float(r.n0), float(r.n1)) for r in counts.groupBy(F.col("token").isNull().alias("texts"))
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()}
    of_rows, (n0, n1) = np.array(sums.get(True, (0.0, 0.0))), sums.get(False, (0.0, 0.0))
    if not of_rows.all() or not n0 or not n1:
        return None
    odds, slack = token_bound(F.col("n1"), F.col("n0"), F.lit(n1), F.lit(n0), F.log, F.sqrt)
    told = counts.where(F.col("token").isNotNull() & (F.abs(odds) > slack)).toArrow()
    toxic, other = (told.column(c).to_numpy().astype(float) for c in ("n1", "n0"))
    listed = token_scores(toxic, other, n1, n0)
    model = {"scores": TokenScores(told.column("token").combine_chunks().cast(pa.large_string()), listed),
             "max_e": max_e, "k": 1.0}
    model["rate"] = rate(np.append(listed, -DRIFT), np.append(other, n0 - other.sum()))
    share = min(1.0, fit_rows / of_rows.sum())
    shared = spark.sparkContext.broadcast(model["scores"].parts())

    def segments(batches):
        scores = TokenScores.of_parts(shared.value)
        for b in batches:
            texts = as_text(b.column("t"))
            for at, n in slices(texts):
                found, size = passages(texts.slice(at, n), scores)
                yield pa.RecordBatch.from_arrays(
                    [b.column("y").slice(at, n), pa.array(size),
                     pa.array([[s for _, _, s in f] for f in found], pa.list_(pa.float64()))], names=["y", "n", "s"])

    sample = sample_rows(train, "y", F.ceil(F.col("n") * share), ("k", "t"))  # a share of each class, exactly bounded
    some = sample.mapInArrow(segments, "y int, n long, s array<double>").toArrow().to_pydict()
    y, n = np.array(some["y"]), np.maximum(np.array(some["n"]), 1)
    best = np.array([max(s, default=0.0) for s in some["s"]])
    clean = y == 0
    if clean.any():  # the mean of a standard Gumbel variable is 0.5772
        model["k"] = math.exp(float(np.mean(model["rate"] * best[clean] - np.log(n[clean]))) - 0.5772)
    x = np.array([statistic([(0, 0, v) for v in s], m, model) for s, m in zip(some["s"], n)])
    model["a"], model["b"] = _logistic(x, y) if 0 < y.sum() < len(y) else (-4.0, 0.5)
    return model


def score_texts(texts: pa.Array, model: dict) -> np.ndarray:
    found, n = passages(texts, model["scores"])
    x = np.array([statistic(f, m, model) for f, m in zip(found, n.tolist())])
    return 1 / (1 + np.exp(-np.clip(model["a"] + model["b"] * x, -500, 500)))


def score(docs: DataFrame, model: dict | None, text: str = "text", keep=("doc_id",), out: str = "score") -> DataFrame:
    """``keep`` columns (the text may be one) plus the toxicity score of every
    row."""
    text_batches(docs.sparkSession)
    keep = list(keep)
    if model is None:
        return docs.select(*[F.col(quoted(c)) for c in keep], F.lit(0.0).alias(out))
    read = text if text in keep else free_name(keep, "worked")
    src = docs.select(*[F.col(quoted(c)) for c in keep], *([] if text in keep else [F.col(quoted(text)).alias(read)]))
    fields = with_fields(docs, keep, {out: DoubleType()})
    shared = docs.sparkSession.sparkContext.broadcast(model | {"scores": model["scores"].parts()})

    def run(batches):
        m = shared.value | {"scores": TokenScores.of_parts(shared.value["scores"])}
        for b in batches:
            texts = as_text(b.column(read))
            for at, n in slices(texts):
                s = score_texts(texts.slice(at, n), m)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, n) for c in keep], pa.array(s)],
                                                 names=[*keep, out])

    return map_arrow(src, run, fields)


def toxic_passages(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every significant passage: key, first and last word (0-based), score,
    e_value."""
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model | {"scores": model["scores"].parts()})
    kind = src.schema["k"].dataType.simpleString()

    def run(batches):
        m = shared.value | {"scores": TokenScores.of_parts(shared.value["scores"])}
        for b in batches:
            texts = as_text(b.column("t"))
            for at, n in slices(texts):
                found, size = passages(texts.slice(at, n), m["scores"])
                rows = [(i, s, e - 1, v, m["k"] * k * math.exp(-m["rate"] * v))
                        for i, (f, k) in enumerate(zip(found, size.tolist())) for s, e, v in f]
                rows = [r for r in rows if r[4] < m["max_e"]]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column("k").slice(at, n).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64())],
                    names=["k", "first_word", "last_word", "score", "e_value"])

    out = src.mapInArrow(run, f"k {kind}, first_word long, last_word long, score double, e_value double")
    return out.withColumnRenamed("k", key)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
             **fit_args) -> DataFrame:
    """Fit on labelled rows that are not held out, score every row: key,
    held_out, score, predicted (1 from 0.7 on)."""
    model = fit(docs, labels, key, text, label, **fit_args)
    marked = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), held_out(key, 3).alias("held_out"))
    out = score(marked, model, "t", ["k", "held_out"])
    return out.select(F.col("k").alias(key), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
               **fit_args) -> DataFrame:
    """The rows, unchanged, that score under 0.7."""
    model = fit(docs, labels, key, text, label, **fit_args)
    out = free_name(docs.columns, "score")
    return score(docs, model, text, docs.columns, out).where(F.col(quoted(out)) < THRESHOLD).drop(out)
