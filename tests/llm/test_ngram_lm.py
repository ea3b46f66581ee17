"""op5: Elias-Fano sequences, trie and whole scores against brute force."""

import collections
import math
import zlib

import numpy as np
import pytest

from tokenmill.llm import ngram_lm as L


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (1, 2**64), (50, 60), (2000, 10**6), (3000, 2**64), (500, 3000)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n, dtype=np.uint64, endpoint=False))
    ef = L.EliasFano.build(values, universe)
    if n:
        assert (ef.get(np.arange(n)) == values).all()
    ask = np.concatenate((values, rng.integers(0, universe, 200, dtype=np.uint64))) if n else np.arange(5, dtype=np.uint64)
    got = ef.find(ask)
    first = np.searchsorted(values, ask)
    there = (first < n) & (values[np.minimum(first, max(n - 1, 0))] == ask) if n else np.zeros(len(ask), bool)
    assert (got == np.where(there, first, -1)).all()


def test_quantise_is_exact_for_few_values_and_close_for_many():
    few = np.array([1.0, 2.0, 1.0])
    book, code = L.quantise(few)
    assert (book[code] == few).all()
    many = np.random.default_rng(0).normal(-3, 1, 10_000)
    book, code = L.quantise(many)
    assert code.dtype == np.uint8 and np.abs(book[code] - many).max() <= (many.max() - many.min()) / 255


ROWS = [(i, " ".join(f"W{(i * k) % 7}" for k in range(1, 12)), 0.5) for i in range(60)]
ROWS += [(100, None, 0.0), (101, " \n ", 0.0), (102, "x", 0.0), (103, "x", 0.0), (103, "x", 0.0), (None, "w1 w2", 0.0),
         (104, "the " * 30_000, 0.0)]


def brute(rows):
    toks = [((t or "").encode().lower().split() + [None], i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
            for i, t, _ in rows]
    size = sum(len((t or "").encode()) for _, t, _ in rows) + 2 * len(rows)
    at = max(1.0, L.FREQUENT * size / 6)
    kappa = at * L.MIX / (1 - L.MIX)
    c, pair, ctx = (collections.Counter() for _ in range(3))
    for w, held in toks:
        if not held:
            c.update(w)
            for a, b in zip(["bos", *w[:-1]], w):
                pair[a, b] += 1
                ctx[a] += 1
    total = sum(c.values())
    z = total + 0.5 * (len(c) + 1)
    out = []
    for (i, _, _), (w, held) in zip(rows, toks):
        base = sum(math.log10((c[x] + 0.5) / z) for x in w)
        score = 0.0
        for a, b in zip(["bos", *w[:-1]], w):
            mu = max(L.MIX, kappa / (ctx[a] + kappa))
            score += math.log10(mu * (c[b] + 0.5) / z + ((1 - mu) * pair[a, b] / ctx[a] if ctx[a] else 0))
        out.append((i, held, len(w), sum(c[x] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize("shard", [L.SHARD_BYTES, 20_000, 300])
def test_scores(spark, monkeypatch, shard):
    # small shards send the frequent words to several shards
    monkeypatch.setattr(L, "SHARD_BYTES", shard)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, score double").repartition(3)
    got = L.score_documents(df)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda r: (r[0] is None, r[0] or 0)
    got, want = sorted(map(tuple, got.collect()), key=order), sorted(brute(ROWS), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
        assert abs(g[6] - w[6]) <= 0.03 * w[2]


@pytest.mark.parametrize("shard", [L.SHARD_BYTES, 3000])
def test_every_context_counts_whatever_the_size(spark, monkeypatch, shard):
    # the share of a frequent word and unrelated rows do not change what a context's pairs weigh
    monkeypatch.setattr(L, "SHARD_BYTES", shard)
    monkeypatch.setattr(L, "FREQUENT", 1e-2)
    rows = [*ROWS, *((300 + i, " ".join(f"other{i}x{j}" for j in range(200)), 0.0) for i in range(100))]
    got = L.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)).collect()
    monkeypatch.setattr(L, "FREQUENT", 0)  # brute: every context by its own count
    order = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(brute(rows), key=order), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and abs(g[6] - w[6]) <= 0.03 * w[2]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.score_documents(df).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = L.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert tuple(one)[1:] == (True, 3, 0, 0, 0.0, 0.0)


def test_shards_are_even_and_hashes_whole():
    import pyarrow as pa
    import xxhash
    texts = pa.array([" ".join(f"t{i}" for i in range(20_000))], pa.large_string())
    h, code, size = L.tokens(texts)
    assert h.dtype == np.uint64 and int(h[code[5]]) == xxhash.xxh64_intdigest("t5") and size.tolist() == [20_001]
    sent = {p[0]: len(p[1]) // 8 for p in L.send(texts, np.ones(1, bool), 7, np.zeros(0, np.uint64))}
    assert len(sent) == 7 and max(sent.values()) < 1.2 * min(sent.values())
