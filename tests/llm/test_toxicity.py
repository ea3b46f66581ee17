"""op4: maximal segments against their definition, learning, edge cases."""

import numpy as np
import pyarrow as pa

from tokenmill.llm import toxicity as T


def split(score, a, b):
    """Maximal segments by definition: the best segment, then both sides."""
    best = None
    for i in range(a, b):
        for j in range(i + 1, b + 1):
            s = float(score[i:j].sum())
            if s > 0 and (best is None or s > best[0] + 1e-12):
                best = (s, i, j)
    if best is None:
        return []
    return split(score, a, best[1]) + [(best[1], best[2], best[0])] + split(score, best[2], b)


def test_max_segments():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.normal(-0.2, 1, rng.integers(0, 25))
        got, want = T.max_segments(s), split(s, 0, len(s))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_rate_solves_its_equation():
    s, p = np.array([-0.5, 1.0, 2.0]), np.array([0.9, 0.07, 0.03])
    x = T.rate(s, p)
    assert x > 0 and abs(p @ np.exp(x * s) - 1) < 1e-9


def frame(spark, n=600):
    rng = np.random.default_rng(1)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, 40))
        if i % 5 == 0:
            for at in rng.choice(40, 4, replace=False):
                w[at] = ("vile", "nasty", "foul")[at % 3]
        rows.append((i, " ".join(w), 0.5, 1))
        labels.append((i, int(i % 5 == 0)))
    return (spark.createDataFrame(rows, "doc_id long, text string, score double, toxic int"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_learns_planted_words(spark):
    docs, labels = frame(spark)
    extra = spark.createDataFrame([(9000, None, 0.0, 0), (9001, "", 0.0, 0), (9002, "wai " * 20000 + "vile nasty foul", 0.0, 0),
                                   (9003, "vile foul nasty vile", 0.0, 0), (9003, "vile foul nasty vile", 0.0, 0),
                                   (None, "wai wbj", 0.0, 0)], docs.schema)
    more = spark.createDataFrame([(0, None), (0, 0), (None, 1)], "doc_id long, toxic int")  # conflicting, null
    out = T.toxicity(docs.union(extra), labels.union(more)).collect()
    assert len(out) == 606 and out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    held = [r for r in out if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    by = {r.doc_id: r for r in out}
    assert by[9000].score == by[9001].score < 0.5 and by[9003].predicted == 1 and by[None].predicted == 0
    assert sum(r.doc_id == 9003 for r in out) == 2 and all(0 <= r.score <= 1 for r in out)
    clean = T.keep_clean(docs, labels)
    assert clean.columns == docs.columns and 470 <= clean.count() <= 490


def test_passages_and_missing_classes(spark):
    docs, labels = frame(spark, 300)
    model = T.fit(docs, labels, "doc_id", "text", "toxic")
    got = T.toxic_passages(docs, model).collect()
    assert got and np.mean([r.doc_id % 5 == 0 for r in got]) > 0.95
    text = {r.doc_id: r.text.split() for r in docs.collect()}
    assert all(text[r.doc_id][r.first_word] in ("vile", "nasty", "foul") for r in got if r.doc_id % 5 == 0)
    assert T.fit(docs, labels.where("toxic = 0"), "doc_id", "text", "toxic") is None
    assert {r.score for r in T.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert T.toxicity(docs.limit(0), labels).count() == 0


def test_tokens_in_one_bucket_per_stem():
    bucket, n = T.token_buckets(pa.array(["Vile, vile! 12", ""], pa.large_string()))
    assert n.tolist() == [3, 0] and bucket[0] == bucket[1] > 0 and bucket[2] == 0


def test_tokens_do_not_share_counts(spark):
    import itertools
    import zlib
    want = zlib.crc32(b"vile") % ((1 << 18) - 1)  # clean words that once fell into the toxic word's bucket
    words = ("".join(t) for t in itertools.product("abcdefghijklm", repeat=6))
    same = list(itertools.islice((w for w in words if zlib.crc32(w.encode()) % ((1 << 18) - 1) == want), 4))
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{a}" for a in rng.choice(list("abcdefghijklmnop"), 30)]
        w[5] = w[20] = "vile" if i % 5 == 0 else same[i % 4]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(docs, marks, "doc_id", "text", "toxic")
    got = model["scores"].of(pa.array(["vile", same[0], "never", "vile"], pa.large_string()))
    assert got[0] == got[3] > 1 and got[1] < -T.DRIFT == got[2]
    out = T.toxicity(docs, marks).where("held_out").collect()
    assert len(out) > 100 and all(r.predicted == (r.doc_id % 5 == 0) for r in out)
