"""One long text as offset pieces (2.10-C) equals plain slicing."""

import random

import pytest

from tokenmill.operators import longtext as LT


def build(spark, lines, partitions=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i bigint, text string")
    return LT.pieces_with_offsets(df, ["i"], partitions=partitions)


def test_windows_and_split_match_slicing(spark):
    lines = ["héllo wörld\n" * 3, "x" * 2500 + "€" * 1700 + "\n", "", "short\n", "🙂 end\n"]
    text = "".join(lines)
    pieces = build(spark, lines)
    got = [(r.window_id, r.x, r.y) for r in LT.corpus_windows(pieces, 128, 64).orderBy("window_id").collect()]
    n = len(text)
    want = [(i, text[i * 64:i * 64 + 128], text[i * 64 + 1:i * 64 + 129]) for i in range(max(0, (n - 128) // 64))]
    assert got == want
    parts = LT.corpus_split(pieces).collect()
    a, b = int(0.8 * n), int(0.9 * n)
    for name, lo, hi in (("train", 0, a), ("val", a, b), ("test", b, n)):
        rows = sorted((r.split_off, r.piece) for r in parts if r.split == name)
        assert "".join(p for _, p in rows) == text[lo:hi]
    w = [(r.window_id, r.x) for r in LT.split_windows(LT.corpus_split(pieces), "train", 32, 16).orderBy("window_id").collect()]
    tr = text[:a]
    assert w == [(i, tr[i * 16:i * 16 + 32]) for i in range(max(0, (len(tr) - 32) // 16))]


def test_short_text_has_no_windows(spark):
    assert LT.corpus_windows(build(spark, ["abc\n"]), 128, 64).count() == 0


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_windows_reach_over_many_small_partitions(spark, partitions):
    """Partitions shorter than a window, empty ones, and strides of all sizes."""
    rng = random.Random(partitions)
    lines = ["".join(rng.choice("aé🙂\n") for _ in range(rng.randrange(12))) for _ in range(60)] + ["z" * 2600]
    rng.shuffle(lines)
    text = "".join(lines)
    pieces = build(spark, lines, partitions)
    for seq_len, stride in ((5, 3), (64, 64), (50, 200), (200, 1)):
        got = sorted((r.window_id, r.start, r.x, r.y) for r in LT.corpus_windows(pieces, seq_len, stride).collect())
        n = max(0, (len(text) - seq_len) // stride)
        assert got == [(i, i * stride, text[i * stride:i * stride + seq_len], text[i * stride + 1:i * stride + seq_len + 1]) for i in range(n)]


def test_windows_move_no_text(spark):
    """The text is exchanged once, into text order; cutting windows exchanges
    nothing."""
    out = LT.corpus_windows(build(spark, ["some text of a line\n"] * 50, 4), 16, 8)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
