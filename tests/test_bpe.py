"""BPE: batched rounds equal one-at-a-time merging; encoder and decoder rules."""

import collections
import itertools

from tokenmill.constants import UNK_ID
from tokenmill.operators import bpe as BP


TEXTS = ["low lower lowest newer wider", "new newer newest low low", "wide widest lowly aaaa aaa",
         "ｔｈｅ ① the  the", "数字 123 1234 12"]


def brute_force(words, chars, budget):
    SEP = BP.SEP
    kept = set(chars)
    syms = {w: [c if c in kept else SEP for c in "▁" + w] for w in words}
    known, out = set(kept), []
    while budget > 0:
        cnt = collections.Counter()
        for w, s in syms.items():
            for a, b in zip(s, s[1:]):
                if SEP in (a, b):
                    continue
                if BP.py_script_class(a) == "mark" or BP.py_script_class(a) == BP.py_script_class(b):
                    cnt[(a, b)] += words[w]
        if not cnt:
            break
        (a, b), _ = min(cnt.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))
        if a + b not in known:
            known.add(a + b)
            out.append((a, b))
            budget -= 1
        for w, s in syms.items():
            r, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    r.append(a + b)
                    i += 2
                else:
                    r.append(s[i])
                    i += 1
            syms[w] = r
    return out


def test_batched_training_equals_one_at_a_time(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string")
    vocab, merges = BP.bpe_train(df, "text", 60, head=8)
    got = [(r.l, r.r) for r in merges.orderBy("rank").collect()]
    words = {r.word: r.n for r in BP.word_table(df, "text").collect()}
    chars = [r.token for r in sorted(BP.kept_chars(BP.word_table(df, "text"), 0.9995).collect(), key=lambda r: r.crank)]
    assert got == brute_force(words, chars, 60 - 4 - len(chars))
    v = vocab.orderBy("id").collect()
    assert [r.piece for r in v[:4]] == ["<pad>", "<s>", "</s>", "<unk>"]
    assert [r.score for r in v] == [0, 0, 0, 0] + [-k for k in range(len(v) - 4)]
    assert len({r.piece for r in v}) == len(v)
    # NFKC: full-width letters and circled digits normalise
    assert "①" not in {r.piece for r in v}


def test_encode_word_lowest_id_first_and_unk_runs():
    ids = {"▁": 10, "l": 11, "o": 12, "w": 13, "lo": 5, "▁lo": 6, "ow": 4}
    # 'ow' (4) merges before 'lo' (5); then no pair with ▁ + l + ow
    assert BP.encode_word(list("▁low"), ids) == [10, 11, 4]
    assert BP.encode_word(list("▁xyz"), ids) == [10, UNK_ID]
    enc = BP.WordEncoder(ids)
    assert enc.text("  ") == []


def test_decode_rules():
    pieces = ["<pad>", "<s>", "</s>", "<unk>", "▁he", "llo", "▁w", "orld"]
    assert BP.decode_py([1, 4, 5, 6, 7, 2, 0], pieces) == "hello world"
    assert BP.decode_py([0, 1, 2, 3, 5], pieces) == " ⁇ llo"


def test_spark_decode_matches_python(spark):
    pieces = ["<pad>", "<s>", "</s>", "<unk>", "▁he", "llo", "▁w", "orld"]
    vocab = spark.createDataFrame([(i, p, "special" if i < 4 else "merged") for i, p in enumerate(pieces)],
                                  "id bigint, piece string, kind string")
    rows = [([1, 4, 5, 6, 7, 2, 0],), ([0, 1, 2, 3, 5],), ([],)]
    df = spark.createDataFrame(rows, "ids array<bigint>")
    got = [r.t for r in df.select(BP.bpe_decode("ids", vocab).alias("t")).collect()]
    assert got == [BP.decode_py(r[0], pieces) for r in rows]


def test_roundtrip_encode_decode(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    vocab, _ = BP.bpe_train(df, "text", 80)
    e = BP.bpe_encode(df, "text", vocab, "ids")
    got = [r.t for r in e.select(BP.bpe_decode("ids", vocab).alias("t")).collect()]
    import unicodedata
    want = [" ".join(unicodedata.normalize("NFKC", t).split()) for t in TEXTS]
    assert got == want


MIXED = TEXTS + ["我爱你我爱你 爱你们 hello你好123 ab12", "\u0001x \u0001x", "the then there these " * 3, "banana bananas ananas " * 2, "カタカナ한국어 漢字"]


def test_merging_ahead_equals_one_at_a_time(spark):
    """However few words a round may look at, and whichever rule picks its
    merges."""
    df = spark.createDataFrame([(t,) for t in MIXED * 3], "text string")
    words = {r.word: r.n for r in BP.word_table(df, "text").collect()}
    chars = [r.token for r in sorted(BP.kept_chars(BP.word_table(df, "text"), 0.9995).collect(), key=lambda r: r.crank)]
    want = brute_force(words, chars, 10**6)
    for working, head, every in ((1 << 14, 2000, 8), (6, 12, 2), (0, 8, 3)):
        vocab, merges = BP.bpe_train(df, "text", 4 + len(chars) + len(want) + 50, head=head, working=working, checkpoint_every=every)
        assert [(r.l, r.r) for r in merges.orderBy("rank").collect()] == want
        assert vocab.count() == 4 + len(chars) + len(want)
    some, _ = BP.bpe_train(df, "text", 4 + len(chars) + 20)
    assert [r.piece for r in some.orderBy("id").collect()][4:24] == ["".join(p) for p in want[:20]]


def test_units_are_cut_on_script_change(spark):
    df = spark.createDataFrame([("hello你好123ab", 2), ("你", 3), ("x", 1)], "word string, n long")
    got = {r.unit: r.n for r in BP._units(df).collect()}
    assert got == {"▁hello": 2, "你好": 2, "123": 2, "ab": 2, "▁你": 3, "▁x": 1}


def test_roundtrip_refs(spark):
    """Cut to the dataset's length, unknowns as ' ⁇ ', blanks empty."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "", None, "low " * 40, "Ωmega low"])], "pair_id long, tgt string")
    vocab, _ = BP.bpe_train(df.where("pair_id < 5"), "tgt", 70)
    ids, pieces = BP.piece_table(vocab), [r.piece for r in vocab.orderBy("id").collect()]
    got = {r.pair_id: r.ref for r in BP.roundtrip_refs(df, "tgt", vocab, 12).collect()}
    for r in df.collect():
        mine = BP.WordEncoder(ids).text(r.tgt)[:10]  # between bos and eos
        assert got[r.pair_id] == BP.decode_py(mine, pieces), r
    assert got[5] == got[6] == "" and "⁇" in got[8] and len(got[7]) < len("low " * 40)


def test_batches_encode_like_single_words(spark):
    ids = {"▁": 10, "l": 11, "o": 12, "w": 13, "lo": 5, "▁lo": 6, "ow": 4, "你": 20, "好": 21, "你好": 22, "1": 23, "▁1": 24}
    enc = BP.WordEncoder(ids)
    texts = ["low 你好low你1", None, "", "  xyz q low", "qq 我 1", "low" * 50]

    def plain(t):
        out = []
        for w in BP.unicodedata.normalize("NFKC", t or "").split():
            out += BP.encode_word(list("▁" + w), ids)
        return [x for i, x in enumerate(out) if not (x == UNK_ID and i and out[i - 1] == UNK_ID)]
    flat, n = enc.texts(texts)
    got, at = [], 0
    for k in n.tolist():
        got.append(flat[at:at + k].tolist())
        at += k
    assert got == [plain(t) for t in texts]
    across = BP.WordEncoder(ids | {"w你": 30})
    assert across.word("low你") == BP.encode_word(list("▁low你"), ids | {"w你": 30})
    df = spark.createDataFrame([(i, t, {"x y": i}) for i, t in enumerate(texts)], "k long, t string, s struct<`x y`:long>")
    vocab = spark.createDataFrame([(i, p, "merged") for p, i in ids.items()], "id long, piece string, kind string")
    out = BP.bpe_encode(df, "t", vocab).orderBy("k").collect()
    assert [list(r.ids) for r in out] == got and [r.s["x y"] for r in out] == list(range(6))


def test_decoding_with_a_large_vocabulary(spark):
    n = 70_000
    vocab = spark.range(n).selectExpr("id", "CASE WHEN id < 4 THEN 'special' ELSE concat('p', id) END AS piece",
                                      "IF(id < 4, 'special', 'merged') AS kind")
    df = spark.createDataFrame([([5, 69_999, 1, 3, 80_000],)], "ids array<bigint>")
    assert df.select(BP.bpe_decode("ids", vocab).alias("t")).first().t == "p5p69999 ⁇  ⁇ "


def test_a_stored_vocabulary_must_fit(spark, tmp_dir):
    from tokenmill.operators.vocab_store import load_or_train
    a = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    b = spark.createDataFrame([("other words entirely other words",)], "text string")
    first = load_or_train(spark, tmp_dir, a, "text", 40)
    assert first.count() == 40 and load_or_train(spark, tmp_dir, a, "text", 45).count() == 45
    other = {r.piece for r in load_or_train(spark, tmp_dir, b, "text", 40).collect()}
    assert "▁other" in other
    import tokenmill.operators.bpe as mod
    real, mod.bpe_train = mod.bpe_train, None  # a stored one is not trained again
    try:
        again = load_or_train(spark, tmp_dir, a.repartition(3), "text", 40)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    finally:
        mod.bpe_train = real


def test_a_vocabulary_file_with_quotes(spark, tmp_dir):
    from tokenmill.sources.vocab_files import read_vocab, write_vocab
    pieces = ["<pad>", "<s>", "</s>", "<unk>", '"', ",", "a\tb", "▁\"x", "\\"]
    v = spark.createDataFrame(list(enumerate(pieces)), "id long, piece string")
    write_vocab(v, tmp_dir + "/v")
    got = read_vocab(spark, tmp_dir + "/v").orderBy("id").collect()
    assert [(r.id, r.piece, r.kind) for r in got] == [(i, p, "special" if i < 4 else "piece") for i, p in enumerate(pieces)]


def test_training_of_many_words_takes_few_rounds(spark, monkeypatch):
    """30,000 distinct words that hold every early pair: the driver decides many merges a
    round, and they equal merging one at a time."""
    syl = ["ka", "to", "mi", "se", "ru", "no"]
    words = {a + b + c + d + e + f: 1 + (i % 7) for i, (a, b, c, d, e, f) in enumerate(
        itertools.product(syl, repeat=6)) if i < 30_000}
    df = spark.createDataFrame([(" ".join([w] * n),) for w, n in words.items()], "text string")
    calls = collections.Counter()
    for name in ("merge_ahead", "accept_batch"):
        real = getattr(BP, name)
        monkeypatch.setattr(BP, name, lambda *a, real=real, name=name: calls.update([name]) or real(*a))
    vocab, merges = BP.bpe_train(df, "text", 4 + 13 + 20)
    chars = [r.token for r in sorted(BP.kept_chars(BP.word_table(df, "text"), 0.9995).collect(), key=lambda r: r.crank)]
    got = [(r.l, r.r) for r in merges.orderBy("rank").collect()]
    assert got[:8] == brute_force(words, chars, 8) and len(got) == 33 - len(chars)
    assert sum(calls.values()) <= 4, calls
