"""op1 and op8: forward sums and Viterbi against brute force, edge cases."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import langid, sp_codec
from tokenmill.llm.common import PIECE_MODEL
from tokenmill.llm.pieces import PieceTable, code_points, load_pieces

PIECES = ["", "a", "b", "ab", "ba", "aba", "▁", "▁a"]


def segmentations(word, pieces):
    if not word:
        yield []
    for i, p in enumerate(pieces):
        if p and word.startswith(p):
            for rest in segmentations(word[len(p):], pieces):
                yield [i, *rest]
    if word and word[0] not in pieces:
        for rest in segmentations(word[1:], pieces):
            yield [-1, *rest]


def words(n):
    return ["▁" + "".join(t) for t in itertools.product("abx", repeat=n)]


@pytest.mark.parametrize("n", [1, 3, 5])
def test_forward_and_viterbi_match_all_segmentations(n):
    table, rng = PieceTable(PIECES), np.random.default_rng(n)
    prob, score = rng.random((len(PIECES), 2)), -rng.integers(1, 9, len(PIECES)).astype(float)
    todo = words(n)
    cp = code_points(pa.array(todo, pa.large_string()), n + 1)
    got = table.forward(cp, prob, 1e-3)
    rows, start, end, ids = table.viterbi(cp, score, -20.0)
    for r, w in enumerate(todo):
        every = list(segmentations(w, PIECES))
        for k in range(2):
            want = sum(math.prod(1e-3 if i < 0 else prob[i, k] for i in s) for s in every)
            assert math.isclose(got[r, k], math.log(want), rel_tol=1e-9)
        mine = ids[rows == r].tolist()
        cost = lambda s: sum(-20.0 if i < 0 else score[i] for i in s)
        assert mine in every and cost(mine) == max(map(cost, every))
        assert start[rows == r][0] == 0 and end[rows == r][-1] == n + 1


def test_expected_counts_match_all_segmentations():
    table, prob = PieceTable(PIECES), np.random.default_rng(0).random(len(PIECES))
    cp = code_points(pa.array(words(3), pa.large_string()), 4)
    got = table.expected(cp, prob, 1e-3, np.arange(1.0, len(cp) + 1))
    want = np.zeros(len(PIECES))
    for r, w in enumerate(words(3)):
        ps = [(s, math.prod(1e-3 if i < 0 else prob[i] for i in s)) for s in segmentations(w, PIECES)]
        for s, p in ps:
            for i in s:
                if i >= 0:
                    want[i] += (r + 1) * p / sum(q for _, q in ps)
    assert np.allclose(got, want)


def test_long_words_do_not_underflow():
    table = PieceTable(PIECES)
    cp = code_points(pa.array(["ab" * 5000], pa.large_string()), 10_000)
    got = table.forward(cp, np.full((len(PIECES), 1), 1e-6), 1e-6)
    assert np.isfinite(got).all() and -10_000 * 14 < got[0, 0] < -10_000


@pytest.fixture(scope="module")
def codec():
    return sp_codec.Codec(*load_pieces(PIECE_MODEL))


TEXTS = ["", " ", "hello world", "  two  spaces ", "tab\tand\nline\r\n", "é😀 日本 z", "▁ x", "x" * 3000, "a b " * 500,
         "\x00\x7f"]


def test_round_trip(codec):
    ids = codec.encode(pa.array(TEXTS, pa.large_string()))
    assert codec.decode(ids).to_pylist() == [t.replace("▁", " ") for t in TEXTS]
    assert ids.to_pylist()[0] == []


def test_same_segmentation_as_the_library_under_the_unigram_rule(codec):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    some = ["the quick brown fox", "Donaudampfschiff fährt", "où est la gare", "mañana por la mañana"]
    total = lambda ids: sum(codec.scores[i] for i in ids)
    for t, ids in zip(some, codec.encode(pa.array(some, pa.large_string())).to_pylist()):
        best = lib.nbest_encode_as_ids(t, 2)[0]
        assert total(ids) == total(best)


def test_encode_and_decode_frames(spark):
    rows = [(1, "hello  world", 7), (2, None, 8), (2, None, 8), (3, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    enc = sp_codec.encode(df, "text", "ids", check=True)
    got = enc.collect()
    assert enc.columns == ["doc_id", "text", "ids", "round_trip"] and len(got) == 4
    assert [r.ids is None for r in sorted(got, key=lambda r: r.doc_id)] == [False, True, True, False]
    assert all(r.round_trip for r in got if r.text is not None)
    back = sp_codec.decode(enc.drop("text", "round_trip")).collect()
    assert sorted((r.doc_id, r.text or "") for r in back) == [(1, "hello  world"), (2, ""), (2, ""), (3, "")]
    assert sp_codec.encode(df.limit(0)).count() == 0


def docs_of(spark):
    rows = []
    for i in range(240):
        lang = "de" if i % 2 else "en"
        stem = ["schaft", "ung", "keit", "heit"] if i % 2 else ["tion", "ing", "ness", "ful"]
        rows.append((i, " ".join(stem[(i * 7 + k) % 4] + stem[(i + k) % 4] for k in range(30)), lang, "score", 0.5))
    rows += [(1000, None, "en", "x", 0.1), (1001, "", None, "x", 0.1), (1002, "123 $$ 4", "en", "x", 0.1),
             (None, "tionness fulling", "en", "x", 0.1), (5, "keitung schaftheit", None, "x", 0.2),
             (5, "keitung schaftheit", None, "x", 0.2), (1003, "ungheit" * 2000, "de", "x", 0.2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_language_id(spark):
    df = docs_of(spark)
    out = langid.language_id(df, fit_rows=50, rounds=2).collect()
    assert len(out) == df.count() and out[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == ("de" if i % 2 else "en") for i in range(240) if i != 5)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[None].lang_pred == "en" and not by[None].held_out and by[1003].lang_pred == "de"
    assert sum(r.doc_id == 5 and r.lang_pred == "de" for r in out) == 3
    assert all(0 <= r.score <= 1 for r in out)
    kept = langid.keep_recognised(df, fit_rows=50, rounds=1)
    assert kept.columns == df.columns and kept.count() == df.count() - 3


def test_unspaced_texts_are_learned(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):  # every text is one word of more than 32 letters
        units = ("schaft", "ung", "keit", "heit") if i % 2 else ("tion", "ing", "ness", "ful")
        rows.append((i, ".".join(rng.choice(units, 60)), "aa" if i % 2 else "bb"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang", fit_rows=40, rounds=2)
    assert model["languages"] == ["aa", "bb"]
    out = langid.language_id(df, fit_rows=40, rounds=2).collect()
    assert np.mean([r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in out if r.held_out]) > 0.9


def test_expected_counts_of_long_words():
    table, prob = PieceTable(PIECES), np.full(len(PIECES), 1e-4)
    cp = code_points(pa.array(["x" * 4000 + "ab" * 3000], pa.large_string()), 10_000)
    got = table.expected(cp, prob, 1e-6, np.ones(1))
    spelled = sum(len(p) * got[i] for i, p in enumerate(PIECES))
    assert np.isfinite(got).all() and math.isclose(spelled, 6000, rel_tol=1e-6)


def test_language_id_without_training_rows(spark):
    df = docs_of(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(df).collect()} == {"und"}
    assert langid.language_id(df.limit(0)).count() == 0
