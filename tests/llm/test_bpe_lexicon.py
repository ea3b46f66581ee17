"""op12 against the tokenizers library and against plain merging."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import bpe_lexicon as B
from tokenmill.llm.common import BYTE_BPE_JSON
from tokenmill.llm.queries import QUERIES

ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \n b", "<|endoftext|>", " <|endoftext|> x", "x<|endoftext|><|endoftext|>  ",
       "it's we'll 'S 're", "\x1c a\x1cb \x85 c", "\u037c \u0558 a\u0558b", "日本語 テキスト 123 ４５", "a\u3000 b", "  \n\n  x",
       "\U0003d000a b\U000323b0", "a" * 5000, " " * 300 + "x", "ab" * 3000, "\ufffd \x00 a", "e\u0301 é"]


@pytest.fixture(scope="module")
def vocab():
    return B.Vocabulary(B._read(BYTE_BPE_JSON))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BYTE_BPE_JSON)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    bits = list("abet '\n\té1²½日,.") + [" the", "ing", "\u0558", "\x1c", "<|endoftext|>", "  ", "\U00010940", "İ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("with_lexicon", [False, True])
def test_ids_and_texts_equal_the_library(vocab, library, with_lexicon):
    texts = ODD + random_texts(4000)
    words = sorted({w.encode() for t in texts[:2000] for w in B.Splitter(vocab.special).plain.findall(t)})
    lexicon = B.Lexicon.mapped(B.compile_lexicon((w, vocab.merge(w)) for w in words)) if with_lexicon else None
    codec = B.Codec(vocab, lexicon)
    ids, per = codec.encode(pa.array(texts, pa.large_string()))
    got = np.split(ids, np.cumsum(per)[:-1])
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in got] == want
    assert codec.decode(ids, per) == [library.decode(w, skip_special_tokens=False) for w in want] == texts


def test_bytes_that_are_no_text(vocab, library):
    bad = [vocab.byte[0xE6], vocab.byte[0x97], vocab.byte[0x41], vocab.byte[0xFF], 50256]
    assert B.Codec(vocab, None).decode(np.array(bad), np.array([5, 0])) == [library.decode(bad, skip_special_tokens=False), ""]


def test_transducer_is_minimal_and_exact(vocab):
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    ids = {w: tuple(rng.randrange(4) for _ in range(rng.randrange(0, 4))) for w in words}
    lex = B.Lexicon(B.compile_lexicon((w, ids[w]) for w in words))
    probe = words + [b"", b"d", b"abcabcabc", b"a" * 100, "é".encode()]
    found, n, flat = lex.walk(pa.array(probe, pa.large_binary()))
    assert found.tolist() == [w in ids for w in probe]
    assert [tuple(x) for x in np.split(flat, np.cumsum(n)[:-1])] == [ids.get(w, ()) for w in probe]
    # no two states are the same: equal final outputs and equal arcs
    arcs = {}
    for k, t, o in zip(lex.key.tolist(), lex.target.tolist(), lex.out.tolist()):
        arcs.setdefault(k >> 8, []).append((k & 255, t, o))
    states = [(f, tuple(arcs.get(i, ()))) for i, f in enumerate(lex.final.tolist())]
    assert len(set(states)) == len(states)
    shared = B.Lexicon(B.compile_lexicon([(a + b"tion", (1, 2)) for a in (b"ac", b"mo", b"na")]))
    assert len(shared.final) == 1 + 3 + 5  # the root, one state per first letter, one ending
    empty = B.Lexicon(B.compile_lexicon([]))
    assert empty.walk(pa.array([b"a"], pa.large_binary()))[0].tolist() == [False]


def test_long_words_merge_like_short_ones(vocab, monkeypatch):
    rng = random.Random(7)
    words = [bytes(rng.choice(b"theinr ") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    short = [(monkeypatch.setattr(B, "HEAP", 10**9), vocab.merge(w))[1] for w in words]
    assert [(monkeypatch.setattr(B, "HEAP", 0), vocab.merge(w))[1] for w in words] == short
    for heap in (0, 10, 40):
        monkeypatch.setattr(B, "HEAP", heap)
        flat, begin, n = vocab.merge_many(pa.array([*words, b"", b"a"], pa.large_binary()))
        assert [flat[b:b + k].tolist() for b, k in zip(begin, n)] == [*short, [], vocab.merge(b"a")]
    assert len(vocab.merge(b"x" * 300_000)) < 300_000


def test_files_that_do_more_are_refused():
    d = json.loads(B._read(BYTE_BPE_JSON))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}},
                   {"added_tokens": [{"content": "x", "id": 1, "single_word": True, "lstrip": False, "rstrip": False}]}):
        with pytest.raises(ValueError):
            B.Vocabulary(json.dumps(d | change))


def test_frames(spark, library):
    texts = ODD + random_texts(300) + [None] + ["the same text again"] * 500
    df = spark.createDataFrame([(i, t, "x", {"a b": 1}, 2.0) for i, t in enumerate(texts)],
                               "doc_id long, text string, ids string, t struct<`a b`:int>, n_tokens double").repartition(7)
    block = B.build(df, "text", BYTE_BPE_JSON, 200)
    assert len(B.frequent(B.count_words(df, "text", BYTE_BPE_JSON), 200)) in range(50, 201)
    enc = B.encode(df, lexicon=block)
    assert enc.columns == ["doc_id", "text", "t", "n_tokens", "ids"] and enc.schema["t"] == df.schema["t"]
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in enc.collect()} == want
    dec = B.decode(enc.withColumn("ids", F.when(F.col("doc_id") != 5, F.col("ids"))), out="back")
    assert {r.doc_id: r.back for r in dec.collect()} == {i: "" if i == 5 else t or "" for i, t in enumerate(texts)}
    for lexicon in (block, None):
        got = {r.doc_id: r[1:] for r in B.round_trip(df, "doc_id", "text", BYTE_BPE_JSON, lexicon).collect()}
        assert got == {i: (len(w), hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest(),
                           hashlib.sha256((texts[i] or "").encode()).hexdigest()) for i, w in want.items()}
    none = df.limit(0)
    assert B.build(none, "text", BYTE_BPE_JSON) and B.encode(none).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r[1:] for r in QUERIES["op12_bpe_lexicon"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == (len(w), hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest(),
                                 hashlib.sha256(library.decode(w, skip_special_tokens=False).encode()).hexdigest())
