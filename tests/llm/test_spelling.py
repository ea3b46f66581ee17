"""op11 against plain edit distance, edge cases."""

import random
import re
import zlib

import numpy as np
import pytest

from tokenmill.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, ratio=5):
    out, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(near))
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, k, words.get(form[w])) for w, (n, k) in out.items()}


def some_words(seed, letters="abé", n=260, low=1, high=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(low, high))): rng.choice((1, 2, 5, 5, 30, 200)) for _ in range(n)}


def result(spark, words, **kw):
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.variants(df, **kw).collect()}


def test_pairs_of_a_tile():
    for seed in range(30):
        words = sorted(some_words(seed, n=120, low=3, high=6))
        m = 5
        part = [w for w in words if len(w) in (m, m - 1)]
        full = np.full(len(part), 0), np.full(len(part), m)
        i, j = S.compare(part, np.zeros(len(part), np.int64), m, *full, side=4)
        got = {frozenset((part[a], part[b])) for a, b in zip(i, j)}
        want = {frozenset((a, b)) for a in part for b in part if one_edit(a, b) and max(len(a), len(b)) == m}
        assert got == want and len(i) == len(want)


@pytest.mark.parametrize("limit", [S.TILE, 3])
def test_against_edit_distance(spark, limit):
    words = some_words(1) | {"": 3, "日本語": 7, "日本": 40, "𠀀本語": 2}
    assert result(spark, words, limit=limit) == brute(words)


def test_a_third_of_the_words_in_one_tile(spark):
    rng = random.Random(4)
    words = some_words(2, "abcdefgh", 300, 6, 12)
    words |= {"prefixprefixpre" + a + b: rng.choice((1, 9, 90)) for a in "abcdefghij" for b in "abcdefghijklmno"}
    assert result(spark, words, limit=20) == brute(words)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = S.split_large(S.tiles(df), 20).groupBy("tile", "m", "p", "cap").count().agg({"count": "max"}).first()[0]
    assert sizes <= 20


def test_chains_of_forms_and_long_words(spark):
    words = {"a" * 3000 + "x": 5, "a" * 3000: 25, "a" * 2999: 125, "a" * 2998 + "bc": 1, "zzzzzz": 4}
    assert result(spark, words) == brute(words)
    assert result(spark, words)["a" * 3000 + "x"][1] == "a" * 2999


def occurrences(rows):
    out = {}
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                out[run] = out.get(run, 0) + 1
    return out


def test_words_of_texts(spark):
    rng = random.Random(9)
    bits = ["Étonnant", "etonnant", "ÀÉ×÷ÿa", "wordword", "wordwort", "short", "Ǝxample", "naïve𠀀naivety", "don't-worry", "ĳsselmeer"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(400)]
    rows += [(1, None), (2, ""), (3, "x" * 200_000), (3, "x" * 200_000), (None, "\x85 "), (5, rows[0][1])] + [(7, "hotwords here")] * 300
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    assert {r.word: r.n for r in S.word_counts(df).collect()} == occurrences(rows)
    want = brute({w: n for w, n in occurrences(rows).items() if n >= 5})
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.spelling_variants(df).collect()} == want
    assert S.spelling_variants(df).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert S.spelling_variants(df.limit(0)).count() == 0 and S.spelling_variants(df.where("text = ''")).count() == 0
