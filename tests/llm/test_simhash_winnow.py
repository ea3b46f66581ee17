"""op6 and op10 against brute force, edge cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenmill.llm import simhash as S
from tokenmill.llm import winnow as W
from tokenmill.llm.components import components


def brute_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """Smallest index reachable over at most 3 differing bits."""
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_fingerprints():
    texts = ["", "a", "a b", "a  b C d", " \n ", "x " * 3000, "É é ß q", "one two three four five six", "w " * 255 + "v v v"]
    got = S.text_fingerprints(pa.array(texts, pa.large_string()), 3)
    assert [int(x) for x in got] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("block", [2048, 8])
def test_links_lose_no_component(spark, block):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**64, 6, dtype=np.uint64)
    prints = set()
    for c in centre:  # balls of near fingerprints around few centres, chains, and loners
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            prints.add(int(c) ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints | set(map(int, rng.integers(0, 2**64, 100, dtype=np.uint64))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    star = {r.node: r.root for r in components(S.links(df, "fp", 3, block)).collect()}
    want = groups(prints)
    ours = [star.get(s, s) for s in signed]
    assert len(set(ours)) == len(set(want)) == len(set(zip(ours, want)))


def test_near_duplicates(spark):
    text = " ".join(f"word{i % 50}x{i}" for i in range(400))
    rows = [(7, text, "x"), (3, text, "y"), (9, text + " tail", "z"), (4, None, ""), (5, " ", ""), (5, " ", ""),
            (None, "other text is here now", ""), (8, "completely different words stand in this one", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = S.near_duplicates(df).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    root = groups(prints)
    assert len(out) == len(rows)
    for i, (d, t, _) in enumerate(rows):
        mine = [x for j, (x, _, _) in enumerate(rows) if root[j] == root[i] and x is not None]
        got = [r for r in out if r.doc_id == d and r.fp % (1 << 64) == prints[i]]
        assert got and all(r.component_id == (min(mine) if mine else None) for r in got)
    kept = S.one_per_group(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({min([x for j, (x, _, _) in enumerate(rows) if root[j] == k
                                                                 and x is not None], default=None) for k in set(root)}
                                                             - {None}) and ids.count(None) == 1
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                               re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, names = cut(t), set(), set()
        for i, it in items:
            iw = cut(it)
            n = min(len(iw), 10)
            wins = {tuple(iw[j:j + n]) for j in range(len(iw) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j:j + n]) in wins:
                    hit |= set(range(j, j + n))
                    names.add(str(i))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [W.BROADCAST_BYTES, 0])
def test_decontamination(spark, limit):
    rng = np.random.default_rng(2)
    vocab = ["ab", "cd", "Ef", "gh", "É", "é"]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 80))) for _ in range(60)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([3, 3, 9, 9, 10, 11, 12, 25, 1, 0])]
    items += [(50, None), (51, "--- ..."), (4, items[4][1]), (60, "very " * 30)]
    docs = list(enumerate(texts)) + [(100, None), (101, ""), (102, "very " * 5000), (None, items[7][1]),
                                     (103, "x y z " + items[7][1].upper() + "; " + items[6][1]),
                                     (103, "x y z " + items[7][1].upper() + "; " + items[6][1]), (104, items[2][1])]
    df = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, W.decontaminate(df, bench, broadcast_bytes=limit).collect()), key=str)
    assert got == sorted(brute_hits(docs, items), key=str)
    kept = W.drop_contaminated(df, bench, broadcast_bytes=limit)
    assert kept.columns == df.columns and kept.count() == sum(not g[5] for g in got)


def test_decontamination_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert W.decontaminate(df.limit(0), bench).count() == 0
    assert W.decontaminate(df, bench.limit(0)).first().n_hit == 0
    assert W.decontaminate(df, bench).first().n_hit == 12


def test_decontamination_stays_in_the_engine(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = df.select(F.col("doc_id").alias("item_id"), "text")
    plan = W.decontaminate(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_one_row_per_component_whatever_the_key(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("ash", "birch", "cedar", "elm")]
    rows = [(1, texts[0], "a"), (1, texts[1], "b"), (1, texts[1], "b"),  # one key on two texts, one of them twice
            (2, texts[1], "c"), (None, texts[2], "d"), (None, texts[2], "d"), (None, texts[2], "d"),  # copies without a key
            (None, texts[0], "e"), (5, texts[3], "f"), (1, texts[3], "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = sorted((r.text, r.doc_id) for r in S.one_per_group(df).collect())
    assert kept == sorted([(texts[0], 1), (texts[1], 1), (texts[2], None), (texts[3], 1)])
    hot = spark.createDataFrame([(1, " ".join(f"w{i}x{j}" for j in range(30)), "") for i in range(50)], df.schema)
    assert S.one_per_group(hot).count() == 50
