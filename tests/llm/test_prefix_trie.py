"""op13 against a trie built by dictionaries, edge cases."""

import hashlib
import random
import re
import zlib

import pytest

from tokenmill.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, d long, k1 string, band int, m int"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members, kids = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
            if d:
                kids.setdefault(seq[:d - 1], set()).add(seq[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids.get(node, ())) or 1
        saved[node] = sum(saved[k] for k in kids.get(node, ()))
        if node:
            saved[node] += (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1]))
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, ())),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(140), 90):
        for t in range(rng.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c, t, rng.choice(("user", "assistant")), rng.choice(("a b", "c", "a", ""))))
    for c in range(200, 260):  # copies of one conversation
        rows += [(c, t, "user", f"turn {t} of all") for t in range(5)]
    return rows


def result(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, P.prefix_trie(df, **kw).collect()), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("band", [2, 3, P.BAND])
def test_against_dictionaries(spark, band, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "ID_BITS", 3)
    rows = rows_of(band)
    rows += [(1000, t, "user", f"long {t % 7}") for t in range(120)]  # a third of all turns in one conversation
    rows += [(1003, t, "user", f"long {t % 7}") for t in range(60)]
    assert result(spark, rows, band=band) == brute(rows)


def test_nulls_repeats_and_odd_texts(spark):
    rows = [(None, 0, "user", "gone"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 5, "user", ""),
            (-20, 0, "a", "b"), (-20, 1, "a", "b\x0bc d"), (-3, 0, "a", "x"), (7, 1, "user", "w " * 200_000), (20, 0, "a", "b"),
            (21, 0, "", "ab"), (22, 0, "a", "b"), (27, 0, "ab", "")]
    got = [r for r in result(spark, rows)]
    # ids under zero: c - c % 20 as SQL takes it
    assert len(got) == len({(r[0], r[1]) for r in got}) and got[0][:2] == (-20, 0)
    assert [r for r in got if r[1] == 0][0][3] == 8
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    assert result(spark, rows) == brute(rows)


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(5, 1, "user", x) for x in "abcdefg"] + [(25, 1, "user", x) for x in "gfedcba"]
    assert result(spark, rows) == result(spark, rows[::-1])


def test_no_rows(spark):
    assert result(spark, []) == [] and result(spark, [(None, 1, "user", "x")]) == []
