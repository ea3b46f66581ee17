"""op2 and op3 against brute force, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import topk_threshold as T
from tokenmill.llm import url_filter as U
from tokenmill.llm.queries import RULES


def brute(rows, asked, k=10):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if asked(i):
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, n, j, -x) for n, (x, j) in enumerate(s, 1)]
    return sorted(out)


def test_lists_against_brute_force():
    rng = np.random.default_rng(1)
    for t in range(300):
        n, d, k = rng.integers(1, 60), rng.integers(0, 5), int(rng.integers(1, 12))
        x = rng.integers(-3, 4, (n, d)).astype(float) * (1.0, 2.0**40, 2.0**20)[t % 3]
        ids, q, own = rng.integers(0, 40, n), rng.integers(-2, 3, d).astype(float), int(rng.integers(0, 40))
        got, read = T.Lists(ids, x).top(own, q, k)
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q, r)), int(i)) for r, i in zip(x, ids) if i != own)[:k]
        assert got == [(-s, i) for s, i in want] and read <= n


def test_stops_early_when_the_bound_allows():
    x = np.diag(np.arange(1.0, 401.0))
    got, read = T.Lists(np.arange(400), x).top(-1, x[399], 2)
    assert got == [(160000, 399), (0, 0)]
    far = np.concatenate((np.full((50, 2), 1000.0) + np.arange(50)[:, None], np.random.default_rng(0).random((5000, 2))))
    assert T.Lists(np.arange(5050), far).top(-1, np.array([1.0, 1.0]), 10)[1] < 1000


@pytest.mark.parametrize("block", [T.BLOCK, 64])
def test_top_k(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a vector that fills much of the table
    rows += [(None, rows[0][1]), (2000, None), (2100, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (2200, [float("nan")] * 6),
             (2300, [float("inf")] * 6), (2400, [0.5, 0.5]), (2500, [0.1, -0.2]), (2600, []), (2700, []), (2800, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, query_id int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    out = T.top_k(df, df.where("vec_id % 100 = 0"), block=block)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == brute(rows, lambda i: i % 100 == 0)


def test_top_k_of_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert T.top_k(one, one).count() == 0 and T.top_k(one.limit(0), one).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (5, [3.0]), (5, [3.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, T.top_k(two, two.where("vec_id = 0")).collect()))
    assert got == [(0, 1, 5, 3 * 1024**2), (0, 1, 5, 6 * 1024**2), (0, 2, 5, 3 * 1024**2), (0, 2, 5, 6 * 1024**2)]


URLS = ["http://A.Example.ORG/en/1x?x#y", "https://example.org/es/", "http://example.org", "http://xexample.org/es/1",
        "ftp://a.b.com/de/1", "http://b.com/fr/", "http://com/de/", "http://org", "nothing", "", None, "a://b://c/de/",
        "http://spam.net/a/?utm_source=q&b=2&a=1#f", "https://www.SPAM.net:443/a?a=1&b=2", "http://spam.net/A", "http://h?q",
        "http://spam.net/a?b=2&a=1&ref=z", "http://u.com\n/de/x"]


@pytest.mark.parametrize("limit", [U.BROADCAST_BYTES, 0])
def test_rules_and_list(spark, limit):
    rows = [(i, u, "v") for i, u in enumerate(URLS)] + [(None, URLS[12], "v")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("http://spam.net/a?a=1&b=2",), (None,), ("no url",), ("http://spam.net/a/?b=2&a=1",),
                                    ("http://example.org/en/2",)], "url string")
    out = U.judge(pages, listed, RULES, broadcast_bytes=limit)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"] and out.count() == len(rows)
    assert [got[i] for i in range(18)] == [
        ("a.example.org", "/en/1x", "example.org/en/1", "block"), ("example.org", "/es/", "example.org/es/", "block"),
        ("example.org", "", None, "allow"), ("xexample.org", "/es/1", "org/", "allow"), ("a.b.com", "/de/1", "com/de/", "block"),
        ("b.com", "/fr/", "com/fr/", "allow"), ("com", "/de/", "com/de/", "block"), ("org", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/de/", None, "allow"),
        ("spam.net", "/a/", None, "block"), ("www.spam.net:443", "/a", None, "block"), ("spam.net", "/A", None, "allow"),
        ("h", "", None, "allow"), ("spam.net", "/a", None, "block"), ("u.com\n", "/de/x", None, "allow")]
    assert got[None][3] == "block"


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    urls = spark.range(20_000).select(F.concat(F.lit("h.net/"), F.col("id")).alias("c"))
    n = -(-20_000 * U.BITS_PER_URL // 512)
    sieve = U.bloom(urls, "c", n)
    asked = spark.range(40_000).select(F.concat(F.lit("h.net/"), F.col("id")).alias("c"), (F.col("id") < 20_000).alias("listed"))
    masks = U._mask(F.col("c"))
    ok = masks[0].bitwiseAND(F.col("w0")) == masks[0]
    for i in range(1, 8):
        ok = ok & (masks[i].bitwiseAND(F.col(f"w{i}")) == masks[i])
    rows = asked.withColumn("block", F.pmod(F.xxhash64("c"), F.lit(n))).join(sieve, "block", "left")
    got = dict(rows.groupBy("listed").agg(F.avg(F.coalesce(ok, F.lit(False)).cast("int"))).collect())
    assert got[True] == 1.0 and got[False] < 0.01


def test_empty_pages_and_list(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert U.judge(pages, pages.limit(0).select("url"), RULES).first().verdict == "allow"
    assert U.judge(pages.limit(0), pages.select("url"), RULES).count() == 0
    assert U.judge(pages, pages.select("url"), []).first().verdict == "block"
