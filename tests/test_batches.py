"""Index, windows, splits and batching (2.10-C, 2.10-D)."""

from pyspark.sql import functions as F

from tokenmill.operators import batches as B
from tokenmill.operators.indexing import sequence_index


def test_global_index_exact_across_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    ix = sequence_index(df, ["k"], name="i", partitions=7).collect()
    assert sorted((r.k, r.i) for r in ix) == [(k, k) for k in range(5000)]


def test_grouped_index_with_hot_group(spark):
    # one group holds most rows and spans many range partitions
    rows = [(0 if i % 10 else i % 7 + 1, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g bigint, t bigint")
    ix = sequence_index(df, ["t"], ["g"], name="r", start=1, partitions=9).collect()
    by = {}
    for r in ix:
        by.setdefault(r.g, []).append((r.t, r.r))
    for g, lst in by.items():
        lst.sort()
        assert [x[1] for x in lst] == list(range(1, len(lst) + 1)), g


def test_chunk_windows_rule(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, "abcdef")], "doc_id bigint, text string")
    w = B.chunk_windows(df, "text", 4, 2).orderBy("doc_id", "window_id").collect()
    # n=10: (10-4)//2 = 3 windows; n=3 < 4 gives none; n=6: (6-4)//2 = 1
    assert [(r.doc_id, r.window_id, r.x, r.y) for r in w] == [
        (1, 0, "abcd", "bcde"), (1, 1, "cdef", "defg"), (1, 2, "efgh", "fghi"), (3, 0, "abcd", "bcde")]


def test_offset_split(spark):
    df = spark.createDataFrame([(1, "0123456789")], "doc_id bigint, text string")
    got = {r.split: r.part for r in B.offset_split(df, "text").collect()}
    assert got == {"train": "01234567", "val": "8", "test": "9"}


def test_sequential_batches_last_short(spark):
    df = spark.range(0, 35).withColumnRenamed("id", "k")
    b = B.sequential_batches(df, "k", 16).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in b] == [16, 16, 3]


def test_capped_sample_without_replacement(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    s = B.capped_sample(df, "k", 2, 32).collect()
    assert len(s) == 64 and len({r.k for r in s}) == 64
    small = B.capped_sample(df.limit(10), "k", 200, 32).count()
    assert small == 10


def test_first_n_all(spark):
    df = spark.range(0, 10)
    assert B.first_n(df, "id", -1).count() == 10
    assert B.first_n(df, "id", 3).count() == 3


def test_grouped_scan_matches_python(spark):
    import random
    from tokenmill.operators.indexing import grouped_scan, running_offset
    random.seed(5)
    rows = [(0 if i % 6 else i % 4 + 1, i, None if i % 9 == 0 else float(random.randint(0, 50))) for i in range(1500)]
    df = spark.createDataFrame(rows, "g bigint, t bigint, v double")
    by = {}
    for g, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(g, []).append((t, v))
    for op in ["sum", "min", "last"]:
        for inc in (False, True):
            got = {(r.g, r.t): r.s for r in grouped_scan(df, ["g"], ["t"], "v", op, "s", inc, partitions=7).collect()}
            for g, lst in by.items():
                for t, _ in lst:
                    vals = [x for tt, x in lst if (tt <= t if inc else tt < t) and x is not None]
                    want = {"sum": sum(vals), "min": min(vals) if vals else None, "last": vals[-1] if vals else None}[op]
                    assert got[(g, t)] == want, (op, inc, g, t)
    lens = spark.createDataFrame([(i, (i * 7) % 5) for i in range(300)], "k bigint, w bigint")
    off = {r.k: r.off for r in running_offset(lens, ["k"], "w", "off", partitions=6).collect()}
    acc = 0
    for i in range(300):
        assert off[i] == acc
        acc += (i * 7) % 5
