"""One huge text that must never sit in a single row (2.10-C).

The text arrives as ordered lines, which are cut into pieces of at most ``PIECE``
characters, range-partitioned into text order and frozen there (the one time
that the text is shuffled). A partition is then a contiguous stretch of the text:
its pieces get their offsets from the lengths of the partitions before it, and
it cuts its own windows (W1), of which only the last few reach beyond it. What
they need, the next ``seq_len`` characters, comes through a table of one row a
partition (its first characters), so windows move no text between tasks. The contiguous
80/10/10 split (W2) cuts pieces at the split offsets and keeps them as rows; no
split is ever one string.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.session import cut_lineage

PIECE = 1000  # also the largest counted repetition RE2 accepts (oracle side)


def pieces_with_offsets(lines: DataFrame, order_cols, text: str = "text", partitions: int | None = None) -> DataFrame:
    """(order..., k, piece, len, part, off): the text cut into pieces of <= PIECE
    characters (one regex pass per line) with exact global offsets; ``part`` is the
    partition that holds the piece, and rows are in text order inside it."""
    order_cols = list(order_cols)
    spark = lines.sparkSession
    cut = lines.select(*order_cols, F.posexplode(
        F.when(F.length(text) == 0, F.array().cast("array<string>"))
        .otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0))).alias("k", "piece"))
    cut = cut.withColumn("len", F.length("piece").cast("bigint"))
    n = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order_cols, "k"]
    ranged = cut_lineage(cut.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.sum("len").alias("n")).collect()}  # a row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]

    def run(batches):
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("len").to_numpy()
            if at is None:
                at = before[b.column("part")[0].as_py()]
            off = at + size.cumsum() - size
            at += int(size.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(off, pa.int64())], names=[*b.schema.names, "off"])

    return ranged.mapInArrow(run, T.StructType(ranged.schema.fields + [T.StructField("off", T.LongType())]))


def total_chars(pieces: DataFrame) -> int:
    return int(pieces.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0])


def _heads(pieces: DataFrame, base: int, need: int) -> list:
    """(first offset, characters, first ``need`` characters) of every partition
    that holds text, in text order: one row a partition."""
    def run(batches):
        first, n, head = None, 0, ""
        for b in batches:
            for off, size, piece in zip(*(b.column(c).to_pylist() for c in ("off", "len", "piece"))):
                first = off if first is None else first
                n += size
                if len(head) < need:
                    head = (head + piece)[:need]
        if n:
            yield pa.RecordBatch.from_pydict({"first": [first - base], "n": [n], "head": [head]})
    rows = pieces.select("off", "len", "piece").mapInArrow(run, "first long, n long, head string").collect()
    return sorted((r.first, r.n, r.head) for r in rows)


def corpus_windows(pieces: DataFrame, seq_len: int = 128, stride: int | None = None,
                   base: int = 0, total: int | None = None) -> DataFrame:
    """W1 over one text given as offset pieces (``pieces_with_offsets`` or one
    split of ``corpus_split``; offsets relative to ``base``): window i = characters
    [i*stride, i*stride + seq_len) as x and the same shifted by one as y; count =
    max(0, (n - seq_len) div stride)."""
    stride = stride or seq_len
    n = total_chars(pieces) if total is None else total
    count = max(0, (n - seq_len) // stride)
    schema = "window_id bigint, start bigint, x string, y string"
    if count == 0:
        return pieces.sparkSession.createDataFrame([], schema)
    span = seq_len + 1
    heads = _heads(pieces, base, seq_len)
    after: dict = {}  # by the offset where a partition begins: the characters that follow it
    follow = ""
    for first, size, head in reversed(heads):
        after[first] = follow
        follow = (head + follow)[:seq_len] if size < seq_len else head[:seq_len]
    shared = pieces.sparkSession.sparkContext.broadcast(after)  # seq_len characters a partition

    def run(batches):
        buffer, at, first = "", None, None
        rest = None

        def cut(last):
            """The windows that begin in the buffer and are whole."""
            nonlocal buffer, at
            w = -(-at // stride)
            end = at + len(buffer)
            rows = []
            while w < count and w * stride + span <= end and w * stride < last:
                s = w * stride - at
                rows.append((w, w * stride, buffer[s:s + seq_len], buffer[s + 1:s + span]))
                w += 1
            keep = min(max(w * stride - at, 0), len(buffer))
            buffer, at = buffer[keep:], at + keep
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                                                  pa.array(cols[3], pa.string())], names=["window_id", "start", "x", "y"])
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                if at is None:
                    at = first = part.column("off")[0].as_py() - base
                buffer += "".join(part.column("piece").to_pylist())
                yield from cut(at + len(buffer))
        if at is not None:
            rest = at + len(buffer)  # windows of this partition begin before its end
            buffer += shared.value[first]
            yield from cut(rest)

    return pieces.select("off", "piece").mapInArrow(run, schema)


def corpus_split(pieces: DataFrame, fracs=(0.8, 0.9), total: int | None = None) -> DataFrame:
    """W2 over one text given as offset pieces: [0,a), [a,b), [b,n) with
    a = int(0.8 n), b = int(0.9 n). Output keeps pieces as rows: (split,
    split_off = offset inside the split, piece)."""
    n = total_chars(pieces) if total is None else total
    a, b = int(fracs[0] * n), int(fracs[1] * n)
    rows = []
    for name, lo, hi in (("train", 0, a), ("val", a, b), ("test", b, n)):
        s = F.greatest(F.lit(lo) - F.col("off"), F.lit(0))
        e = F.least(F.lit(hi) - F.col("off"), F.col("len"))
        r = pieces.where((F.col("off") < hi) & (F.col("off") + F.col("len") > lo)).select(
            F.lit(name).alias("split"), (F.greatest(F.col("off"), F.lit(lo)) - F.lit(lo)).cast("bigint").alias("split_off"),
            F.col("piece"), "part", s.alias("s"), e.alias("e"))
        rows.append(r.select("split", "split_off", "part", F.expr("substring(piece, s + 1, e - s)").alias("piece")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("len", F.length("piece").cast("bigint"))


def split_windows(split_pieces: DataFrame, split: str, seq_len: int = 128, stride: int | None = None) -> DataFrame:
    """W1 inside one split of W2 (offsets relative to the split start)."""
    sp = split_pieces.where(F.col("split") == split).select(F.col("split_off").alias("off"), "len", "piece", "part")
    return corpus_windows(sp, seq_len, stride)
