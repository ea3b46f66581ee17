"""SimHash near-duplicates with pivot distance tables.

1. One pass over the texts gives every row a 64-bit fingerprint (majority bits
   of the hashes of its word shingles). Only (key, fingerprint) goes on.
2. Equal fingerprints collapse into one class. Two classes link if at most
   ``max_bits`` bits differ. Distances to random pivots alone cannot name
   candidates without comparing all pairs (each pivot keeps nearly half of
   them), so classes first meet in blocks: with ``max_bits + 2`` bands, two
   linked classes agree on at least two bands, and every pair of bands is a
   block key (exact, no link is lost). In a block the table of Hamming
   distances to the reference fingerprints discards every pair whose largest
   coordinate difference exceeds ``max_bits`` (triangle inequality), and the
   survivors are verified bit by bit. A block emits a spanning forest of its
   links, never all pairs. Blocks over ``block`` classes are cut into parts
   that meet pairwise, so no task holds more than two parts.
3. ``components`` joins the links.

Cases: a null, empty or blank text has fingerprint zero, linked like any other;
fewer words than a shingle make one shingle of all words. Null keys take no part
in the smallest key, and get a null component if no key of the component is
known. Repeated rows share their class. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tokenmill.llm.common import as_text, free_name, map_arrow, quoted, slices, split_words, text_batches, with_fields
from tokenmill.llm.components import components
from tokenmill.session import cut_lineage

SEED = 42
PIVOTS = 32
#: byte -> its eight bits as the eight bytes of a word
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
BLOCK = 2048


def text_fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """uint64 fingerprint of every text."""
    flat, n = split_words(texts)
    grams = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    out = np.zeros(len(n), dtype=np.uint64)
    if not grams.any():
        return out
    width = np.minimum(n, shingle)
    first = np.cumsum(n) - n
    total = np.cumsum(grams)
    start = np.repeat(first - (total - grams), grams) + np.arange(total[-1])
    size = np.repeat(width, grams)
    flat = flat.cast(pa.large_binary())
    hashes = np.zeros(len(start), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for k in range(1, shingle + 1):
        at = np.flatnonzero(size == k)
        if not len(at):
            continue
        cols = [flat.take(pa.array(start[at] + i)) for i in range(k)]
        text = pc.binary_join_element_wise(*cols, pa.scalar(b" ", pa.large_binary())) if k > 1 else cols[0]
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1].tolist()
        data = text.buffers()[2].to_pybytes()
        hashes[at] = np.fromiter((digest(data[a:b], SEED) for a, b in zip(ends, ends[1:])), dtype=np.uint64,
                                 count=len(at))
    full = np.flatnonzero(grams)
    # eight counters of one byte to a word: runs of at most 255 shingles are
    # summed in bytes, the runs of a text in integers
    runs = -(-grams[full] // 255)
    ends_ = np.cumsum(runs)
    nth = np.arange(ends_[-1]) - np.repeat(ends_ - runs, runs)
    begin = np.repeat((total - grams)[full], runs) + 255 * nth
    lanes = np.add.reduceat(SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)], begin, axis=0)
    ones = np.add.reduceat(lanes.view(np.uint8), ends_ - runs, axis=0, dtype=np.int64)
    major = (2 * ones > grams[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """The rows, unchanged, with their fingerprint (long) as column ``out``."""
    text_batches(docs.sparkSession)
    fields = with_fields(docs, docs.columns, {out: LongType()})

    def run(batches):
        for b in batches:
            texts = as_text(b.column(text))
            for at, n in slices(texts, 2 << 20):
                fp = text_fingerprints(texts.slice(at, n), shingle)
                part = b.slice(at, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp.view(np.int64))],
                                                 names=[*part.schema.names, out])

    return map_arrow(docs, run, fields)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp long) of every row."""
    text_batches(docs.sparkSession)
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = as_text(b.column("t"))
            for at, n in slices(texts, 2 << 20):
                fp = text_fingerprints(texts.slice(at, n), shingle)
                yield pa.RecordBatch.from_arrays([b.column("k").slice(at, n), pa.array(fp.view(np.int64))],
                                                 names=["k", "fp"])

    return src.mapInArrow(run, f"k {kind}, fp long").select(F.col("k").alias(key), "fp")


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot."""
    return np.bitwise_count(fp[..., None] ^ pivots).astype(np.int8)


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, n, dtype=np.uint64)


def _links(fp, left, right, table, max_bits):
    """The pairs (left, right) that the pivot table keeps and the bits confirm."""
    for cols in (slice(0, 4), slice(4, None)):
        near = (np.abs(table[left, cols] - table[right, cols]) <= max_bits).all(axis=1)
        left, right = left[near], right[near]
    ok = np.bitwise_count(fp[left] ^ fp[right]) <= max_bits
    return left[ok], right[ok]


def _forest(n, left, right):
    """Smallest reachable index of every index."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_edges(rows: list[np.ndarray], pivots: np.ndarray, max_bits: int):
    """Spanning links (a, b) of every block."""
    out_a, out_b = [], []
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r), []).append(r)
    for size, group in by_size.items():
        if size < 2:
            continue
        if size <= 24:  # many small blocks at once
            step = max(1, 200_000 // (size * size))
            i, j = np.triu_indices(size, 1)
            for s in range(0, len(group), step):
                fp = np.stack(group[s:s + step])
                table = pivot_table(fp, pivots).reshape(-1, len(pivots))
                base = np.arange(len(fp))[:, None] * size
                a, b = _links(fp.ravel(), (base + i).ravel(), (base + j).ravel(), table, max_bits)
                label = _forest(fp.size, a, b)
                moved = np.flatnonzero(label != np.arange(fp.size))
                out_a.append(fp.ravel()[moved])
                out_b.append(fp.ravel()[label[moved]])
            continue
        for fp in group:
            table = pivot_table(fp, pivots)
            order = np.argsort(table[:, 0], kind="stable")
            fp, table = fp[order], table[order]
            last = np.searchsorted(table[:, 0], table[:, 0].astype(np.int16) + max_bits, side="right")
            a_all, b_all = [], []
            for s in range(0, size, 256):
                i = np.arange(s, min(s + 256, size))
                n = last[i] - i - 1
                left = np.repeat(i, n)
                right = left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a, b = _links(fp, left, right, table, max_bits)
                a_all.append(a)
                b_all.append(b)
            a, b = np.concatenate(a_all), np.concatenate(b_all)
            label = _forest(size, a, b)
            moved = np.flatnonzero(label != np.arange(size))
            out_a.append(fp[moved])
            out_b.append(fp[label[moved]])
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def links(classes: DataFrame, fp: str = "fp", max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``classes``."""
    bands = max_bits + 2
    cut = [round(64 * i / bands) for i in range(bands + 1)]
    keys = []
    for n, (x, y) in enumerate(combinations(range(bands), 2)):
        def band(i):
            return F.shiftrightunsigned(F.shiftleft(F.col(fp), 64 - cut[i + 1]), 64 - cut[i + 1] + cut[i])
        size = cut[y + 1] - cut[y]
        keys.append(F.struct(F.lit(n).alias("pair"), F.shiftleft(band(x), size).bitwiseOR(band(y)).alias("bits")))
    keyed = classes.select(fp, F.explode(F.array(*keys)).alias("key")).select(fp, "key.pair", "key.bits")
    size = keyed.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(fp, F.lit("part")), parts).cast("int")
    met = keyed.join(size, ["pair", "bits"]).select("pair", "bits", fp, parts.alias("c"), mine.alias("i"))
    met = met.select("pair", "bits", fp, "i", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("j"))
    blocks = (met.groupBy("pair", "bits", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
              .agg(F.collect_list(fp).alias("fps")))
    pivots = reference_fingerprints()

    def run(batches):
        for b in batches:
            col = b.column("fps")
            flat = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(pc.list_value_length(col).to_numpy(zero_copy_only=False))
            x, y = block_edges(np.split(flat, ends[:-1]), pivots, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return blocks.select("fps").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: key, fp, component_id (smallest key reachable
    over links, its own included)."""
    prints = cut_lineage(fingerprints(docs, key, text, shingle))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min(key).alias("low")))
    root = components(links(classes.select("fp"), "fp", max_bits))
    placed = classes.join(root, classes["fp"] == root["node"], "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = placed.join(lowest, "root").select("fp", "component_id")
    return prints.join(of_class, "fp").select(key, "fp", "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                  max_bits: int = 3) -> DataFrame:
    """One row of every component, whatever its key: the smallest key (nulls
    last), then the smallest text hash, then any. Rows are told apart by an id
    that a checkpoint freezes, so a key on several texts removes none of them."""
    fp, row = free_name(docs.columns, "fp"), free_name(docs.columns, "row")
    marked = cut_lineage(with_fingerprints(docs, text, shingle, fp).withColumn(row, F.monotonically_increasing_id()))
    k, t = F.col(quoted(key)), F.col(quoted(text))
    rank = F.struct(k.isNull().alias("none"), k.alias("key"), F.xxhash64(t).alias("text"), F.col(quoted(row)).alias("row"))
    classes = cut_lineage(marked.select(F.col(quoted(fp)).alias("fp"), rank.alias("low")).groupBy("fp").agg(F.min("low").alias("low")))
    root = components(links(classes.select("fp"), "fp", max_bits))
    first = classes.join(root, classes["fp"] == root["node"], "left") \
        .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("low").alias("low"))
    return marked.join(first.select(F.col("low.row").alias(row)), row, "left_semi").select(*[F.col(quoted(c)) for c in docs.columns])
