"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BYTE_BPE_JSON = "/opt/tokenizers/byte_bpe_50k.json"
SLICE_BYTES = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other letters)."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def free_name(columns, name: str) -> str:
    """``name``, with underscores in front until no column is called so (names
    are compared without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_fields(df, keep, more: dict) -> StructType:
    """The fields of ``keep`` as they are in ``df`` and, after them, ``more``
    (name to Spark type); no type passes through text, so field names of any
    characters stay as they are."""
    return StructType([df.schema[c] for c in keep] + [StructField(n, t) for n, t in more.items()])


def map_arrow(src, run, schema: StructType) -> DataFrame:
    """``src.mapInArrow(run, schema)`` for columns of any names: they travel
    under plain names, ``run`` sees their own."""
    ins, plain = list(src.columns), [f"c{i}" for i in range(len(schema.names))]

    def placed(batches):
        for b in run(pa.RecordBatch.from_arrays(b.columns, names=ins) for b in batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=plain)

    fields = StructType([StructField(n, f.dataType) for n, f in zip(plain, schema.fields)])
    return src.toDF(*[f"c{i}" for i in range(len(ins))]).mapInArrow(placed, fields).toDF(*schema.names)


def quoted(name: str) -> str:
    """A column name as it is read in expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def crc_mod(c, m: int) -> Column:
    """crc32 of the value as text, modulo ``m`` (null for a null value)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def held_out(c, m: int) -> Column:
    """True where the crc32 remainder is 1; a null key is not held out."""
    return F.coalesce(crc_mod(c, m) == 1, F.lit(False))


def sample_rows(rows, by: str, most, hashed) -> DataFrame:
    """A sample of rows: of every value of ``by`` at most ``most`` (a number, or
    a column over ``n``, the value's rows), evenly by a hash of the columns
    ``hashed`` and the row's place. A key that fills many rows, or a language under
    one key, is sampled like any other rows. ``by`` must have few values."""
    place = F.pmod(F.xxhash64(*hashed, F.monotonically_increasing_id()), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    most = F.lit(most) if isinstance(most, int) else most
    # one and a half times as many rows as wanted reach the ranking
    some = rows.withColumn("place", place).join(F.broadcast(sizes), by).withColumn("most", most) \
        .where(F.col("place") * F.col("n") < 1.5 * F.col("most") + 20)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("place"))
    return some.withColumn("rank", rank).where(F.col("rank") <= F.col("most")).select(*rows.columns)


def worker_store(key: str, most: int = 2) -> dict:
    """A dict that outlives its task in the Python worker, until ``most`` other keys
    were asked for since: a worker serves many queries, and each one's tables would
    stay to its end. Functions travel to the workers by value, so a module global
    would be new in every task."""
    stores = sys.__dict__.setdefault("_tokenmill_store", {})
    stores[key] = got = stores.pop(key, {})
    while len(stores) > most:
        del stores[next(iter(stores))]
    return got


def text_batches(spark, limit: int = 8 << 20) -> None:
    """Lets Arrow batches hold at most ``limit`` bytes (a batch counts rows by
    default, and texts can be long). Only ever lowers the session's setting."""
    now = str(spark.conf.get(BATCH_BYTES)).rstrip("bB")
    if not now.isdigit() or int(now) > limit:
        spark.conf.set(BATCH_BYTES, str(limit))


def gathered(batches, limit: int):
    """Batches joined to about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, size = [], 0
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches() if len(held) > 1 else held
        yield from whole


def as_text(col) -> pa.LargeStringArray:
    """A text column as one large_string array, nulls as ''."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(start, length) runs of rows with at most ``limit`` text bytes each (one
    row may be longer), so working memory follows the bytes, not the rows."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, b in enumerate(size.tolist()):
        if i > start and total + b > limit:
            yield start, i - start
            pa.default_memory_pool().release_unused()  # the pool would keep the last slice's peak
            start, total = i, 0
        total += b
    if len(size) > start:
        yield start, len(size) - start
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array, lower: bool = True):
    """Words (runs of anything but ASCII white space, A-Z lower-cased if asked)
    of every text as one flat array, and the number of words per text."""
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    owner = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    keep = pc.greater(pc.binary_length(flat), 0)
    n = np.bincount(owner[keep.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return flat.filter(keep), n.astype(np.int64)


def dictionary(flat: pa.Array):
    """(distinct words as a large_string array, code of every word)."""
    d = flat.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def group_sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of lengths ``n`` (0 for an empty run)."""
    out = np.zeros(len(n), dtype=values.dtype)
    full = n > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))[full]
        out[full] = np.add.reduceat(values, starts)
    return out


def prefixed(prefix: str, texts: pa.Array) -> pa.Array:
    """``prefix`` + every text."""
    kind = texts.type
    return pc.binary_join_element_wise(pa.scalar(prefix, kind), texts, pa.scalar("", kind))
