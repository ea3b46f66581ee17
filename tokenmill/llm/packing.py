"""Token ids packed into fixed-length rows, best fit decreasing.

Texts become ids of the public byte-level vocabulary, each closed by the
end-of-text id. A document longer than a row is cut into full rows and a rest, so
no token is lost; the pieces of a shard (a bounded run of input rows) are packed
longest first, each into the row with the least room that still fits. The rows'
free room is kept in a segment tree over capacities, so a search takes
log2(row length) steps. Shards are cut by tokens inside each input partition:
nothing is shuffled, and a lost task packs the same shard again.

A packed row carries: ids (little-endian uint16, or uint32 for larger
vocabularies, padded with the end id), cumulative segment lengths (0 .. tokens
used), position ids that restart at every segment, and for every segment the key
and its offset in the document. Joining a
document's segments by offset gives its ids back.

Cases: a null text is an empty one (one end token). Rows that repeat are packed
each. Keys may be null. An empty table gives no rows. Very long texts fill rows
of their own; texts are encoded whole.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import BYTE_BPE, as_text, slices, text_batches, worker_store

ROW = 2048
SHARD_TOKENS = 4_000_000
END_ID = 50256
#: Public split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Runs of the pattern's white space that are cut out before it (fixed values: the characters).
LONG_RUN = re.compile("[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


class Capacities:
    """Rows by free room: a segment tree over 0 .. room counts the rows, and
    ``take`` finds the smallest room that fits."""

    def __init__(self, room: int):
        self.size = 1 << room.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int):
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int):
        """(room, row) with the least room >= need, removed; None if none."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, row


def best_fit(lengths: np.ndarray, room: int) -> np.ndarray:
    """Row number of every piece (lengths 1 .. room), longest first, ties in
    input order."""
    tree, out, rows = Capacities(room), np.empty(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        got = tree.take(need)
        if got is None:
            got, rows = (room, rows), rows + 1
        out[i] = got[1]
        if got[0] > need:
            tree.add(got[0] - need, got[1])
    return out


def encoder(data: bytes):
    """Byte-level encoder of a vocabulary file's contents."""
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_ids(enc, text: str) -> np.ndarray:
    """Ids of a text. A very long run of white space would overflow the pattern's
    stack, so it is taken out first: all of the run but its last character is one
    pre-token, or the whole run at the end of the text."""
    parts, at = [], 0
    for run in LONG_RUN.finditer(text):
        a, b = run.span()
        if a > at:
            parts.append(np.asarray(enc.encode_to_numpy(text[at:a])))
        at = b if b == len(text) else b - 1
        parts.append(np.asarray(enc._encode_single_piece(text[a:at])))
    if at < len(text):
        parts.append(np.asarray(enc.encode_to_numpy(text[at:])))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def pack_shard(ids: list[np.ndarray], room: int):
    """Packed rows of a shard's documents: for every row the list of (document,
    offset, ids) segments."""
    doc, off, size = [], [], []
    for d, x in enumerate(ids):
        for o in range(0, len(x), room):
            doc.append(d)
            off.append(o)
            size.append(min(room, len(x) - o))
    size = np.array(size, dtype=np.int64)
    row = best_fit(size, room)
    rows: list[list] = [[] for _ in range(int(row.max(initial=-1)) + 1)]
    for i in np.argsort(row, kind="stable").tolist():
        rows[row[i]].append((doc[i], off[i], ids[doc[i]][off[i]:off[i] + size[i]]))
    return rows


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", room: int = ROW, path: str = BYTE_BPE,
         end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per packed row: shard, row, n_tokens, input_ids binary,
    position_ids binary, cu_seqlens array<int>, keys, offsets array<long>."""
    text_batches(docs.sparkSession)
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType
    with open(path, "rb") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    # ids below the vocabulary's size, positions below the row's length
    wide = np.uint16 if max(len(data.splitlines()), end_id + 1, room) <= 1 << 16 else np.uint32

    def run(batches):
        store = worker_store(f"pack-{path}")
        if "enc" not in store:
            store["enc"] = encoder(shared.value)
        enc, shard = store["enc"], TaskContext.get().partitionId() << 32
        keys, ids, held = [], [], 0
        end = np.array([end_id], dtype=wide)
        for b in batches:
            texts = as_text(b.column("t"))
            for at, n in slices(texts):
                for k, t in zip(b.column("k").slice(at, n).to_pylist(), texts.slice(at, n).to_pylist()):
                    x = np.concatenate((text_ids(enc, t).astype(wide), end)) if t else end
                    keys.append(k)
                    ids.append(x)
                    held += len(x)
                    if held >= shard_tokens:
                        yield from flush(shard, keys, ids)
                        shard, keys, ids, held = shard + 1, [], [], 0
        if ids:
            yield from flush(shard, keys, ids)

    names = ["shard", "row", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "keys", "offsets"]
    key_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())

    def flush(shard, keys, ids):
        rows = pack_shard(ids, room)
        for s in range(0, len(rows), 256):
            part = rows[s:s + 256]
            cols = [[] for _ in names]
            for i, segs in enumerate(part):
                full = np.full(room, end_id, dtype=wide)
                place = np.zeros(room, dtype=wide)
                cu, at = [0], 0
                for _, _, x in segs:
                    full[at:at + len(x)] = x
                    place[at:at + len(x)] = np.arange(len(x))
                    at += len(x)
                    cu.append(at)
                for c, v in zip(cols, (shard, s + i, at, full.tobytes(), place.tobytes(), cu, [keys[d] for d, _, _ in segs],
                                       [o for _, o, _ in segs])):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()),
                     pa.list_(key_type), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    spark_key = kind.simpleString() if kind.simpleString() in ("bigint", "int") else "string"
    if spark_key == "string" and kind.simpleString() != "string":
        src = src.withColumn("k", F.col("k").cast("string"))
    return src.mapInArrow(run, "shard long, row long, n_tokens int, input_ids binary, position_ids binary, "
                               f"cu_seqlens array<int>, keys array<{spark_key}>, offsets array<long>")


def segments(packed: DataFrame) -> DataFrame:
    """One row per segment: key, offset, shard, row, begin, length."""
    seg = F.arrays_zip("keys", "offsets", F.expr("slice(cu_seqlens, 1, size(keys))").alias("begin"),
                       F.expr("slice(cu_seqlens, 2, size(keys))").alias("end"))
    return packed.select("shard", "row", F.explode(seg).alias("s")).select(
        F.col("s.keys").alias("key"), F.col("s.offsets").alias("offset"), "shard", "row", "s.begin",
        (F.col("s.end") - F.col("s.begin")).alias("length"))


def write(packed: DataFrame, path: str, mode: str = "errorifexists"):
    """The packed rows as Parquet, one file per task; ``input_ids`` and
    ``position_ids`` of a shard, in row order, are its id and position
    matrices."""
    packed.write.mode(mode).parquet(path)
