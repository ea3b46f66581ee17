"""SentencePiece encoding and decoding with a batched Viterbi.

A text is split before every run of spaces; no piece crosses such a place, so
each distinct chunk of a slice is segmented once. Chunks of equal length advance
together (``pieces.PieceTable.viterbi``). The segmentation has the highest sum
of piece scores of the model file (the unigram rule; for a model file made by
merges its scores are merge ranks, and the highest sum can differ from replaying
the merges). Characters without a piece become byte pieces, so decoding gives
the text back exactly, except that U+2581 reads as a space (``round_trip`` is
false for such a text).

Cases: null gives null ids and a null text, '' an empty list. Equal sums go to
the longer last piece. Rows are independent: repeated rows and an empty table
need no rule. Very long chunks take one numpy step per character.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from tokenmill.llm.common import (PIECE_MODEL, as_text, dictionary, free_name, map_arrow, prefixed, quoted, slices, text_batches,
                                  with_fields, worker_store)
from tokenmill.llm.pieces import SPACE, PieceTable, by_length, code_points, load_pieces

UNK_PENALTY = 10.0
CELLS = 200_000  # chunk characters advanced together


class Codec:
    def __init__(self, pieces, scores, byte_ids, unk_id, cache=None):
        cache = {} if cache is None else cache
        if "table" not in cache:
            cache["table"] = PieceTable(pieces)
        self.table, self.scores, self.byte_ids = cache["table"], scores, np.asarray(byte_ids, dtype=np.int32)
        real = scores[[i for i, p in enumerate(pieces) if p]]
        self.unk_score = (real.min() if len(real) else 0.0) - UNK_PENALTY
        raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(self.byte_ids):
            if i != unk_id:
                raw[i] = bytes([b])
        self.raw = pa.array(raw, pa.large_binary())

    def _chunks(self, texts: pa.Array):
        """Every chunk with its spaces as SPACE, and the chunks per text."""
        texts = pc.replace_substring(texts, SPACE, " ")
        empty = pc.equal(pc.binary_length(texts), 0)
        lead = pc.if_else(empty, pa.scalar("", texts.type), prefixed(" ", texts))
        if pc.any(pc.match_substring(lead, "  ")).as_py():
            # the first space of a run becomes the separator, the others SPACE
            cut = []
            for t in lead.to_pylist():
                marked, prev = [], ""
                for part in t.split(" ")[1:]:
                    if part == "":
                        prev += SPACE
                    else:
                        marked.append(prev + part)
                        prev = ""
                if prev:
                    marked.append(prev[:-1])
                cut.append(marked)
            n = np.array([len(x) for x in cut], dtype=np.int64)
            flat = pa.array([y for x in cut for y in x], pa.large_string())
        else:
            parts = pc.split_pattern(lead, " ")
            flat, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
            first = np.ones(len(owner), dtype=bool)
            first[1:] = owner[1:] != owner[:-1]
            n = np.bincount(owner[~first], minlength=len(texts)).astype(np.int64)
            flat = flat.filter(pa.array(~first))
        return prefixed(SPACE, flat.cast(pa.large_string())), n

    def _segment(self, chunks: pa.Array):
        """(ids of all chunks in a row, ids per chunk)."""
        counts = np.zeros(len(chunks), dtype=np.int64)
        ids_of, where = [], []
        for n, idx in by_length(chunks):
            for part in np.array_split(idx, max(1, len(idx) * n // CELLS)):
                cp = code_points(chunks.take(pa.array(part)), n)
                row, start, _, ids = self.table.viterbi(cp, self.scores, self.unk_score)
                unk = np.flatnonzero(ids < 0)
                if len(unk):
                    chars = cp[row[unk], start[unk]]
                    utf8 = [chr(c).encode("utf-8", "surrogatepass") for c in chars]
                    more = np.ones(len(ids), dtype=np.int64)
                    more[unk] = [len(u) for u in utf8]
                    at = (np.cumsum(more) - more)[unk]
                    row, ids = np.repeat(row, more), np.repeat(ids, more)
                    data = np.frombuffer(b"".join(utf8), dtype=np.uint8)
                    spots = np.concatenate([np.arange(a, a + len(u)) for a, u in zip(at, utf8)])
                    ids[spots] = self.byte_ids[data]
                counts[part] = np.bincount(row, minlength=len(part))
                ids_of.append(ids.astype(np.int32))
                where.append(part)
        if not ids_of:
            return (np.zeros(0, np.int32), counts), counts
        order = np.concatenate(where)
        flat = np.concatenate(ids_of)
        begin_sorted = np.cumsum(counts[order]) - counts[order]
        begin = np.empty(len(chunks), dtype=np.int64)
        begin[order] = begin_sorted
        return (flat, begin), counts

    def encode(self, texts: pa.Array) -> pa.Array:
        """list<int32> of every text ('' gives an empty list)."""
        chunks, n = self._chunks(texts)
        dic, code = dictionary(chunks)
        got, counts = self._segment(dic)
        if len(code):
            flat, begin = got
            size = counts[code]
            total = np.cumsum(size)
            take = np.repeat(begin[code] - (total - size), size) + np.arange(total[-1])
            ids = flat[take]
            ends = np.concatenate(([0], total))[np.concatenate(([0], np.cumsum(n)))]
        else:
            ids, ends = np.zeros(0, np.int32), np.zeros(len(n) + 1, np.int64)
        return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Text of every id list: piece bytes joined, the leading space that
        encoding adds removed; bytes that are no UTF-8 read as U+FFFD."""
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        ids = ids.cast(pa.large_list(pa.int32()))
        flat = self.raw.take(ids.flatten())
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]
        data = memoryview(flat.buffers()[2])[:] if len(flat) else memoryview(b"")
        base = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset] if len(flat) else 0
        out = []
        for a, b in zip(at[:-1], at[1:]):
            text = bytes(data[base + a:base + b]).decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return pa.array(out, pa.large_string())


def _shared(df: DataFrame, model_path: str):
    text_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(load_pieces(model_path)), f"sp-{uuid.uuid4()}"


def encode(df: DataFrame, text: str = "text", out: str = "ids", keep=None, model_path: str = PIECE_MODEL,
           check: bool = False) -> DataFrame:
    """``keep`` columns (default all others than ``out``) plus ``out``
    array<int>; with ``check`` also round_trip: decoding the ids gives the text
    back."""
    keep = [c for c in df.columns if c not in (out, "round_trip")] if keep is None else list(keep)
    work = free_name(keep, "worked")
    src = df.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text)).alias(work))
    shared, store = _shared(df, model_path)

    def run(batches):
        codec = Codec(*shared.value, cache=worker_store(store))
        for b in batches:
            raw = b.column(work)
            texts, null = as_text(raw), pc.is_null(raw)
            for at, n in slices(texts):
                part, gone = texts.slice(at, n), null.slice(at, n)
                ids = codec.encode(part)
                cols = [b.column(c).slice(at, n) for c in keep]
                cols.append(pc.if_else(gone, pa.scalar(None, ids.type), ids).cast(pa.list_(pa.int32())))
                if check:
                    same = pc.equal(codec.decode(ids), part)
                    cols.append(pc.if_else(gone, pa.scalar(None, pa.bool_()), same))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, out, *["round_trip"] * check])

    more = {out: ArrayType(IntegerType())} | ({"round_trip": BooleanType()} if check else {})
    return map_arrow(src, run, with_fields(df, keep, more))


def decode(df: DataFrame, ids: str = "ids", out: str = "text", keep=None, model_path: str = PIECE_MODEL) -> DataFrame:
    """``keep`` columns (default all but ``out``) plus the decoded text; null
    ids give null, ids outside the vocabulary fail."""
    keep = [c for c in df.columns if c != out] if keep is None else list(keep)
    work = free_name(keep, "worked")
    src = df.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(ids)).cast("array<int>").alias(work))
    shared, store = _shared(df, model_path)

    def run(batches):
        codec = Codec(*shared.value, cache=worker_store(store))
        for b in batches:
            col = b.column(work)
            text = pc.if_else(pc.is_null(col), pa.scalar(None, pa.large_string()), codec.decode(col))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], text.cast(pa.string())],
                                             names=[*keep, out])

    return map_arrow(src, run, with_fields(df, keep, {out: StringType()}))
