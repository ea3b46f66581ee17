"""Decoding and scoring with a scorer that sees whole prefixes (U1 with D3, D4).

A scorer stands for a network: it gets every open prefix of a batch of keys at
once, as an Arrow table, and returns candidates for the next token. All keys of
a batch advance together inside their task, one scorer call a step, so a step
costs one call and no Spark job; keys that end leave the table. The state of a
task is the open prefixes of one batch, and a lost task decodes its keys again.

``make_scorer()`` runs once per task (it may load weights there) and returns
``scorer(table) -> table``: in, one row per open prefix with ``prefix`` (list)
and the context columns; out, ``row`` (place of the prefix, from 0), ``nxt``
and ``logp``, any number of rows per prefix, in any order. No candidates end
the prefix as it is.

Greedy decoding is a beam of one: candidates rank by logp, then by token;
sequences by score / ((5 + L) / 6) ** alpha rounded to nine places, then by
their tokens.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def best_candidates(got: pa.Table, beam: int) -> dict[int, list]:
    """{row: [(token, logp)]}: the ``beam`` best candidates of every row."""
    order = pc.sort_indices(got, [("row", "ascending"), ("logp", "descending"), ("nxt", "ascending")])
    got = got.take(order)
    row = got.column("row").to_numpy()
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    keep = rank < beam
    out: dict[int, list] = {}
    got = got.filter(pa.array(keep))
    for r, t, p in zip(row[keep].tolist(), got.column("nxt").to_pylist(), got.column("logp").to_pylist()):
        out.setdefault(r, []).append((t, p))
    return out


def decode_batch(seqs: list, contexts: dict, prefix_type, scorer, beam: int, max_len: int, alpha: float, eos) -> list:
    """[(tokens, score, ended, norm)] of every start sequence (None and empty
    ones have nothing to continue)."""
    def norm(score, n):
        return round(score / ((5.0 + n) / 6.0) ** alpha, 9)

    def ranked(cands):
        return sorted(cands, key=lambda c: (-norm(c[1], len(c[0])), c[0]))

    beams = [[(list(s or ()), 0.0, not s)] for s in seqs]
    for _ in range(max_len):
        open_ = [(k, b) for k, bs in enumerate(beams) for b in bs if not b[2]]
        if not open_:
            break
        at = pa.array([k for k, _ in open_])
        table = pa.table({"prefix": pa.array([b[0] for _, b in open_], prefix_type), **{c: v.take(at) for c, v in contexts.items()}})
        found = best_candidates(scorer(table), beam)
        grown: dict[int, list] = {}
        for row, (k, (seq, score, _)) in enumerate(open_):
            after = [([*seq, t], score + p, t == eos) for t, p in found.get(row, ())]
            grown.setdefault(k, []).extend(after or [(seq, score, True)])
        for k, cands in grown.items():
            beams[k] = ranked([b for b in beams[k] if b[2]] + cands)[:beam]
    best = [ranked(bs)[0] for bs in beams]
    return [(s, score, ended, norm(score, len(s))) for s, score, ended in best]


def scorer_decode(starts: DataFrame, make_scorer, beam: int = 4, max_len: int = 128, alpha: float = 0.6, eos="</s>",
                  key: str = "key", ctx=("lang",), rows: int = 256) -> DataFrame:
    """``starts``: key, ctx..., seq (array). Adds score, ended and norm of the best
    continuation of at most ``max_len`` tokens. At most ``rows`` keys advance
    together."""
    src = starts.select(key, *ctx, "seq")
    schema = T.StructType(src.schema.fields + [T.StructField("score", T.DoubleType()), T.StructField("ended", T.BooleanType()),
                                               T.StructField("norm", T.DoubleType())])
    names = schema.names

    def run(batches):
        scorer = make_scorer()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                seq = b.column("seq")
                got = decode_batch(seq.to_pylist(), {c: b.column(c) for c in ctx}, seq.type, scorer, beam, max_len, alpha, eos)
                tokens, score, ended, norm = zip(*got)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (key, *ctx)], pa.array(tokens, seq.type), pa.array(score, pa.float64()),
                                                  pa.array(ended, pa.bool_()), pa.array(norm, pa.float64())], names=names)

    return src.mapInArrow(run, schema)


def forced_scores(rows: DataFrame, make_scorer, key: str, prefix: str, target: str, ctx=(), pad=None, batch: int = 256) -> DataFrame:
    """Teacher forcing: (key, pos, target, logp) of every target that is not
    ``pad``. ``make_scorer()`` returns ``scorer(table) -> list of logp lists``; the
    table holds ``prefix`` and ``target`` (arrays of one length: the target of a
    place follows the prefix up to it) and the context columns."""
    src = rows.select(key, prefix, target, *ctx)
    target_type = src.schema[target].dataType.elementType
    schema = T.StructType([src.schema[key], T.StructField("pos", T.IntegerType()), T.StructField("target", target_type),
                           T.StructField("logp", T.DoubleType())])

    def run(batches):
        scorer = make_scorer()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                table = pa.table([b.column(prefix), b.column(target), *[b.column(c) for c in ctx]], names=["prefix", "target", *ctx])
                targets = b.column(target)
                got = scorer(table)
                keep = [(i, p, t, v) for i, (ts, vs) in enumerate(zip(targets.to_pylist(), got))
                        for p, (t, v) in enumerate(zip(ts or (), vs or ())) if t != pad]
                i, p, t, v = zip(*keep) if keep else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(i, pa.int64())), pa.array(p, pa.int32()),
                                                  pa.array(t, targets.type.value_type), pa.array(v, pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)


class PrefixCache:
    """A scorer that looks at the whole prefix: a next-token table mixed with what
    followed the same token earlier in the prefix,
    p = (weight * table + times this token followed) / (weight + times any did).
    ``table``: {(context..., previous): [(next, logp)]}."""

    def __init__(self, table: dict, ctx=(), weight: float = 4.0):
        self.table, self.ctx, self.weight = table, tuple(ctx), weight

    def __call__(self, rows: pa.Table) -> pa.Table:
        at, nxt, logp = [], [], []
        contexts = zip(*(rows.column(c).to_pylist() for c in self.ctx)) if self.ctx else [()] * rows.num_rows
        for i, (prefix, c) in enumerate(zip(rows.column("prefix").to_pylist(), contexts)):
            prev = prefix[-1]
            followed = Counter(b for a, b in zip(prefix, prefix[1:]) if a == prev)
            total = self.weight + sum(followed.values())
            for t, p in self.table.get((*c, prev), ()):
                at.append(i)
                nxt.append(t)
                logp.append(math.log((self.weight * math.exp(p) + followed[t]) / total))
        return pa.table({"row": pa.array(at, pa.int64()), "nxt": pa.array(nxt, rows.schema.field("prefix").type.value_type),
                         "logp": pa.array(logp, pa.float64())})


def cached_scores(rows: pa.Table, weight: float = 4.0) -> list:
    """The same mixture for given targets, the table's part being the column
    ``base`` (logp of every target): a scorer for ``forced_scores``."""
    out = []
    for prefix, target, base in zip(*(rows.column(c).to_pylist() for c in ("prefix", "target", "base"))):
        follow: dict = {}
        got = []
        for i, (prev, nxt, p) in enumerate(zip(prefix or (), target or (), base or ())):
            seen = follow.setdefault(prev, Counter())
            got.append(math.log((weight * math.exp(p) + seen[nxt]) / (weight + seen.total())))
            if i + 1 < len(prefix):
                seen[prefix[i + 1]] += 1
        out.append(got)
    return out
