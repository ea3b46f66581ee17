"""Exact top-k inner products by Fagin's threshold algorithm.

Components become floor(1024 x). Vectors are packed into blocks of rows, and
every block meets every block of queries (a stated query set against all rows).
In a block each dimension has its list of rows sorted by value. A query reads
its lists side by side from the end its sign prefers; every row met for the first
time is scored in full (random access), and the reading stops as soon as no
unseen row can reach the k-th score: the bound is the inner product of the query
with the values at the current depth. The k best of each block then compete in a
window per query, so a task holds two blocks and k rows per query.

Equal vectors of a block are one entry with their ids; only the k + 1 smallest
ids of an entry can be in a result, so a vector that fills a third of the table
costs no more than any other.

Cases: rows with a null id, a null vector or a null or non-finite component take
no part. Vectors only meet vectors of their own length (two empty ones score 0).
Ties go to the smaller id. A query does not meet rows with its own id; a row that
repeats is a query (and a candidate) each time. Fewer than k candidates give
fewer rows; an empty table gives none. Scores beyond a 64-bit integer saturate; a
component that overflows when scaled counts as the largest double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
BLOCK = 8192


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), at most the largest double."""
    most = np.finfo(float).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -most, most)


def scores(q: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products of float-held integers, exact; ``top`` bounds the
    absolute values."""
    if top < 2**53:
        return (x @ q).astype(np.int64)
    if top < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    big = [int(v) for v in q]
    full = [sum(a * int(b) for a, b in zip(big, row)) for row in x]
    return np.array([max(-2**63, min(2**63 - 1, v)) for v in full], dtype=np.int64)


class Lists:
    """A block: distinct vectors, their ids, and one sorted list a dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        if x.shape[1]:
            self.x, entry = np.unique(x, axis=0, return_inverse=True)
        else:
            self.x, entry = x[:1], np.zeros(len(x), dtype=np.int64)
        entry = entry.ravel()
        order = np.lexsort((ids, entry))
        entry, self.ids = entry[order], ids[order]
        self.first = np.searchsorted(entry, np.arange(len(self.x) + 1))
        self.order = np.argsort(self.x, axis=0, kind="stable").T.astype(np.int32)
        self.value = np.take_along_axis(self.x.T, self.order, axis=1)
        with np.errstate(over="ignore"):
            self.most = float(np.abs(x).max(initial=0)) * x.shape[1]

    def others(self, entry: int, own: int) -> np.ndarray:
        """Ids of an entry but the query's own, ascending."""
        ids = self.ids[self.first[entry]:self.first[entry + 1]]
        a, b = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
        return ids if a == b else np.concatenate((ids[:a], ids[b:]))

    def top(self, own: int, q: np.ndarray, k: int):
        """[(score, id)] of the k best for one query, and rows scored."""
        n, limit = len(self.x), self.most * max(float(np.abs(q).max(initial=0)), 1.0)
        use = np.flatnonzero(q)
        up, down = use[q[use] < 0], use[q[use] > 0]
        seen, n_seen = np.zeros(n, dtype=bool), 0
        entry, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor, depth, step = None, 0, 64
        edge = np.zeros((1, len(q)))
        while n_seen < n:
            to = min(n, depth + step) if len(use) else n
            new = np.zeros(n, dtype=bool)
            if len(use):
                new[self.order[up, depth:to].ravel()] = True
                new[self.order[down, n - to:n - depth].ravel()] = True
                new &= ~seen
            else:
                new[:] = True
            seen |= new
            new = np.flatnonzero(new)
            n_seen += len(new)
            if len(new):
                s = scores(q, self.x[new], limit)
                entry, score = np.concatenate((entry, new)), np.concatenate((score, s))
                floor = self._floor(entry, score, own, k)
                if floor is not None:
                    keep = score >= floor
                    entry, score = entry[keep], score[keep]
            depth, step = to, step * 2
            if floor is not None and len(use):
                edge[0, up], edge[0, down] = self.value[up, depth - 1], self.value[down, n - depth]
                if int(scores(q, edge, limit)[0]) < floor:  # an equal bound may hide a smaller id
                    break
        out = []
        for e, s in zip(entry.tolist(), score.tolist()):
            out += [(s, i) for i in self.others(e, own)[:k].tolist()]
        out.sort(key=lambda t: (-t[0], t[1]))
        return out[:k], n_seen

    def _floor(self, entry, score, own, k):
        """The k-th best score so far (None if fewer candidates)."""
        m = min(len(score), k + 1)  # every entry but the query's own has a candidate
        best = np.argpartition(-score, m - 1)[:m]
        have = 0
        for i in best[np.argsort(-score[best], kind="stable")].tolist():
            have += len(self.others(int(entry[i]), own))
            if have >= k:
                return int(score[i])
        return None


def _usable(df: DataFrame, key: str, vec: str) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & fine)


def _blocks(rows: DataFrame, block: int, parts: int, key: str) -> DataFrame:
    """One row per block: its number, vector length, ids and components."""
    def pack(batches):
        by_dim: dict[int, list] = {}
        for b in batches:
            dims = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                by_dim.setdefault(int(d), []).append((ids[at], scaled(x)))
                while sum(len(i) for i, _ in by_dim[d]) >= block:
                    yield cut(int(d), by_dim, block)
        for d in list(by_dim):
            while by_dim[d]:
                yield cut(d, by_dim, block)

    def cut(d, by_dim, n):
        ids = np.concatenate([i for i, _ in by_dim[d]])
        x = np.concatenate([v for _, v in by_dim[d]])
        by_dim[d] = [(ids[n:], x[n:])] if len(ids) > n else []
        small = np.abs(x[:n]).max(initial=0) < 2**31
        data = x[:n].astype(np.int32 if small else np.float64)
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([d], pa.int32()), "n": pa.array([len(ids[:n])], pa.int32()),
            "ids": pa.array([ids[:n].astype(np.int64).tobytes()], pa.binary()), "x": pa.array([data.tobytes()], pa.binary())})

    out = rows.repartition(parts, key).mapInArrow(pack, "dim int, n int, ids binary, x binary")
    return out.withColumn("nr", F.monotonically_increasing_id())


def _matrix(data: bytes, n: int, d: int) -> np.ndarray:
    kind = np.int32 if len(data) == 4 * n * d else np.float64
    return np.frombuffer(data, kind).reshape(n, d).astype(np.float64)


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 10,
          block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for every usable row of ``queries``
    against every usable row of ``vectors`` with another id."""
    rows, asked = _usable(vectors, key, vec), _usable(queries, key, vec)
    n_rows, n_asked = rows.count(), asked.count()
    places = max(1, -(-n_rows // block))
    left = _blocks(rows, block, places, "id").select(
        "dim", F.col("n").alias("vn"), F.col("ids").alias("vids"), F.col("x").alias("vx"),
        F.pmod(F.xxhash64("nr"), F.lit(places)).alias("place"))
    step = max(64, block // 8)
    right = _blocks(asked, step, max(1, -(-n_asked // step)), "id").select(
        "dim", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("x").alias("qx"), F.col("nr").alias("qnr"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long"))).alias("place"))
    # the queries are the small side: their blocks go to every place, the blocks
    # of vectors are spread over as many places as there are blocks
    met = left.join(right, ["dim", "place"])

    def solve(batches):
        for b in batches:
            for r in b.to_pylist():
                x, q = _matrix(r["vx"], r["vn"], r["dim"]), _matrix(r["qx"], r["qn"], r["dim"])
                lists = Lists(np.frombuffer(r["vids"], np.int64), x)
                out = [(r["qnr"], i, int(o), s, v) for i, o in enumerate(np.frombuffer(r["qids"], np.int64))
                       for s, v in lists.top(int(o), q[i], k)[0]]
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["block", "q", "query_id", "score", "vec_id"])

    found = met.mapInArrow(solve, "block long, q long, query_id long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("block", "q").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
