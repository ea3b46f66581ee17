"""Batched lattice work over a fixed piece vocabulary.

Words of one length advance together. A rolling hash gives the hash of every
substring; the hashes probe the sorted piece keys, and a hit is confirmed by
comparing the code points, so a hash collision cannot change a result.
``viterbi`` keeps the best segmentation, ``forward`` sums over all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def load_pieces(model_path: str):
    """(pieces, scores, byte piece ids by byte value, unk id) of a SentencePiece
    model file. Only normal and user-defined pieces can match text: the others
    are given as ''."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    pieces, scores, byte_ids = [], np.zeros(n), np.full(256, sp.unk_id(), dtype=np.int32)
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        special = sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        pieces.append("" if special else piece)
        scores[i] = sp.get_score(i)
    return pieces, scores, byte_ids, sp.unk_id()


def code_points(words: pa.Array, length: int) -> np.ndarray:
    """Code points of words that all have ``length`` characters."""
    text = "".join(words.to_pylist())
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(-1, length)


class PieceTable:
    """Pieces sorted by the hash of their code points."""

    def __init__(self, pieces):
        self.size = len(pieces)
        by_len: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p:
                by_len.setdefault(len(p), []).append(i)
        self.max_len = max(by_len, default=1)
        self.levels = {}
        for n, ids in by_len.items():
            cp = code_points(pa.array([pieces[i] for i in ids], pa.large_string()), n)
            h = self._prefix(cp)[:, -1]
            order = np.argsort(h, kind="stable")
            key = h[order]
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(key * _MIX) >> np.uint64(44)] = True
            self.levels[n] = (key, np.asarray(ids, dtype=np.int32)[order], cp[order], seen)

    @staticmethod
    def _prefix(cp):
        h = np.zeros((cp.shape[0], cp.shape[1] + 1), dtype=np.uint64)
        base = np.uint64(_BASE)
        for i in range(cp.shape[1]):
            h[:, i + 1] = h[:, i] * base + cp[:, i] + np.uint64(1)
        return h

    def hits(self, cp: np.ndarray):
        """{length: (row, start, piece id)} of every piece occurrence, sorted by
        start within a length."""
        prefix = np.ascontiguousarray(self._prefix(cp).T)
        n, out = cp.shape[1], {}
        power = np.uint64(1)
        base = np.uint64(_BASE)
        for size in range(1, min(n, self.max_len) + 1):
            power = np.uint64((int(power) * int(base)) & 0xFFFFFFFFFFFFFFFF)
            if size not in self.levels:
                continue
            key, ids, piece_cp, seen = self.levels[size]
            h = prefix[size:] - prefix[:-size] * power
            start, row = np.nonzero(seen[(h * _MIX) >> np.uint64(44)])
            if not len(start):
                continue
            found = h[start, row]
            at = np.minimum(np.searchsorted(key, found), len(key) - 1)
            ok = key[at] == found
            for k in range(size):
                ok &= piece_cp[at, k] == cp[row, start + k]
            out[size] = (row[ok], start[ok], ids[at[ok]])
        return out

    def _by_end(self, cp):
        """For every end position: a list of (length, rows, piece ids); a
        position without a one-character piece gets piece id -1 there."""
        n_rows, n = cp.shape
        ends = [[] for _ in range(n + 1)]
        single = np.zeros((n, n_rows), dtype=bool)
        for size, (row, start, ids) in self.hits(cp).items():
            cut = np.searchsorted(start, np.arange(n + 1))
            for s in range(n - size + 1):
                a, b = cut[s], cut[s + 1]
                if b > a:
                    ends[s + size].append((size, row[a:b], ids[a:b]))
            if size == 1:
                single[start, row] = True
        for s in range(n):
            miss = np.nonzero(~single[s])[0]
            if len(miss):
                ends[s + 1].append((1, miss, np.full(len(miss), -1, dtype=np.int32)))
        return ends

    def viterbi(self, cp: np.ndarray, scores: np.ndarray, unk_score: float):
        """Best segmentation of every row: (row of each piece, start, end, id),
        in text order; id -1 is an unknown character. Ties go to the longer
        last piece."""
        n_rows, n = cp.shape
        best = np.full((n + 1, n_rows), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, n_rows), dtype=np.int32)
        pid = np.full((n + 1, n_rows), -1, dtype=np.int32)
        table = np.append(scores, unk_score)
        for end, arcs in enumerate(self._by_end(cp)):
            for size, row, ids in sorted(arcs, key=lambda a: -a[0]):
                cand = best[end - size][row] + table[ids]
                better = cand > best[end][row]
                r = row[better]
                best[end][r], back[end][r], pid[end][r] = cand[better], size, ids[better]
        rows, starts, ends_, ids_ = [], [], [], []
        at, live = np.full(n_rows, n), np.arange(n_rows)
        while len(live):
            end = at[live]
            size = back[end, live]
            rows.append(live)
            starts.append(end - size)
            ends_.append(end)
            ids_.append(pid[end, live])
            at[live] = end - size
            live = live[at[live] > 0]
        if not rows:
            return (np.zeros(0, np.int64),) * 4
        rows, starts, ends_, ids_ = (np.concatenate(x) for x in (rows, starts, ends_, ids_))
        order = np.lexsort((starts, rows))
        return rows[order], starts[order], ends_[order], ids_[order]

    def forward(self, cp: np.ndarray, prob: np.ndarray, unk: float) -> np.ndarray:
        """log of the summed probability of all segmentations, per row and
        column of ``prob`` [pieces, languages]. Values are rescaled as the words
        advance, so length is no limit."""
        n_rows, n = cp.shape
        k = prob.shape[1]
        table = np.vstack([prob, np.full((1, k), unk)])
        width = self.max_len + 1
        alpha = np.zeros((width, n_rows, k))
        alpha[0] = 1
        shift = np.zeros((n_rows, k))
        for end, arcs in enumerate(self._by_end(cp)):
            if end == 0:
                continue
            cur = np.zeros((n_rows, k))
            for size, row, ids in arcs:
                cur[row] += alpha[(end - size) % width][row] * table[ids]
            alpha[end % width] = cur
            if end % 8 == 0:
                top = np.maximum(cur, 1e-300)
                alpha /= top
                shift += np.log(top)
        return np.log(np.maximum(alpha[n % width], 1e-300)) + shift

    def expected(self, cp: np.ndarray, prob: np.ndarray, unk: float, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts under one language's ``prob`` (one E-step),
        each row counted ``weight`` times. Forward sums are kept as logarithms
        per position and backward sums relative to them, so length is no limit."""
        n_rows, n = cp.shape
        table = np.append(prob, unk)
        ends = self._by_end(cp)
        total = np.zeros((n + 1, n_rows))  # log of the summed probability of every prefix
        for end in range(1, n + 1):
            cur = np.zeros(n_rows)
            for size, row, ids in ends[end]:
                cur[row] += table[ids] * np.exp(total[end - size][row] - total[end - 1][row])
            total[end] = total[end - 1] + np.log(np.maximum(cur, 1e-300))
        through = np.zeros((n + 1, n_rows))  # share of the row's probability that has a cut here
        through[n] = 1
        counts = np.zeros(self.size + 1)
        for end in range(n, 0, -1):
            for size, row, ids in ends[end]:
                step = table[ids] * np.exp(total[end - size][row] - total[end][row]) * through[end][row]
                through[end - size][row] += step
                np.add.at(counts, ids, step * weight[row])
        return counts[:-1]


def by_length(words: pa.Array):
    """(length in characters, positions) groups of a word array."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for idx in np.split(order, cut):
        if len(idx):
            yield int(size[idx[0]]), idx
