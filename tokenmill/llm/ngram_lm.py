"""Bigram language-model scores from a sharded Elias-Fano trie.

Tokens: A-Z lower-cased words plus one end token a text. The model mixes

    p(w | v) = mu(v) p1(w) + (1 - mu(v)) c(v w) / c(v),
    p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
    mu(v) = MIX if c(v) > 0, else 1,

whatever the size of the corpus, so log p(w | v) = log mu(v) + log(p1(w) + r(v)
c(v w)) with r(v) = (1 - MIX) / (MIX c(v)). The first term depends on v alone,
the second is known where w's counts are and c(v) is brought to: a text's score
is a sum of terms that each live in one word's shard, so every token crosses the
network once and only sums per text come back.

1. ``vocabulary``: distinct words per slice, counted per shard: N, V and the
   frequent words (a bounded list: a share of at least FREQUENT of the text). A
   slice also says which shards' words follow each of its words in training
   texts, and the counting shard answers each of them once with the word's exact
   count, so the answers follow the distinct (word, shard) pairs.
2. Slices send each shard its tokens (word, preceding word, text). A word that
   fills more than a quarter of a shard is split over shards by the preceding
   word; its count comes from step 1. Step 1 does not know these words yet, so
   the pairs go to the shard of the preceding word, which gets that word's count
   anyway, or anywhere if both are such words (their counts go to every task).
3. A shard counts its training tokens and builds the trie in a file that is
   mapped into memory: level 1 holds the words (Elias-Fano coded hashes),
   quantised log p1 and log mu; monotone pointers lead to level 2, the preceding
   words below each word (Elias-Fano, relative to the word) with quantised log
   probabilities. Every token, held out or not, is then answered by successor
   search below its word.

Words are known by their 64-bit XXH64. Memory per task follows the shard and
slice sizes, not the corpus.

Cases: a null or blank text is one end token. Without any training text every
count is 0 and both scores are those of p1 = 1 (N = V = 0: (0.5) / (0.5)).
Repeated rows are scored each by itself and count each. Other columns are
ignored.
"""

from __future__ import annotations

import io
import math
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import as_text, dictionary, gathered, held_out, slices, split_words, text_batches
from tokenmill.session import cut_lineage

END, BOS = 0, 1  # hashes of the end token and of the context of first words
FOLDS = 5
MIX = 0.4
FREQUENT = 1e-5
SLICE = 8 << 20
SHARD_BYTES = 24 << 20  # text per shard, about 4 million tokens
PARTS = 16  # a shard's words are solved in so many parts


# ---- Elias-Fano sequences ------------------------------------------------

_BYTE_SELECT = np.zeros((256, 8), dtype=np.int64)
for _b in range(256):
    for _k, _at in enumerate(i for i in range(8) if _b >> i & 1):
        _BYTE_SELECT[_b, _k] = _at


def _select(words, before, k):
    """Position of the k-th set bit (from 0) of ``words``; ``before`` holds the
    set bits before every word."""
    w = np.searchsorted(before, k, side="right") - 1
    r = k - before[w]
    b = words[w].copy()
    pos = w * 64
    for step in (32, 16, 8):
        n = np.bitwise_count(b & np.uint64((1 << step) - 1)).astype(np.int64)
        go = r >= n
        r = r - np.where(go, n, 0)
        b = np.where(go, b >> np.uint64(step), b)
        pos = pos + np.where(go, step, 0)
    return pos + _BYTE_SELECT[(b & np.uint64(255)).astype(np.int64), r]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary."""

    FIELDS = ("low", "high", "ones", "zeros")

    def __init__(self, n, bits, arrays):
        self.n, self.bits = n, bits
        self.low, self.high, self.ones, self.zeros = arrays

    @classmethod
    def build(cls, values: np.ndarray, universe: int):
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, min(56, (max(universe, 1) // max(n, 1)).bit_length() - 1))
        top = int(values[-1] >> np.uint64(bits)) if n else 0
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            w, s = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, w, part << s)
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(low, w[over] + 1, part[over] >> (np.uint64(64) - s[over]))
        spots = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((n + top + 2) // 64 + 1) * 64, dtype=np.uint8)
        flags[spots] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))[:-1]
        zeros = np.arange(len(high)) * 64 - ones
        return cls(n, bits, (low, high, ones.astype(np.int64), zeros.astype(np.int64)))

    def _low(self, i):
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.bits
        w, s = at >> 6, (at & 63).astype(np.uint64)
        v = self.low[w] >> s
        more = self.low[w + 1] << ((np.uint64(64) - s) & np.uint64(63))
        return (v | np.where(s == 0, np.uint64(0), more)) & np.uint64((1 << self.bits) - 1)

    def get(self, i):
        i = np.asarray(i, dtype=np.int64)
        high = (_select(self.high, self.ones, i) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(i)

    def find(self, values, begin=None, end=None):
        """Index of every value (-1 if absent), searched as the successor in
        [begin, end) of the sequence."""
        values = np.asarray(values, dtype=np.uint64)
        if not self.n:
            return np.full(len(values), -1, dtype=np.int64)
        h = (values >> np.uint64(self.bits)).astype(np.int64)
        total = len(self.high) * 64 - self.n  # zeros in the unary part
        inside = h < total
        hc = np.minimum(h, total - 1)
        inv = ~self.high
        lo = np.where(hc > 0, _select(inv, self.zeros, np.maximum(hc - 1, 0)) - (hc - 1), 0)
        hi = _select(inv, self.zeros, hc) - hc
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        hi = np.where(inside, np.minimum(hi, self.n), lo)
        want = values & np.uint64((1 << self.bits) - 1)
        stop = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        ok = lo < stop
        at = np.flatnonzero(ok)
        ok[at] = self._low(lo[at]) == want[at]
        return np.where(ok, lo, -1)


def quantise(values: np.ndarray):
    """(code book of at most 256 values, one byte per value)."""
    if not len(values):
        return np.zeros(1), np.zeros(0, np.uint8)
    exact = np.unique(values)
    if len(exact) <= 256:
        return exact, np.searchsorted(exact, values).astype(np.uint8)
    edges = np.linspace(exact[0], exact[-1], 257)[1:-1]  # equal widths bound the error
    code = np.searchsorted(edges, values, side="right")
    n = np.bincount(code, minlength=len(edges) + 1)
    book = np.bincount(code, weights=values, minlength=len(edges) + 1) / np.maximum(n, 1)
    return book, code.astype(np.uint8)


class Trie:
    """Two levels in one memory-mapped file that lives as long as the mapping."""

    def __init__(self, words, count, log_p1, log_mu, node, prev_words, prev, log_pair):
        """words: sorted hashes; count, log_p1, log_mu per word; (node, prev):
        sorted pairs of word index and index into the sorted prev_words."""
        span = max(len(prev_words), 1)
        first = np.searchsorted(node, np.arange(len(words) + 1))
        book1, code1 = quantise(log_p1)
        book_mu, code_mu = quantise(log_mu)
        book2, code2 = quantise(log_pair)
        self.span = span
        parts = {"words": EliasFano.build(words, 1 << 64), "prevs": EliasFano.build(prev_words, 1 << 64),
                 "first": EliasFano.build(first, len(node) + 1),
                 "below": EliasFano.build(node.astype(np.uint64) * np.uint64(span) + prev.astype(np.uint64),
                                          len(words) * span)}
        arrays = {"count": count, "book1": book1, "code1": code1, "book_mu": book_mu, "code_mu": code_mu,
                  "book2": book2, "code2": code2}
        for name, ef in parts.items():
            arrays |= {f"{name}.{f}": getattr(ef, f) for f in EliasFano.FIELDS}
        fd, path = tempfile.mkstemp(suffix=".trie")
        spots, at = {}, 0
        with os.fdopen(fd, "wb") as f:
            for name, a in arrays.items():
                a = np.ascontiguousarray(a)
                spots[name] = (at, a.dtype, len(a))
                f.write(a.tobytes())
                pad = -a.nbytes % 8
                f.write(b"\0" * pad)
                at += a.nbytes + pad
            if not at:
                f.write(b"\0" * 8)
        self.bytes = at
        store = np.memmap(path, dtype=np.uint8, mode="r")
        os.unlink(path)  # the mapping keeps the data
        read = {k: store[a:a + n * t.itemsize].view(t) for k, (a, t, n) in spots.items()}
        self.a = read
        self.ef = {name: EliasFano(ef.n, ef.bits, [read[f"{name}.{f}"] for f in EliasFano.FIELDS])
                   for name, ef in parts.items()}

    def node(self, words):
        return self.ef["words"].find(words)

    def pair(self, node, prev_words):
        """log10(p1 + r c) of (node, preceding word) pairs, nan if not seen."""
        out = np.full(len(node), np.nan)
        prev = self.ef["prevs"].find(prev_words)
        at = np.flatnonzero((node >= 0) & (prev >= 0))
        if len(at):
            x = node[at]
            got = self.ef["below"].find(x.astype(np.uint64) * np.uint64(self.span) + prev[at].astype(np.uint64),
                                        self.ef["first"].get(x).astype(np.int64),
                                        self.ef["first"].get(x + 1).astype(np.int64))
            hit = got >= 0
            out[at[hit]] = self.a["book2"][self.a["code2"][got[hit]]]
        return out


# ---- tokens --------------------------------------------------------------

def word_hashes(words: pa.Array) -> np.ndarray:
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))
    return np.where(h <= BOS, h + np.uint64(2), h)


def tokens(texts: pa.Array):
    """(distinct hashes, code of every token, tokens per text): words, then one
    end token a text."""
    flat, n = split_words(texts)
    dic, code = dictionary(flat)
    h = np.append(word_hashes(dic), np.uint64(END))
    size = n + 1
    out = np.full(size.sum(), len(h) - 1, dtype=np.int32)
    at = np.arange(len(code)) + np.repeat(np.arange(len(n)), n)
    out[at] = code
    return h, out, size


def followers(code: np.ndarray, size: np.ndarray, shard: np.ndarray, shards: int):
    """Distinct (word, shard of a word that follows it) of the texts, sorted by
    word; a word that a quarter of the shards or more ask for has one entry with
    the shard ``shards``, which stands for all."""
    after = np.ones(len(code), dtype=bool)
    after[np.cumsum(size) - size] = False  # first tokens follow no word
    nxt = np.flatnonzero(after)
    key = np.unique(code[nxt - 1].astype(np.int64) * (shards + 1) + shard[code[nxt]])
    word, to = key // (shards + 1), key % (shards + 1)
    many = np.bincount(word, minlength=len(shard)) >= max(8, shards // 4)
    to[many[word]] = shards
    key = np.unique(word * (shards + 1) + to)
    return key // (shards + 1), key % (shards + 1)


def vocabulary(docs: DataFrame, shards: int, least: int):
    """(N, V, {hash: count} of words counted at least ``least`` times, rows
    (shard, prevs, counts) of the context counts that each shard needs); ``docs``
    has t and held."""
    def count(batches):
        for b in gathered(batches, SLICE):
            texts = as_text(b.column("t").filter(pc.invert(b.column("held"))))
            for at, n in slices(texts, SLICE):
                h, code, size = tokens(texts.slice(at, n))
                c = np.bincount(code, minlength=len(h))
                shard = (h % np.uint64(shards)).astype(np.int64)
                asks, to = followers(code, size, shard, shards)
                n_asks = np.bincount(asks, minlength=len(h))
                begin = np.cumsum(n_asks) - n_asks
                order = np.argsort(shard, kind="stable")
                cut = np.flatnonzero(np.diff(shard[order])) + 1
                parts = []
                for idx in np.split(order, cut):
                    k = n_asks[idx]
                    mine = np.repeat(begin[idx] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                    parts.append((shard[idx[0]], h[idx].tobytes(), c[idx].astype(np.uint32).tobytes(),
                                  k.astype(np.uint32).tobytes(), to[mine].astype(ask).tobytes()))
                types = [pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts), types)],
                                                 names=["shard", "h", "c", "asks", "to"])

    ask = np.uint16 if shards < 65536 else np.uint32

    def total(key, table):
        col = {name: np.concatenate([np.frombuffer(x, t) for x in table.column(name).to_pylist()])
               for name, t in (("h", np.uint64), ("c", np.uint32), ("asks", np.uint32), ("to", ask))}
        del table
        u, inv = np.unique(col["h"], return_inverse=True)
        n = np.bincount(inv, weights=col["c"]).astype(np.int64)
        often = n >= least
        # a word's own shard needs its count too: pairs with a split word go there
        to = np.concatenate((col["to"], np.full(len(u), key[0].as_py())))
        of = np.concatenate((np.repeat(inv, col["asks"]), np.arange(len(u))))
        pairs = np.unique(to * np.int64(len(u)) + of)
        to, of = pairs // len(u), pairs % len(u)
        at = np.searchsorted(to, np.arange(shards + 1))
        everywhere = of[at[shards]:]
        rows = [(int(n.sum()), len(u), u[often].view(np.int64), n[often], None, None, None)]
        for s in np.arange(shards) if len(everywhere) else np.unique(to):
            idx = np.concatenate((of[at[s]:at[s + 1]], everywhere))
            rows.append((0, 0, [], [], s, u[idx].tobytes(), n[idx].tobytes()))
        types = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), types)],
                        names=["n", "v", "h", "c", "shard", "prevs", "counts"])

    src = docs.select("t", "held")
    got = src.mapInArrow(count, "shard int, h binary, c binary, asks binary, to binary").groupBy("shard") \
        .applyInArrow(total, "n long, v long, h array<long>, c array<long>, shard int, prevs binary, counts binary")
    got = cut_lineage(got)
    n, v = got.agg(F.sum("n"), F.sum("v")).first()
    often = {}
    for r in got.where(F.size("h") > 0).select("h", "c").toLocalIterator():
        often |= {k % (1 << 64): c for k, c in zip(r[0], r[1])}
    return n or 0, v or 0, often, got.where("shard is not null").select("shard", "prevs", "counts")


def _mix(h: np.uint64):
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def send(texts: pa.Array, train: np.ndarray, shards: int, hot: np.ndarray):
    """(shard, words, run lengths, preceding words, their index, text index) for
    every shard that has tokens of these texts."""
    h, code, size = tokens(texts)
    text = np.repeat(np.arange(len(size), dtype=np.int32), size)
    prev = np.empty(len(code), dtype=np.int32)
    prev[1:] = code[:-1]
    prev[np.cumsum(size) - size] = len(h)  # BOS
    hp = np.append(h, np.uint64(BOS))
    shard = (h % np.uint64(shards)).astype(np.int64)[code]
    split = np.isin(h, hot)[code]
    if split.any():
        w, v = h[code[split]], hp[prev[split]]
        both = (v == BOS) | np.isin(v, hot)
        shard[split] = (np.where(both, _mix(w ^ _mix(v)), v) % np.uint64(shards)).astype(np.int64)
    rank = np.argsort(np.argsort(h, kind="stable"), kind="stable")
    by_hash = np.sort(h)
    key = shard * len(h) + rank[code]
    order = np.argsort(key, kind="stable").astype(np.int32)
    del key
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        idx = order[bounds[s]:bounds[s + 1]]
        if not len(idx):
            continue
        word, runs = np.unique(rank[code[idx]], return_counts=True)
        p, at = np.unique(prev[idx], return_inverse=True)
        small = np.uint16 if max(len(p), len(size)) <= 65536 else np.uint32
        yield (s, by_hash[word].tobytes(), runs.astype(np.uint32).tobytes(), hp[p].tobytes(),
               at.astype(small).tobytes(), text[idx].astype(small).tobytes(), np.packbits(train).tobytes(), len(size))


SENT = "chunk long, shard int, words binary, runs binary, prevs binary, at binary, text binary, train binary, texts int, rows binary"
SENT_NAMES = [f.split()[0] for f in SENT.split(", ")]


def context_counts(prevs: np.ndarray, told: list, often: dict) -> np.ndarray:
    """Training count of every one of the sorted ``prevs`` (0 if not told)."""
    out = np.zeros(len(prevs))
    if not len(prevs):
        return out
    for h, c in [*told, (np.fromiter(often, np.uint64, len(often)), np.fromiter(often.values(), np.int64, len(often)))]:
        at = np.minimum(np.searchsorted(prevs, h), len(prevs) - 1)
        hit = prevs[at] == h
        out[at[hit]] = c[hit]
    return out


def answer(table: pa.Table, total: int, distinct: int, often: dict):
    """(chunk, texts, base part, score part, known) for one shard."""
    z = total + 0.5 * (distinct + 1)
    rows = table.to_pylist()
    told = [(np.frombuffer(r["prevs"], np.uint64), np.frombuffer(r["at"], np.int64)) for r in rows if r["chunk"] is None]
    rows = [r for r in rows if r["words"]]
    del table
    if not rows:
        return
    words, runs, prevs, cur, prv, txt, train = [], [], [], [], [], [], []
    n_cur = n_prev = n_text = 0
    for r in rows:
        w, k = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["runs"], np.uint32)
        p = np.frombuffer(r["prevs"], np.uint64)
        small = np.uint16 if len(r["at"]) == 2 * int(k.sum()) else np.uint32
        words.append(w)
        prevs.append(p)
        cur.append(np.repeat(np.arange(n_cur, n_cur + len(w), dtype=np.int32), k))
        prv.append(np.frombuffer(r["at"], small).astype(np.int32) + np.int32(n_prev))
        txt.append(np.frombuffer(r["text"], small).astype(np.int32) + np.int32(n_text))
        train.append(np.unpackbits(np.frombuffer(r["train"], np.uint8))[:r["texts"]].astype(bool))
        n_cur, n_prev, n_text = n_cur + len(w), n_prev + len(p), n_text + r["texts"]
    words, to_word = np.unique(np.concatenate(words), return_inverse=True)
    prevs, to_prev = np.unique(np.concatenate(prevs), return_inverse=True)
    cur = to_word.astype(np.int32)[np.concatenate(cur)]
    prv = to_prev.astype(np.int32)[np.concatenate(prv)]
    txt, train = np.concatenate(txt), np.concatenate(train)
    del to_word, to_prev
    c_prev = context_counts(prevs, told, often)
    del told
    base, score, n_known = np.zeros(n_text), np.zeros(n_text), np.zeros(n_text, dtype=np.int64)
    touched = np.bincount(txt, minlength=n_text) > 0
    for part in range(PARTS):  # a part of the words at a time bounds the working memory
        mine = np.flatnonzero(cur % PARTS == part)
        if len(mine):
            got = _solve_part(words, prevs, c_prev, cur[mine], prv[mine], txt[mine], train, z, often)
            base += got[0]
            score += got[1]
            n_known += got[2]
    at = 0
    for r in rows:  # sums of the texts met here only; the quantised score as floats, added up in doubles
        idx = np.flatnonzero(touched[at:at + r["texts"]])
        k = n_known[at + idx]
        small, few = r["texts"] <= 65536, k.max(initial=0) < 65536
        yield (r["chunk"], idx.astype(np.uint16 if small else np.uint32).tobytes(), base[at + idx].tobytes(),
               score[at + idx].astype(np.float32).tobytes(), k.astype(np.uint16 if few else np.uint32).tobytes())
        at += r["texts"]


def _solve_part(all_words, all_prevs, all_c_prev, cur, prv, txt, train, z, often):
    """(base, score, known) per text of these tokens, whose words are all here."""
    n_text = len(train)
    used_words, cur = np.unique(cur, return_inverse=True)
    used_prevs, prv = np.unique(prv, return_inverse=True)
    words, prevs = all_words[used_words], all_prevs[used_prevs]
    frequent = np.fromiter(often, np.uint64, len(often))
    learn = train[txt]
    count = np.bincount(cur[learn], minlength=len(words))
    for i in np.flatnonzero(np.isin(words, frequent)):
        count[i] = often[int(words[i])]
    pairs, which = np.unique(cur * len(prevs) + prv, return_inverse=True)
    which = which.astype(np.int32)
    del prv
    seen = np.bincount(which[learn], minlength=len(pairs))
    of, before = pairs // len(prevs), pairs % len(prevs)
    del pairs

    # the trie holds what training has: words, and pairs seen at least once
    known = np.flatnonzero(count > 0)
    have = np.flatnonzero(seen > 0)
    c_prev = all_c_prev[used_prevs]
    if not c_prev[before[have]].all():
        raise RuntimeError("the documents changed between two reads: a context of the training texts has no count")
    r_prev = (1 - MIX) / (MIX * np.maximum(c_prev, 1))
    p1 = (count[known] + 0.5) / z
    mu = np.full(len(known), MIX)
    index = np.full(len(words), -1)
    index[known] = np.arange(len(known))
    used = np.unique(before[have])
    trie = Trie(words[known], count[known], np.log10(p1), np.log10(mu), index[of[have]], prevs[used],
                np.searchsorted(used, before[have]),
                np.log10((count[of[have]] + 0.5) / z + r_prev[before[have]] * seen[have]))

    node = trie.node(words)
    found = node >= 0
    c = np.zeros(len(words), dtype=np.int64)
    c[found] = trie.a["count"][node[found]]
    l1 = np.full(len(words), math.log10(0.5 / z))
    lm = np.zeros(len(words))
    l1[found] = trie.a["book1"][trie.a["code1"][node[found]]]
    lm[found] = trie.a["book_mu"][trie.a["code_mu"][node[found]]]
    lm[words == END] = 0  # the end token is nobody's context
    pair = trie.pair(node[of], prevs[before])
    value = np.where(np.isnan(pair), l1[of], pair) + lm[of]
    base = np.bincount(txt, weights=np.log10((c + 0.5) / z)[cur], minlength=n_text)
    score = np.bincount(txt, weights=value[which], minlength=n_text)
    return base, score, np.bincount(txt, weights=(c > 0)[cur], minlength=n_text).astype(np.int32)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known,
    train_tokens, base_score, score."""
    spark = docs.sparkSession
    text_batches(spark)
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"),
                      held_out(key, folds).alias("held"))
    size, rows, train_rows = src.agg(F.sum(F.octet_length("t")), F.count(F.lit(1)),
                                     F.sum((~F.col("held")).cast("long"))).first()
    size, train_rows = (size or 0) + 2 * rows, train_rows or 0
    shards = max(1, -(-size // SHARD_BYTES))
    total, distinct, often, contexts = vocabulary(src, shards, max(1, math.ceil(FREQUENT * size / 6)))
    often[BOS] = train_rows
    quarter = SHARD_BYTES / 6 / 4
    shared = spark.sparkContext.broadcast(
        (often, np.array([h for h, c in often.items() if c >= quarter and h != BOS], dtype=np.uint64)))
    kind = src.schema["k"].dataType.simpleString()

    def chunks(batches):
        nth = TaskContext.get().partitionId() << 32
        for b in gathered(batches, SLICE):
            texts, held = as_text(b.column("t")), b.column("held")
            for at, n in slices(texts, SLICE):
                train = ~held.slice(at, n).to_numpy(zero_copy_only=False).astype(bool)
                sink = io.BytesIO()
                ids = pa.RecordBatch.from_arrays([b.column("k").slice(at, n), held.slice(at, n)], names=["k", "held"])
                with pa.ipc.new_stream(sink, ids.schema) as w:
                    w.write_batch(ids)
                parts = [(nth, *p, None) for p in send(texts.slice(at, n), train, shards, shared.value[1])]
                size = split_words(texts.slice(at, n), lower=False)[1] + 1
                parts.append((nth, nth % shards, b"", b"", b"", b"", size.astype(np.int64).tobytes(), b"", n,
                              sink.getvalue()))
                types = [pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), types)], names=SENT_NAMES)
                nth += 1

    back = "chunk long, text binary, base binary, score binary, known binary, rows binary, size binary"
    types = [pa.int64(), *[pa.binary()] * 6]

    def solve(_, table):
        out = []
        only = table.column("rows").to_pylist()
        for i, r in enumerate(only):
            if r is not None:
                out.append((table.column("chunk")[i].as_py(), None, None, None, None, r, table.column("text")[i].as_py()))
        part = table.filter(pc.is_null(table.column("rows")))
        if part.num_rows:
            out += [(*a, None, None) for a in answer(part, total, distinct, shared.value[0])]
        del part
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)],
                                    names=[f.split()[0] for f in back.split(", ")])

    mu_bos = MIX if train_rows else 1.0

    def gather(_, table):
        rows = table.to_pylist()
        info = next(r for r in rows if r["rows"] is not None)
        ids = pa.ipc.open_stream(info["rows"]).read_all()
        size = np.frombuffer(info["size"], np.int64)
        base, score, known = np.zeros(len(size)), np.full(len(size), math.log10(mu_bos)), np.zeros(len(size), np.int64)
        for r in rows:
            if r["base"] is not None:
                part = np.frombuffer(r["base"], np.float64)
                width = {2: np.uint16, 4: np.uint32}
                if len(part):
                    at = np.frombuffer(r["text"], width[len(r["text"]) // len(part)])
                    base[at] += part
                    score[at] += np.frombuffer(r["score"], np.float32)
                    known[at] += np.frombuffer(r["known"], width[len(r["known"]) // len(part)])
        return pa.table([ids.column("k"), ids.column("held"), size, known, pa.array(np.full(len(size), total, np.int64)),
                         base, score],
                        names=["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    none = {c: F.lit(None).cast(t) for c, t in (f.split() for f in SENT.split(", "))}
    counts = contexts.select(*[c.alias(n) for n, c in (none | {"shard": F.col("shard"), "prevs": F.col("prevs"),
                                                               "at": F.col("counts")}).items()])
    out = (src.mapInArrow(chunks, SENT).unionByName(counts).groupBy("shard").applyInArrow(solve, back).groupBy("chunk")
           .applyInArrow(gather, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                 "base_score double, score double"))
    return out.withColumnRenamed("k", key)
