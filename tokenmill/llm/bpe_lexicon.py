"""Byte-level BPE encoding and decoding with a minimal acyclic transducer.

The frequent words of the corpus (pre-tokens, counted over all rows) are compiled
into an acyclic automaton whose equal endings are one and the same states and whose
arcs carry ids, written as early as the words read so far decide them. The
automaton is a few flat arrays: workers map them into memory and walk all
distinct words of a slice side by side, one byte per step. A word that the automaton does not
hold is merged exactly, pair of lowest rank first. The automaton only saves time:
with or without it the ids are those of the vocabulary file's merges.

A text is cut before every space that stands between two characters that are
not white space; no pre-token crosses such a place, so each distinct chunk of a
slice is split into pre-tokens once. The strings of added tokens are taken out
of the text first, as the file says.

Cases: a null or empty text has no ids and reads back as ''. Rows are
independent: repeated rows and an empty table need no rule; columns beside the
text are kept as they are unless they are named like an output. Long words cost
n log n steps for n bytes. Ids outside the vocabulary fail, byte sequences that are
no UTF-8 read as U+FFFD. Files that normalise, or whose added tokens need word
borders or swallow spaces, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from tokenmill.llm.common import (BYTE_BPE_JSON, as_text, dictionary, free_name, map_arrow, prefixed, quoted, slices, text_batches,
                                  with_fields, worker_store)
from tokenmill.session import cut_lineage

LEXICON = 1 << 16      # most words of the automaton
LEXICON_BYTES = 48     # longer words are always merged
HEAP = 40              # bytes from which a word is merged alone, with a heap
NONE = 1 << 40         # rank of a pair that does not merge
#: Public split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers of Unicode 17 and 18 (and those reserved for them), which the
#: library's tables, of Unicode 16, take for other characters (fixed values, code points).
NEWER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
_WHITE = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space at an end of the text or beside white space.
UNCLEAN = f"^ | $|{_WHITE} | {_WHITE}"
_CLEAN = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """Merges and bytes of a vocabulary file (JSON text)."""

    def __init__(self, text: str):
        d = json.loads(text)
        pre, model = d.get("pre_tokenizer") or {}, d["model"]
        odd = [t for t in d.get("added_tokens", ()) if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or model.get("type") != "BPE" or model.get("ignore_merges") or odd:
            raise ValueError("not a plain byte-level BPE vocabulary")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        char = {chr(b): b for b in shown}
        char |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", ())}
        raw = [b""] * (max([*ids.values(), *self.special.values()], default=-1) + 1)
        for piece, i in ids.items():
            raw[i] = bytes(char[c] for c in piece) if all(c in char for c in piece) else piece.encode()
        for piece, i in self.special.items():
            raw[i] = piece.encode()
        self.raw = raw
        self.byte = [0] * 256
        for c, b in char.items():
            self.byte[b] = ids[c]
        self.pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs[ids[a], ids[b]] = (rank, ids[a + b])
        key = np.array([a << 32 | b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(key)
        self.key = key[order]
        self.rank, self.new = np.array(list(self.pairs.values()), dtype=np.int64).reshape(-1, 2)[order].T

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the leftmost pair of the lowest rank is merged
        until no pair has a rank."""
        ids = [self.byte[b] for b in word]
        if len(ids) > HEAP:
            return self._merge_long(ids)
        get = self.pairs.get
        found = [get(p) for p in zip(ids, ids[1:])]
        while True:
            best = min((f for f in found if f), default=None)
            if best is None:
                return ids
            i = found.index(best)
            ids[i:i + 2] = [best[1]]
            found[i:i + 1] = []
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]))
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]))

    def _look_up(self, a: np.ndarray, b: np.ndarray):
        """(rank, merged id) of pairs; the rank is NONE where they do not merge."""
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE), self.new[at]

    def merge_equal(self, symbols: np.ndarray):
        """(ids in a row, ids per word) of words of one byte length, one word a
        row of ``symbols``: each step merges the leftmost pair of lowest rank of every
        word that has one."""
        n, length = symbols.shape
        ids, row = np.array(self.byte, dtype=np.int64)[symbols], np.arange(n)
        done = np.full((n, length), -1, dtype=np.int64)
        if length < 2 or not len(self.key):
            return ids.ravel(), np.full(n, length)
        rank, new = self._look_up(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(axis=1)
            each = np.arange(len(row))
            more = rank[each, at] != NONE
            if not more.all():
                stop = ~more
                done[row[stop], :ids.shape[1]] = ids[stop]
                ids, rank, new, row, at = ids[more], rank[more], new[more], row[more], at[more]
                if not len(row):
                    break
                each = np.arange(len(row))
            merged = new[each, at]
            width = ids.shape[1] - 1
            col = np.arange(width)
            ids = np.take_along_axis(ids, col + (col > at[:, None]), axis=1)
            ids[each, at] = merged
            if width == 1:
                done[row, :1] = ids
                break
            col = col[:-1]
            gone = col + (col >= at[:, None])
            rank, new = np.take_along_axis(rank, gone, axis=1), np.take_along_axis(new, gone, axis=1)
            for i in (at - 1, at):  # the pairs that the merged symbol is part of
                r = np.flatnonzero((i >= 0) & (i < width - 1))
                rank[r, i[r]], new[r, i[r]] = self._look_up(ids[r, i[r]], ids[r, i[r] + 1])
        keep = done >= 0
        return done[keep], keep.sum(axis=1)

    def merge_many(self, words: pa.Array):
        """(ids of all words in a row, where a word's ids begin, how many)."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, count, flat, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if size.any() else np.zeros(0, np.uint8)
        start = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words)]
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        for idx in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            if not len(idx):
                continue
            n = int(size[idx[0]])
            if n > HEAP:
                got = [self.merge(words[int(i)].as_py()) for i in idx]
                k = np.array([len(g) for g in got], dtype=np.int64)
                ids = np.fromiter((x for g in got for x in g), dtype=np.int64, count=int(k.sum()))
            else:
                ids, k = self.merge_equal(data[start[idx][:, None] + np.arange(n)])
            begin[idx], count[idx] = total + np.cumsum(k) - k, k
            flat.append(ids)
            total += len(ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), begin, count

    def _merge_long(self, ids):
        n, get = len(ids), self.pairs.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(f[0], i, f[1], p) for i, p in enumerate(zip(ids, ids[1:])) if (f := get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (f := get((ids[a], ids[b]))):
                    heapq.heappush(heap, (f[0], a, f[1], (ids[a], ids[b])))
        return [x for x in ids if x >= 0]


def compile_lexicon(words) -> bytes:
    """The minimal transducer of ``words`` ((bytes, ids) in ascending order of
    bytes) as one block: arcs sorted by state and byte, their targets and
    outputs, final outputs of the states, outputs as slices of one id list."""
    register: dict = {}
    arcs: list = []      # of frozen states: (state, byte, target, output)
    finals: list = []    # output of a final state, None of another one

    class State:
        __slots__ = ("arcs", "final")

        def __init__(self):
            self.arcs, self.final = {}, None

    def freeze(s: State) -> int:
        key = (s.final, tuple((b, t, o) for b, (t, o) in s.arcs.items()))
        at = register.get(key)
        if at is None:
            at = register[key] = len(finals)
            finals.append(s.final)
            arcs.extend((at, *x) for x in key[1])
        return at

    def common(a, b):
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        return n

    path, last, longest = [State()], b"", 0
    for word, ids in words:
        p = common(word, last)
        for i in range(len(last), p, -1):
            path[i - 1].arcs[last[i - 1]][0] = freeze(path[i])
        del path[p + 1:]
        out = tuple(ids)
        for i in range(p):
            arc = path[i].arcs[word[i]]
            n = common(arc[1], out)
            rest, arc[1], out = arc[1][n:], out[:n], out[n:]
            if rest:  # what the words below do not share moves down
                s = path[i + 1]
                for below in s.arcs.values():
                    below[1] = rest + below[1]
                if s.final is not None:
                    s.final = rest + s.final
        for i in range(p, len(word)):
            path.append(State())
            path[i].arcs[word[i]] = [-1, out]
            out = ()
        path[-1].final = out
        last, longest = word, max(longest, len(word))
    for i in range(len(last), 0, -1):
        path[i - 1].arcs[last[i - 1]][0] = freeze(path[i])
    root = freeze(path[0])
    outputs: dict = {(): 0}
    arc_out = [outputs.setdefault(o, len(outputs)) for *_, o in arcs]
    final_out = [-1 if f is None else outputs.setdefault(f, len(outputs)) for f in finals]
    key = np.array([s << 8 | b for s, b, *_ in arcs], dtype=np.int64)
    order = np.argsort(key, kind="stable")
    target = np.array([t for _, _, t, _ in arcs], dtype=np.int64)
    size = np.array([len(o) for o in outputs], dtype=np.int64)
    parts = [key[order], target[order], np.array(arc_out, dtype=np.int64)[order], np.array(final_out, dtype=np.int64),
             np.cumsum(size) - size, size, np.array([x for o in outputs for x in o], dtype=np.int64)]
    head = np.array([root, longest, *map(len, parts)], dtype=np.int64)
    return b"".join(x.tobytes() for x in (head, *parts))


class Lexicon:
    """The arrays of a compiled lexicon, in memory or mapped from a file."""

    def __init__(self, block):
        x = np.frombuffer(block, dtype=np.int64)
        self.root, self.longest, parts, at = int(x[0]), int(x[1]), [], 9
        for n in x[2:9].tolist():
            parts.append(x[at:at + n])
            at += n
        self.key, self.target, self.out, self.final, self.begin, self.size, self.ids = parts

    @classmethod
    def mapped(cls, block: bytes):
        """Mapped from a file without a name: it is gone with the worker, and
        a new worker writes its own from the broadcast block."""
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def walk(self, words: pa.Array):
        """(which words the automaton holds, ids per word, all ids in order)."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        found = np.zeros(len(words), dtype=bool)
        rows, outs = [], []
        if len(words) and len(self.key):
            data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
            start = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words)]
            live = np.flatnonzero((size <= self.longest) & (size > 0))
            state = np.full(len(live), self.root, dtype=np.int64)
            for i in range(self.longest):
                if not len(live):
                    break
                want = state << 8 | data[start[live] + i]
                at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
                ok = self.key[at] == want
                live, at = live[ok], at[ok]
                state = self.target[at]
                rows.append(live)
                outs.append(self.out[at])
                done = size[live] == i + 1
                ends = live[done]
                final = self.final[state[done]]
                found[ends[final >= 0]] = True
                rows.append(ends[final >= 0])
                outs.append(final[final >= 0])
                live, state = live[~done], state[~done]
        if not rows:
            return found, np.zeros(len(words), np.int64), np.zeros(0, np.int64)
        row, out = np.concatenate(rows), np.concatenate(outs)
        keep = (out > 0) & found[row]
        row, out = row[keep], out[keep]
        order = np.argsort(row, kind="stable")
        row, out = row[order], out[order]
        n = self.size[out]
        counts = np.bincount(row, weights=n, minlength=len(words)).astype(np.int64)
        return found, counts, self.ids[spread(self.begin[out], n)]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes begin .. begin + size - 1 of every run, in a row."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class Splitter:
    """Texts to pre-tokens."""

    def __init__(self, special):
        import regex
        new = "".join("-".join(rf"\U{x:0>8}" for x in r.split("-")) for r in NEWER.split())
        exact = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[\p{{L}}--[{new}]][\p{{N}}--[{new}]]]") \
            .replace(r"\p{L}+|", rf"[\p{{L}}--[{new}]]+|").replace(r"\p{N}+|", rf"[\p{{N}}--[{new}]]+|")
        self.plain, self.exact = regex.compile(PATTERN), regex.compile("(?V1)" + exact)
        self.special = sorted(special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if special else None

    def _cut(self, text: str) -> list[str]:
        out = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(part)
            elif part:
                first, *rest = _CLEAN.split(part)
                out.append(first)
                out += [" " + x for x in rest]
        return out

    def chunks(self, texts: pa.Array):
        """(chunks of all texts in a row, chunks per text)."""
        slow = pc.match_substring_regex(texts, UNCLEAN)
        for s in self.special:
            slow = pc.or_(slow, pc.match_substring(texts, s))
        slow = pc.or_(slow, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        quick = pc.split_pattern(texts.filter(pa.array(~slow)), " ")
        per = pc.list_value_length(quick).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = quick.flatten().cast(pa.large_string())
        first = np.zeros(len(flat), dtype=bool)
        first[np.cumsum(per) - per] = True
        flat = pc.if_else(pa.array(first), flat, prefixed(" ", flat))
        n = np.zeros(len(texts), dtype=np.int64)
        n[~slow] = per
        if not slow.any():
            return flat, n
        cut = [self._cut(t) for t in texts.filter(pa.array(slow)).to_pylist()]
        n[slow] = [len(x) for x in cut]
        both = pa.concat_arrays([flat, pa.array([y for x in cut for y in x], pa.large_string())])
        begin = np.zeros(len(texts), dtype=np.int64)
        begin[~slow] = np.cumsum(n[~slow]) - n[~slow]
        begin[slow] = len(flat) + np.cumsum(n[slow]) - n[slow]
        return both.take(pa.array(spread(begin, n))), n

    def words(self, chunks: pa.Array):
        """(pre-tokens of the chunks in a row, how many per chunk)."""
        word = pc.match_substring_regex(chunks, r"^ ?\pL+[.,;:!?]?$").to_numpy(zero_copy_only=False)
        closed = word & pc.match_substring_regex(chunks, "[.,;:!?]$").to_numpy(zero_copy_only=False)
        special, out, rest = set(self.special), [], []
        for c in chunks.filter(pa.array(~word)).to_pylist():
            found = [c] if c in special else (self.plain if c.isascii() else self.exact).findall(c)
            out += found
            rest.append(len(found))
        n = np.ones(len(chunks), dtype=np.int64)
        n[closed], n[~word] = 2, rest
        # letters, letters in front of one mark, marks, other pre-tokens; then in the order of the chunks
        whole, cut = chunks.filter(pa.array(word & ~closed)), chunks.filter(pa.array(closed))
        every = pa.concat_arrays([whole, pc.utf8_slice_codeunits(cut, 0, -1), pc.utf8_slice_codeunits(cut, -1),
                                  pa.array(out, pa.large_string())])
        begin, place = np.cumsum(n) - n, np.empty(len(every), dtype=np.int64)
        place[begin[word & ~closed]] = np.arange(len(whole))
        place[begin[closed]] = len(whole) + np.arange(len(cut))
        place[begin[closed] + 1] = len(whole) + len(cut) + np.arange(len(cut))
        place[spread(begin[~word], n[~word])] = len(whole) + 2 * len(cut) + np.arange(len(out))
        return every.take(pa.array(place)), n

    def split(self, texts: pa.Array):
        """(distinct pre-tokens, codes of all pre-tokens in a row, pre-tokens per
        text)."""
        chunks, per_text = self.chunks(texts)
        kinds, code = dictionary(chunks)
        flat, n = self.words(kinds)
        words, which = dictionary(flat)
        begin = (np.cumsum(n) - n)[code]
        ends = np.concatenate(([0], np.cumsum(n[code])))[np.concatenate(([0], np.cumsum(per_text)))]
        return words, which[spread(begin, n[code])], np.diff(ends)


class Codec:
    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon, self.splitter = vocab, lexicon, Splitter(vocab.special)
        self.raw = pa.array(vocab.raw, pa.large_binary())
        self.special = pa.array([s.encode() for s in vocab.special], pa.large_binary())
        self.special_ids = np.array(list(vocab.special.values()), dtype=np.int64)

    def word_ids(self, words: pa.Array):
        """(all ids in a row, where a word's ids begin, how many)."""
        words = words.cast(pa.large_binary())
        if self.lexicon is None:
            found, size, flat = np.zeros(len(words), bool), np.zeros(len(words), np.int64), np.zeros(0, np.int64)
        else:
            found, size, flat = self.lexicon.walk(words)
        begin = np.cumsum(size) - size
        if not found.all():
            new, at, n = self.vocab.merge_many(pa.concat_arrays([words.filter(pa.array(~found))]))
            begin[~found], size[~found] = len(flat) + at, n
            flat = np.concatenate((flat, new))
        if len(self.special):  # an added token's string is a word of its own and has one id
            which = pc.fill_null(pc.index_in(words, value_set=self.special), -1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(which >= 0)
            begin[at], size[at] = len(flat) + np.arange(len(at)), 1
            flat = np.concatenate((flat, self.special_ids[which[at]]))
        return flat, begin, size

    def encode(self, texts: pa.Array):
        """(ids of all texts in a row as uint32, ids per text)."""
        words, code, per_text = self.splitter.split(texts)
        flat, begin, size = self.word_ids(words)
        n = size[code]
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(per_text)))]
        return flat[spread(begin[code], n)].astype("<u4"), np.diff(ends)

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        flat = self.raw.take(pa.array(ids.astype(np.int64)))
        size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(per_text)))]
        data = flat.buffers()[2].to_pybytes() if len(flat) else b""
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_words(df: DataFrame, text: str, path: str) -> DataFrame:
    """word, n of every pre-token of the texts."""
    text_batches(df.sparkSession)
    vocab = df.sparkSession.sparkContext.broadcast(list(Vocabulary(_read(path)).special))

    def run(batches):
        splitter = Splitter(vocab.value)
        for b in batches:
            texts = as_text(b.column(0))
            for at, n in slices(texts):
                words, code, _ = splitter.split(texts.slice(at, n))
                count = np.bincount(code, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(count, pa.int64())], names=["word", "n"])

    return df.select(F.col(text).alias("t")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, limit: int) -> list[bytes]:
    """The most frequent words (met twice at least), in ascending order. Counts
    are cut where at most ``limit`` words lie above, by a histogram of sixteen
    steps per doubling, so at most ``limit`` words reach the driver."""
    counts = cut_lineage(counts.where((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES))
                         .withColumn("step", F.floor(F.log2("n") * 16)))
    total, least = 0, None
    for step, words in sorted(map(tuple, counts.groupBy("step").count().collect()), reverse=True):
        total += words
        if total > limit:
            break
        least = step
    if least is None:
        return []
    return sorted(r.word.encode() for r in counts.where(F.col("step") >= least).select("word").toLocalIterator())


def build(df: DataFrame, text: str, path: str, limit: int = LEXICON) -> bytes:
    """The compiled lexicon of a corpus; its size is bounded by ``limit`` words
    of LEXICON_BYTES."""
    vocab = Vocabulary(_read(path))
    words = frequent(count_words(df, text, path), limit)
    return compile_lexicon((w, vocab.merge(w)) for w in words if w.decode() not in vocab.special)


def _shared(df: DataFrame, path: str, lexicon: bytes | None):
    text_batches(df.sparkSession)
    block = df.sparkSession.sparkContext.broadcast((_read(path), lexicon))
    name = f"bpe-{uuid.uuid4()}"

    def codec() -> Codec:
        kept = worker_store(name)
        if "codec" not in kept:
            vocab, lex = block.value
            kept["codec"] = Codec(Vocabulary(vocab), Lexicon.mapped(lex) if lex else None)
        return kept["codec"]
    return codec


def _source(df: DataFrame, keep, col):
    """The kept columns and, last, the worked one under a free name."""
    return df.select(*[F.col(quoted(c)) for c in keep], col.alias(free_name(keep, "worked")))


def encode(df: DataFrame, text: str = "text", out: str = "ids", keep=None, path: str = BYTE_BPE_JSON,
           lexicon: bytes | None = None) -> DataFrame:
    """``keep`` columns (default all but ``out``) plus ``out`` array<int>."""
    keep = [c for c in df.columns if c != out] if keep is None else list(keep)
    schema = with_fields(df, keep, {out: ArrayType(IntegerType())})
    codec = _shared(df, path, lexicon)

    def run(batches):
        for b in batches:
            texts = as_text(b.column(len(keep)))
            for at, n in slices(texts):
                ids, per = codec().encode(texts.slice(at, n))
                ends = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
                cols = [b.column(i).slice(at, n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))],
                                                 names=[*keep, out])

    return map_arrow(_source(df, keep, F.col(quoted(text))), run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", keep=None, path: str = BYTE_BPE_JSON) -> DataFrame:
    """``keep`` columns (default all but ``out``) plus the text ``out``; null ids
    read as ''."""
    keep = [c for c in df.columns if c != out] if keep is None else list(keep)
    schema = with_fields(df, keep, {out: StringType()})
    codec = _shared(df, path, None)

    def run(batches):
        for b in batches:
            col = b.column(len(keep))
            per = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = codec().decode(col.flatten().to_numpy(zero_copy_only=False), per)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(texts, pa.string())],
                                             names=[*keep, out])

    return map_arrow(_source(df, keep, F.col(quoted(ids)).cast("array<int>")), run, schema)


def round_trip(df: DataFrame, key: str, text: str, path: str, lexicon: bytes | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (the text that the ids decode to): encoded and decoded in one
    pass."""
    codec = _shared(df, path, lexicon)
    schema = with_fields(df, [key], {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()})
    names = schema.names

    def run(batches):
        for b in batches:
            texts = as_text(b.column(1))
            for at, n in slices(texts):
                ids, per = codec().encode(texts.slice(at, n))
                ends = np.cumsum(per).tolist()
                data = memoryview(ids).cast("B")
                hashes = [hashlib.sha256(data[4 * (e - k):4 * e]).hexdigest() for e, k in zip(ends, per.tolist())]
                read = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in codec().decode(ids, per)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(per, pa.int64()), pa.array(hashes, pa.string()),
                                                  pa.array(read, pa.string())], names=names)

    return map_arrow(_source(df, [key], F.col(quoted(text))), run, schema)
