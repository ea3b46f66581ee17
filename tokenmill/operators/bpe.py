"""Byte-pair vocabulary learning (V6), encoding (E1) and decoding.

Training works on the table of distinct words (cut on script change, in blocks of
packed symbol numbers that numpy searches), never on the corpus, and on a pair
table that is kept by signed changes: a round merges many pairs, touches only
the words that hold one of them, and adds what changed in them to the pair table. Only the ranked head of the pair table (at
most ``head`` rows) and at most ``working`` words that hold its pairs reach the
driver; the merges chosen there are those that merging one at a time would choose.
Both tables are persisted per round and checkpointed to the shared folder every
few rounds, so lineage stays short and a lost executor only replays a few
rounds.

Encoding ships the piece table (bounded by ``vocab_size``) to the tasks and
encodes each distinct word of a batch once, with no shuffle.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.constants import N_SPECIAL, SPECIAL_PIECES, UNK_ID, UNK_SURFACE, WORD_MARK
from tokenmill.session import cut_lineage

#: Symbol of every character outside the vocabulary: it merges with nothing, and no
#: character can be mistaken for it.
SEP = ""
#: In packed units: after every unit; a place that was merged into the one before.
END, GONE = -1, -2
_SCRIPTS = ["mark", "han", "kana", "hangul", "digit", "other"]
MARK_CLASS = 1 + _SCRIPTS.index("mark")

_HAN = r"[\x{2e80}-\x{2fff}\x{3005}-\x{3007}\x{3021}-\x{3029}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}]"
_KANA = r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}]"
_HANGUL = r"[\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{ac00}-\x{d7af}]"


# ------------------------------------------------------------------ normalisation
@F.pandas_udf(T.StringType())
def nfkc_words_text(s: pd.Series) -> pd.Series:
    """NFKC, then whitespace runs collapse to one space, outer spaces drop."""
    return s.fillna("").map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()))


def words_of(col) -> Column:
    c = nfkc_words_text(F.col(col) if isinstance(col, str) else col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def script_class(sym: Column) -> Column:
    """Script of a symbol's last character: han, kana, hangul, digit, other;
    a bare word mark is 'mark'. Merges never join different scripts."""
    last = F.substring(sym, -1, 1)
    return (F.when(sym == WORD_MARK, "mark").when(last.rlike(_HAN), "han").when(last.rlike(_KANA), "kana")
            .when(last.rlike(_HANGUL), "hangul").when(last.rlike(r"^\p{Nd}$"), "digit").otherwise("other"))


def _py_class(pat: str):
    import re
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m.group(1), 16)), pat))


_PY_CLASSES = [(name, _py_class(pat)) for name, pat in (("han", _HAN), ("kana", _KANA), ("hangul", _HANGUL))]


def py_script_class(sym: str) -> str:
    """Plain-Python twin of ``script_class`` (training tasks, tests). It keeps no
    cache: a cached function would travel to the workers by name, and they need not
    have this package."""
    if sym == WORD_MARK:
        return "mark"
    ch = sym[-1]
    if ch >= "\u1100":  # the first of the three scripts begins here
        for name, pat in _PY_CLASSES:
            if pat.match(ch):
                return name
    return "digit" if unicodedata.category(ch) == "Nd" else "other"


def mergeable(l: str, r: str) -> bool:
    """No unknown character, and one script (a bare word mark joins anything)."""
    return SEP not in (l, r) and py_script_class(l) in ("mark", py_script_class(r))


# ------------------------------------------------------------------ training
def word_table(df: DataFrame, col: str) -> DataFrame:
    """Distinct normalised words with counts (V4 after NFKC)."""
    return (df.select(F.explode(words_of(col)).alias("word")).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")))


def kept_chars(words: DataFrame, coverage: float) -> DataFrame:
    """V2 over word symbols ('▁' counted once per word occurrence)."""
    from pyspark.sql import Window
    ch = words.select("n", F.explode(F.split(F.concat(F.lit(WORD_MARK), "word"), "")).alias("token"))
    c = ch.groupBy("token").agg(F.sum("n").alias("cnt"))
    w = Window.orderBy(F.col("cnt").desc(), F.col("token"))
    before = F.coalesce(F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tot = F.sum("cnt").over(Window.partitionBy())
    ranked = c.select("token", "cnt", F.row_number().over(w).alias("crank"),
                      ((before / tot) < F.lit(float(coverage))).alias("kept"))
    return ranked.where("kept").drop("kept")


def bpe_pair_counts(words: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """V5: weighted adjacent-symbol pair counts of one round, symbols being
    the characters of '▁' + word (map-side combined)."""
    sym = F.split(F.concat(F.lit(WORD_MARK), F.col(word)), "")
    ex = words.select(F.col(n).alias("n"), F.explode(_pairs_of(sym)).alias("p"))
    return ex.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("n").cast("bigint").alias("n"))


def _pairs_of(syms: Column) -> Column:
    return F.arrays_zip(F.slice(syms, F.lit(1), F.size(syms) - 1).alias("l"),
                        F.slice(syms, F.lit(2), F.size(syms) - 1).alias("r"))


def accept_batch(head: list[tuple[str, str, int]], complete: bool, known: set[str], budget: int) -> list:
    """Choose merges from the ranked head that one-at-a-time merging would
    also pick next, in the same order.

    Merging (a, b) only changes the counts of pairs that overlap one of its
    occurrences: pairs whose left symbol is b or whose right symbol is a (pairs
    that merely share a left or a right symbol keep their counts), and every
    new pair holding ``ab`` counts at most as much as such a pair. A candidate
    is accepted when no accepted merge affects it and its count is strictly
    above every pair an accepted merge affects (whose counts can only fall),
    and, unless the head is the complete list, strictly above the last head
    count (a tied pair may lie beyond the head). Accepted merges then never
    overlap, so one left-to-right pass applies them all. The batch ends right
    after a pair (a, a) or a pair whose concatenation is already a piece."""
    acc: list[tuple[str, str, int]] = []
    lefts: set[str] = set()
    rights: set[str] = set()
    limit = None  # highest count among pairs affected by accepted merges
    last_cnt = head[-1][2] if head else 0
    new_pieces = 0
    for idx, (l, r, c) in enumerate(head):
        if acc:
            if new_pieces >= budget or l in rights or r in lefts:
                break
            if (limit is not None and c <= limit) or (not complete and c <= last_cnt):
                break
        acc.append((l, r, c))
        lefts.add(l)
        rights.add(r)
        piece = l + r
        if piece not in known:
            new_pieces += 1
        if l == r or piece in known:
            break
        # the first later head pair this merge affects has the highest such count
        for l2, r2, c2 in head[idx + 1:]:
            if l2 == r or r2 == l:
                limit = c2 if limit is None else max(limit, c2)
                break
    return acc


class Symbols:
    """Symbols by number: 0 is the unknown character, then the kept characters, then
    what merges make. ``cls`` holds each one's script (0 merges with nothing)."""

    def __init__(self, chars: list[str]):
        self.names, self.ids, self.cls = [SEP], {SEP: 0}, bytearray([0])
        for c in chars:
            self.add(c)

    def add(self, name: str) -> int:
        got = self.ids.get(name)
        if got is None:
            got = self.ids[name] = len(self.names)
            self.names.append(name)
            self.cls.append(1 + _SCRIPTS.index(py_script_class(name)))
        return got

    def key(self, l: str, r: str) -> int:
        return self.ids[l] << 32 | self.ids[r]


def merge_ahead(s: np.ndarray, n: np.ndarray, head: list, bound, table: Symbols, budget: int) -> list:
    """The next merges, exactly, out of the packed units (``_packed``) that hold a
    pair of ``head`` (every such unit must be there).

    Counts of head pairs are complete in these units, and so are those of pairs with a
    symbol that is made here. Any other pair comes after ``bound`` = (count, l, r) of the
    first pair beyond the head, and can only fall, so merging goes on as long
    as the best pair comes before the bound. A merge that makes a piece which other
    words may hold already is the last one.

    Places are linked, so a merge reads and writes only its own places and their
    neighbours."""
    s = np.concatenate(([END], s)).astype(np.int32)
    w = np.append(n, 0)[np.cumsum(s == END) - 1]
    nxt, prv = np.arange(1, len(s) + 1), np.arange(-1, len(s) - 1)
    room = len(table.names) + max(budget, 0) + 1
    cls, made = np.zeros(room, np.uint8), np.zeros(room, bool)
    cls[:len(table.cls)] = np.frombuffer(bytes(table.cls), np.uint8)
    told = np.sort(np.array([table.key(l, r) for l, r, _ in head], dtype=np.int64))
    count: dict = {}
    where: dict = {}
    changed: set = set()

    def add(at, sign):
        l, r = s[at], s[nxt[at]]
        hit = (l > 0) & (r > 0)
        at, l, r = at[hit], l[hit], r[hit]
        key = l.astype(np.int64) << 32 | r
        hit = (made[l] | made[r]) & ((cls[l] == MARK_CLASS) | (cls[l] == cls[r])) | _among(key, told)
        at, key = at[hit], key[hit]
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total, ends = np.add.reduceat(w[at], start).tolist(), [*start[1:].tolist(), len(at)]
        for k, t, i, j in zip(key[start].tolist(), total, start.tolist(), ends):
            count[k] = count.get(k, 0) + sign * t
            changed.add(k)
            if sign > 0:
                where.setdefault(k, []).append(at[i:j])

    def entry(k):
        return -count[k], table.names[k >> 32], table.names[k & 0xFFFFFFFF], k

    add(np.flatnonzero(s > 0), 1)
    heap = [entry(k) for k in count]
    heapq.heapify(heap)
    out: list = []
    left = budget
    while heap and left > 0:
        c, l, r, k = heapq.heappop(heap)
        if count[k] != -c or c == 0:
            continue
        if bound is not None and (c, l, r) >= (-bound[0], bound[1], bound[2]):
            break
        known = table.ids.get(l + r)
        out.append((l, r, -c))
        left -= known is None
        new = table.add(l + r)
        stop = known is not None and not made[new]
        made[new], cls[new] = True, table.cls[new]
        changed.clear()
        at = np.unique(np.concatenate(where.pop(k)))
        at = at[(s[at] == k >> 32) & (s[nxt[at]] == k & 0xFFFFFFFF)]
        if l == r:
            at = _every_other(at, nxt[at[:-1]] == at[1:])
        add(np.unique(np.concatenate((prv[at], at, nxt[at]))), -1)
        gone = nxt[at]
        s[at], s[gone] = new, GONE
        nxt[at] = nxt[gone]
        prv[nxt[at]] = at
        add(np.unique(np.concatenate((prv[at], at))), 1)
        for p in changed:
            if count[p] > 0:
                heapq.heappush(heap, entry(p))
        if stop:
            break
    return out


def _among(key: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(key), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)] == key


def _every_other(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of every run of overlapping places the first, the third and so on;
    ``follows`` tells of each place but the first whether it overlaps the one before."""
    i = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ~follows)), i, 0)) if len(at) else i
    return at[(i - first) % 2 == 0]


def _units(words: DataFrame) -> DataFrame:
    """unit, n: words with their mark, cut where the script changes (no merge
    crosses such a place, so the counts of mergeable pairs stay the same; a
    sentence of a script without spaces is no longer one word)."""
    runs = "|".join(f"{p}+" for p in (_HAN, _KANA, _HANGUL, r"\p{Nd}"))
    other = "[^" + "".join(p[1:-1] for p in (_HAN, _KANA, _HANGUL)) + r"\p{Nd}]+"
    cut = F.regexp_extract_all(F.concat(F.lit(WORD_MARK), F.col("word")), F.lit(f"({WORD_MARK}?(?:{runs}|{other}))"), F.lit(1))
    return words.select("n", F.explode(cut).alias("unit")).groupBy("unit").agg(F.sum("n").alias("n"))


def _pair_table(changes: DataFrame) -> DataFrame:
    return changes.groupBy("l", "r").agg(F.sum("cnt").alias("cnt"), F.sum("words").alias("words")).where("cnt > 0")


def _packed(units: list[str], ids: dict[int, int]) -> np.ndarray:
    """Symbol numbers of the units one after the other, END after each."""
    size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    kinds, of = np.unique(chars, return_inverse=True)
    out = np.full(len(chars) + len(units), END, dtype=np.int32)
    out[np.arange(len(chars)) + np.repeat(np.arange(len(units)), size)] = \
        np.array([ids.get(c, 0) for c in kinds.tolist()], dtype=np.int32)[of]
    return out


def _holders(s: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit by unit, place by place) whether the unit holds one of the pairs."""
    width = max(int(s.max(initial=0)), int(keys[-1] >> 32), int((keys & 0xFFFFFFFF).max())) + 1 if len(keys) else 1
    left, right = np.zeros(width + 1, bool), np.zeros(width + 1, bool)  # END reads the last entry
    left[keys >> 32], right[keys & 0xFFFFFFFF] = True, True
    at = np.flatnonzero(left[s[:-1]] & right[s[1:]]) if len(keys) else np.zeros(0, np.int64)
    at = at[_among(s[at].astype(np.int64) << 32 | s[at + 1], keys)]
    ends = np.flatnonzero(s == END)
    units = np.zeros(len(ends), bool)
    units[np.searchsorted(ends, at)] = True
    return units, np.repeat(units, np.diff(ends, prepend=-1))


def _merge_all(s: np.ndarray, merges: list) -> np.ndarray:
    """Packed units after the merges (l, r, made), one after the other, each left to right."""
    for l, r, new in merges:
        at = np.flatnonzero(s[:-1] == l)
        at = at[s[at + 1] == r]
        if l == r:
            at = _every_other(at, at[1:] == at[:-1] + 1)
        if len(at):
            keep = np.ones(len(s), bool)
            keep[at + 1] = False
            s = s.copy()
            s[at] = new
            s = s[keep]
    return s


def _pair_counts(s: np.ndarray, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """(key, count, units that hold it) of the mergeable pairs, as three rows."""
    at = np.flatnonzero((s[:-1] > 0) & (s[1:] > 0))
    l, r = cls[s[at]], cls[s[at + 1]]
    at = at[(l == MARK_CLASS) | (l == r)]
    key, unit = s[at].astype(np.int64) << 32 | s[at + 1], np.cumsum(s == END)[at]
    if not len(key):
        return np.zeros((3, 0), np.int64)
    order = np.argsort(key, kind="stable")  # units stay in order under each key
    key, unit = key[order], unit[order]
    other = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.flatnonzero(other)
    fresh = other | np.concatenate(([True], unit[1:] != unit[:-1]))
    return np.stack((key[start], np.add.reduceat(n[unit], start), np.add.reduceat(fresh.astype(np.int64), start)))


_BLOCK = "syms binary, n binary, change binary"
_BLOCK_UNITS = 1 << 16


def _block(s, n, change) -> pa.RecordBatch:
    cells = (s.astype(np.int32), n.astype(np.int64), change.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], names=["syms", "n", "change"])


def _rows_of(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield (np.frombuffer(b.column(0)[i].as_buffer(), np.int32), np.frombuffer(b.column(1)[i].as_buffer(), np.int64))


def _first_blocks(units: DataFrame, table: Symbols) -> DataFrame:
    """Units in blocks of packed symbols, each with the counts of all its pairs;
    characters outside the table never merge."""
    shared = units.sparkSession.sparkContext.broadcast(({ord(c): i for c, i in table.ids.items() if len(c) == 1}, bytes(table.cls)))

    def run(batches):
        ids, cls = shared.value[0], np.frombuffer(shared.value[1], np.uint8)
        texts, n = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            n += b.column(1).to_pylist()
            while len(texts) >= _BLOCK_UNITS:
                yield pack(texts[:_BLOCK_UNITS], n[:_BLOCK_UNITS], ids, cls)
                texts, n = texts[_BLOCK_UNITS:], n[_BLOCK_UNITS:]
        if texts:
            yield pack(texts, n, ids, cls)

    def pack(texts, n, ids, cls):
        s, n = _packed(texts, ids), np.array(n, dtype=np.int64)
        return _block(s, n, _pair_counts(s, n, cls))
    return units.select("unit", "n").mapInArrow(run, _BLOCK)


def _merged(blocks: DataFrame, merges: list, table: Symbols) -> DataFrame:
    """The blocks after a batch of merges [(l, r, made)], each with what the batch
    changes in its pair counts. Only units that hold a pair of the batch are touched."""
    keys = np.array(sorted({l << 32 | r for l, r, _ in merges}), dtype=np.int64)
    scripts = bytes(table.cls)

    def run(batches):
        cls = np.frombuffer(scripts, np.uint8)
        for s, n in _rows_of(batches):
            units, places = _holders(s, keys)
            old, k = s[places], n[units]
            new = _merge_all(old, merges)
            change = _pair_counts(old, k, cls)
            change[1:] *= -1
            key, of = np.unique(np.concatenate((change, after := _pair_counts(new, k, cls)), axis=1)[0], return_inverse=True)
            total = np.zeros((2, len(key)), np.int64)
            np.add.at(total, (slice(None), of), np.concatenate((change[1:], after[1:]), axis=1))
            kept = (total != 0).any(axis=0)
            yield _block(np.concatenate((s[~places], new)), np.concatenate((n[~units], k)),
                         np.stack((key[kept], total[0][kept], total[1][kept])))
    return blocks.select("syms", "n").mapInArrow(run, _BLOCK)


def _changes(blocks: DataFrame, table: Symbols) -> DataFrame:
    """The signed pair counts that the blocks carry: l, r, cnt, words."""
    shared = blocks.sparkSession.sparkContext.broadcast(list(table.names))

    def run(batches):
        names = pa.array(shared.value, pa.string())
        for b in batches:
            for x in b.column(0):
                key, cnt, words = np.frombuffer(x.as_buffer(), np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(key >> 32)), names.take(pa.array(key & 0xFFFFFFFF)),
                                                  pa.array(cnt), pa.array(words)], names=["l", "r", "cnt", "words"])
    return blocks.select("change").mapInArrow(run, "l string, r string, cnt long, words long")


def _holding(blocks: DataFrame, keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Packed units that hold one of the pairs, and their counts."""
    sought = np.array(sorted(keys), dtype=np.int64)

    def run(batches):
        for s, n in _rows_of(batches):
            units, places = _holders(s, sought)
            yield _block(s[places], n[units], np.zeros(0))
    got = blocks.select("syms", "n").mapInArrow(run, _BLOCK).toArrow()
    s, n = zip(*_rows_of(got.to_batches()))
    return np.concatenate(s), np.concatenate(n)


def bpe_train(df: DataFrame, col: str = "text", vocab_size: int = 8000, coverage: float = 0.9995,
              head: int = 2000, working: int = 1 << 17, checkpoint_every: int = 8, max_rounds: int | None = None):
    """V6: learn a BPE vocabulary. Returns (vocab, merges): vocab
    (id, piece, score, kind) laid out as 4 specials, merged pieces by rank,
    then kept characters by frequency; merges (rank, l, r, piece, cnt).

    The pair table (l, r, count, words that hold it) is kept by signed changes
    of the words that a round touches. Each round takes the best pairs whose
    words number at most ``working`` together, brings those words to the driver
    and merges ahead as far as they decide (``merge_ahead``): early, when
    one pair is in more words than that, by ``accept_batch``. Both pick what
    merging one at a time would pick."""
    spark = df.sparkSession
    words = cut_lineage(word_table(df, col))
    chars = kept_chars(words, coverage).collect()  # bounded by distinct characters
    char_list = [r["token"] for r in sorted(chars, key=lambda r: r["crank"])]
    known = set(char_list)
    budget = max(vocab_size - N_SPECIAL - len(char_list), 0)
    table = Symbols(char_list)
    blocks = cut_lineage(_first_blocks(_units(words), table))
    pairs = cut_lineage(_pair_table(_changes(blocks, table)))
    merges: list[tuple[int, str, str, str, int]] = []
    rounds, kept = 0, []
    while budget > 0 and (max_rounds is None or rounds < max_rounds):
        ranked = pairs.orderBy(F.col("cnt").desc(), "l", "r").limit(head + 1).collect()
        while len(kept) > 2:  # the last table has read the blocks of the round before, not yet its own
            for old in kept.pop(0):
                old.unpersist()
        if not ranked:
            break
        total, k = 0, 0
        while k < min(len(ranked), head) and total + ranked[k].words <= working:
            total += ranked[k].words
            k += 1
        hd = [(r.l, r.r, r.cnt) for r in ranked[:head]]
        if k >= 4 or k == len(ranked):
            bound = (ranked[k].cnt, ranked[k].l, ranked[k].r) if k < len(ranked) else None
            batch = merge_ahead(*_holding(blocks, [table.key(l, r) for l, r, _ in hd[:k]]), hd[:k], bound, table, budget)
        else:
            n = min(head, 200)
            batch = accept_batch(hd[:n], len(ranked) <= n, known, budget)
        for l, r, c in batch:
            if l + r not in known:
                known.add(l + r)
                merges.append((len(merges), l, r, l + r, c))
                budget -= 1
        rounds += 1
        nxt = _merged(blocks, [(table.ids[l], table.ids[r], table.add(l + r)) for l, r, _ in batch], table)
        last = rounds % checkpoint_every == 0
        nxt = cut_lineage(nxt) if last else nxt.persist()
        new_pairs = _pair_table(pairs.unionByName(_changes(nxt, table)))
        new_pairs = cut_lineage(new_pairs) if last else new_pairs.persist()
        kept.append([] if last else [nxt, new_pairs])
        blocks, pairs = nxt, new_pairs
    for old in (x for pair in kept for x in pair):
        old.unpersist()
    rows = [(i, p, 0, "special") for i, p in enumerate(SPECIAL_PIECES)]
    rows += [(N_SPECIAL + k, m[3], -k, "merged") for k, m in enumerate(merges)]
    base = N_SPECIAL + len(merges)
    rows += [(base + k, ch, -(len(merges) + k), "char") for k, ch in enumerate(char_list)]
    vocab = spark.createDataFrame(rows, "id bigint, piece string, score bigint, kind string")
    merges_df = spark.createDataFrame(merges, "rank bigint, l string, r string, piece string, cnt bigint")
    return vocab, merges_df


# ------------------------------------------------------------------ encoding
def encode_word(symbols: list[str], piece_ids: dict[str, int]) -> list[int]:
    """Merge the adjacent pair whose concatenation has the lowest id, until no
    pair is a piece (heap over candidate pairs, linked list of symbols)."""
    n = len(symbols)
    if n == 0:
        return []
    sym = list(symbols)
    prv = list(range(-1, n - 1))
    nxt = list(range(1, n + 1))
    nxt[-1] = -1
    alive = [True] * n
    heap = []

    def push(i):
        j = nxt[i]
        if j != -1:
            pid = piece_ids.get(sym[i] + sym[j])
            if pid is not None:
                heapq.heappush(heap, (pid, i, sym[i], sym[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        pid, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else -1
        if j == -1 or sym[i] != a or sym[j] != b:
            continue
        sym[i] = a + b
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[j] != -1:
            prv[nxt[j]] = i
        if prv[i] != -1:
            push(prv[i])
        push(i)
    out: list[int] = []
    i = 0
    while i != -1:
        pid = piece_ids.get(sym[i], UNK_ID)
        if not (pid == UNK_ID and out and out[-1] == UNK_ID):
            out.append(pid)
        i = nxt[i]
    return out


def _unit_pattern():
    """Script runs of a word, as ``_units`` cuts them."""
    import re
    han, kana, hangul = (_py_class(p).pattern for p in (_HAN, _KANA, _HANGUL))
    other = "[^" + "".join(p[1:-1] for p in (han, kana, hangul)) + r"\d]+"
    return re.compile(rf"{WORD_MARK}?(?:{han}+|{kana}+|{hangul}+|\d+|{other})")


class WordEncoder:
    """Per-task encoder with a bounded cache. Words are cut where the script
    changes, so a sentence of a script without spaces is several short units
    that repeat; only a vocabulary with a piece across scripts keeps words whole."""

    def __init__(self, piece_ids: dict[str, int], cache_size: int = 1 << 18):
        self.piece_ids = piece_ids
        self.cache: OrderedDict[str, list[int]] = OrderedDict()
        self.cache_size = cache_size
        cut = _unit_pattern().findall
        self.cut = cut if all(len(cut(p)) <= 1 for p in piece_ids) else (lambda w: [w])

    def unit(self, u: str) -> list[int]:
        got = self.cache.get(u)
        if got is None:
            got = encode_word(list(u), self.piece_ids)
            self.cache[u] = got
            if len(self.cache) > self.cache_size:
                self.cache.popitem(last=False)
        return got

    def word(self, w: str) -> list[int]:
        out: list[int] = []
        for u in self.cut(WORD_MARK + w):
            ids = self.unit(u)
            out += ids[1:] if out and ids and out[-1] == UNK_ID == ids[0] else ids
        return out

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text). Each distinct word of the
        batch is encoded once; unknowns in a row are one, across words too."""
        clean = pa.array([" ".join(unicodedata.normalize("NFKC", t).split()) if t else "" for t in texts], pa.large_string())
        parts = pc.split_pattern(clean, " ")
        flat, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(flat), 0)
        owner, words = owner[full.to_numpy(zero_copy_only=False)], flat.filter(full).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = [self.word(w) for w in words.dictionary.to_pylist()]
        size = np.array([len(x) for x in ids], dtype=np.int64)
        of = np.fromiter((y for x in ids for y in x), dtype=np.int64, count=int(size.sum()))
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        n = size[code]
        end = np.cumsum(n)
        got = of[np.repeat((np.cumsum(size) - size)[code] - (end - n), n) + np.arange(end[-1])]
        text = np.repeat(owner, n)
        keep = np.ones(len(got), dtype=bool)
        keep[1:] = ~((got[1:] == UNK_ID) & (got[:-1] == UNK_ID) & (text[1:] == text[:-1]))
        return got[keep], np.bincount(text[keep], minlength=len(texts))

    def text(self, t) -> list[int]:
        return self.texts([t])[0].tolist()


def piece_table(vocab: DataFrame, max_size: int = 1 << 20) -> dict[str, int]:
    """Collect the piece -> id table; its size is bounded by vocab_size."""
    n = vocab.count()
    if n > max_size:
        raise ValueError(f"vocabulary of {n} pieces is too large to ship to tasks")
    return {r["piece"]: int(r["id"]) for r in vocab.where(F.col("kind") != "special").select("piece", "id").collect()}


def bpe_encode(df: DataFrame, col: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """Text -> piece ids, with the piece table broadcast and no shuffle. Every
    Arrow batch becomes a dictionary of words, each encoded once (and kept by the
    task), and the texts are put together by numpy; the other columns pass by
    untouched. A null text has no ids."""
    bc = df.sparkSession.sparkContext.broadcast(piece_table(vocab))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.LongType()), False)])
    place, names = df.columns.index(col), [*df.columns, out]

    def run(batches):
        enc = WordEncoder(bc.value)
        for b in batches:
            ids, n = enc.texts(b.column(place).to_pylist())
            ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(ids))], names=names)
    return df.mapInArrow(run, schema)


def bpe_decode(ids, vocab: DataFrame) -> Column:
    """Ids -> text: pieces joined, a leading word mark dropped, other
    marks become spaces; unk prints ' ⁇ ' (its spaces kept), pad/bos/eos print
    nothing."""
    from tokenmill.operators.vocab import literal_pieces
    surf = vocab.select("id", F.when(F.col("id") == UNK_ID, F.lit(UNK_SURFACE))
                        .when(F.col("kind") == "special", F.lit("")).otherwise(F.col("piece")).alias("piece"))
    pieces = literal_pieces(surf)
    c = F.col(ids) if isinstance(ids, str) else ids
    joined = F.array_join(F.transform(c, lambda i: F.coalesce(F.try_element_at(pieces, (i + 1).cast("int")),
                                                              F.lit(UNK_SURFACE))), "")
    return F.translate(F.regexp_replace(joined, f"^{WORD_MARK}", ""), WORD_MARK, " ")


def decode_py(ids: list[int], pieces: list[str]) -> str:
    """Plain-Python E9 (tests, small fixtures)."""
    out = []
    for i in ids:
        if i == UNK_ID:
            out.append(UNK_SURFACE)
        elif i < N_SPECIAL:
            continue
        else:
            out.append(pieces[i])
    s = "".join(out)
    s = s[1:] if s.startswith(WORD_MARK) else s
    return s.replace(WORD_MARK, " ")



def roundtrip_refs(df: DataFrame, col: str, vocab: DataFrame, max_len: int = 128) -> DataFrame:
    """The reference as the reference code scores it: encode, wrap and
    truncate (dataset rule), teacher-shift, clean, decode. Long targets come
    back cut and unknown characters as ' ⁇ '."""
    from tokenmill.functions import clean_ids, teacher_shift, wrap_truncate
    e = bpe_encode(df, col, vocab, "_ids")
    _, tout = teacher_shift(wrap_truncate("_ids", max_len))
    return e.withColumn("ref", bpe_decode(clean_ids(tout), vocab)).drop("_ids")
