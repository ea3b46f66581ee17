"""Spelling variants: words one edit apart, found by dense tiles of code points.

Two words are one edit apart when their common prefix and common suffix together
reach the longer length M less one. One of the two parts therefore has half of that
length, and of the rest again one part has half: a word enters, for M = its length
and its length + 1, the four tiles of words that agree with it on such a prefix and
suffix. Inside a tile all words are compared as padded matrices of code points,
block pair by block pair: one pass over the columns from the left and one from
the right give the common parts of all pairs of a block pair at once. A pair
lies in just one tile, the one that its common prefix names, so nothing is counted
twice.

Tiles are cut by agreement, not by size: one of more than ``TILE`` words is split to
tiles that leave a single code point open, and such a tile holds no more words
than the alphabet has letters. No group grows with the corpus.

A word's form is its near word of largest count (ties: smallest in code-point
order) if that count is at least ``RATIO`` times its own, and the root follows the
forms to the last. Counts grow along forms, so they have no cycles.

Cases: null texts have no words; a null key is the empty text in the hash;
repeated rows count again; texts are read whole and the letters of a long run
are one word; no words give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import quoted, text_batches
from tokenmill.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 6, 5, 5, 199
TILE = 1024        # words of a tile; larger ones are split
SIDE = 32          # words of a block
SHARE = 1000
CHUNK_ROWS, CHUNK_CELLS = 4096, 1 << 22
HELD = 1 << 17     # words counted in a task before they are handed on
#: Latin-1 bytes: A-Z to lower case, other letters as they are, all else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def document_words(key: str, text: str, least: int = LEAST_LENGTH, slip: int = SLIP) -> Counter:
    """Counts of the words of one text. Characters above U+00FF separate words
    like any other that is no letter, so the text is read as Latin-1 bytes."""
    out: Counter = Counter()
    start = zlib.crc32(f"{key}:".encode())
    runs = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split(b" "))
    for run, n in runs.items():
        if len(run) < least:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % slip == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, slip: int = SLIP) -> DataFrame:
    """word, n over all texts."""
    text_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                               pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for k, t in zip(b.column(0), b.column(1)):
                held.update(document_words(k.as_py(), t.as_py(), least, slip))
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    src = docs.where(F.col(quoted(text)).isNotNull()).select(
        F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")).alias("k"), F.col(quoted(text)).alias("t"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tiles(words: DataFrame) -> DataFrame:
    """word, n, m (longer length of the tile's pairs), p and s (agreed prefix and
    suffix), cap (the common prefix of its pairs is shorter), tile."""
    half = "(m - 1 - (m div 2) + 1) div 2"  # half of what the first half leaves
    each = words.selectExpr("word", "n", "explode(array(char_length(word), char_length(word) + 1)) AS m") \
        .selectExpr("word", "n", "m", "m div 2 AS a", f"{half} AS b")
    each = each.selectExpr("word", "n", "m", "inline(array("
                           "struct(a + b AS p, 0 AS s, m AS cap), struct(a AS p, b AS s, a + b AS cap), "
                           "struct(b AS p, a AS s, a AS cap), struct(0 AS p, a + b AS s, b AS cap)))")
    return _named(each.select("word", "n", *[F.col(c).cast("int") for c in ("m", "p", "s", "cap")]).where("p < cap"))


def _named(t: DataFrame) -> DataFrame:
    return t.withColumn("tile", F.expr("xxhash64(m, p, s, cap, substring(word, 1, p), substring(word, char_length(word) - s + 1, s))"))


def split_large(members: DataFrame, limit: int = TILE) -> DataFrame:
    """The members of tiles over ``limit`` words go to tiles that leave one
    code point open; the others stay."""
    size = members.groupBy("tile").agg(F.count(F.lit(1)).alias("size"))
    large = cut_lineage(size.where(F.col("size") > limit))
    total = large.agg(F.sum("size")).first()[0]
    if not total:
        return members
    # tiles of more than 1/SHARE of these members (fewer than SHARE tiles) are named by broadcast
    huge = F.broadcast(large.where(F.col("size") > total // SHARE).select("tile", F.lit(1).alias("huge")))
    rest = large.where(F.col("size") <= total // SHARE).select("tile", F.lit(1).alias("large"))
    named = members.join(huge, "tile", "left")
    first = named.where("huge = 1").drop("huge")
    other = named.where("huge IS NULL").drop("huge").join(rest, "tile", "left")
    over = first.unionByName(other.where("large = 1").drop("large"))
    # of the range p .. m - 1 - s a pair takes the place of its common prefix, or the last
    fine = over.selectExpr("word", "n", "m", "cap", "m - 1 - s AS top", "explode(sequence(p, least(m - 1 - s, cap - 1))) AS p") \
        .selectExpr("word", "n", "m", "p", "m - 1 - p AS s", "IF(p = top, cap, p + 1) AS cap")
    return other.where("large IS NULL").drop("large").unionByName(_named(fine))


def _matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points plus one, 0 where a word has ended, aligned left or right."""
    pad = str.rjust if right else str.ljust
    text = "".join(pad(w, width, "\0") for w in words)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, width)
    top = int(cp.max(initial=0))
    return cp.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


def _common(a: np.ndarray, b: np.ndarray, columns) -> np.ndarray:
    """How many leading ``columns`` every row of a[i] shares with every row of
    b[i], for all block pairs i."""
    alive = np.ones((a.shape[0], a.shape[1], b.shape[1]), dtype=bool)
    size = np.zeros(alive.shape, dtype=np.int32)
    for c in columns:
        alive &= a[:, :, None, c] == b[:, None, :, c]
        if not alive.any():
            break
        size += alive
    return size


def compare(words: list[str], tile: np.ndarray, m: int, low: np.ndarray, cap: np.ndarray, side: int = SIDE):
    """Pairs (i, j), i < j, of near words among rows sorted by tile: both in one
    tile, one of them of length m, low <= common prefix < cap."""
    n = len(words)
    blocks = -(-n // side)
    pad = blocks * side - n
    left, right = (_matrix(words + [""] * pad, m, r).reshape(blocks, side, m) for r in (False, True))
    size = np.array([*map(len, words), *[0] * pad], dtype=np.int32).reshape(blocks, side)
    number = np.concatenate((np.cumsum(np.concatenate(([0], tile[1:] != tile[:-1]))), np.full(pad, -1))).reshape(blocks, side)
    low, cap = (np.concatenate((x, np.zeros(pad, x.dtype))).reshape(blocks, side) for x in (low, cap))
    last = number.max(axis=1)
    first = number[:, 0]
    # block pairs that hold rows of one tile: tiles ascend, so a block meets the blocks up to the end of its last tile
    until = np.searchsorted(first, last, side="right")
    pairs = np.array([(i, j) for i in range(blocks) for j in range(i, int(until[i]))], dtype=np.int64).reshape(-1, 2)
    got = []
    step = max(1, (1 << 19) // (side * side))
    for at in range(0, len(pairs), step):
        i, j = pairs[at:at + step].T
        same = (number[i][:, :, None] == number[j][:, None, :]) & (np.maximum(size[i][:, :, None], size[j][:, None, :]) == m)
        if not same.any():
            continue
        prefix = _common(left[i], left[j], range(m))
        # a shorter word's end is padding in both orders, so a shared part is never longer than it
        prefix = np.minimum(prefix, np.minimum(size[i][:, :, None], size[j][:, None, :]))
        suffix = _common(right[i], right[j], range(m - 1, -1, -1))
        suffix = np.minimum(suffix, np.minimum(size[i][:, :, None], size[j][:, None, :]))
        hit = same & (prefix + suffix >= m - 1) & (prefix >= low[i][:, :, None]) & (prefix < cap[i][:, :, None])
        k, a, b = np.nonzero(hit)
        a, b = i[k] * side + a, j[k] * side + b
        got.append((a[a < b], b[a < b]))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*got))


def near_words(members: DataFrame) -> DataFrame:
    """word, n_near, best (struct of minus the count and the word of the best
    near word) of every word that has a near word."""
    src = members.repartition("tile").sortWithinPartitions("m", "tile").select("word", "n", "m", "p", "cap", "tile")

    def solve(rows: pa.Table):
        tile, m = (rows.column(c).to_numpy() for c in ("tile", "m"))
        new = np.concatenate(([True], (tile[1:] != tile[:-1]) | (m[1:] != m[:-1])))
        alone = new & np.concatenate((new[1:], [True]))
        rows, tile, m = rows.filter(pa.array(~alone)), tile[~alone], m[~alone]
        for cut in np.split(np.arange(len(m)), np.flatnonzero(np.diff(m)) + 1):
            if len(cut):
                part = rows.slice(int(cut[0]), len(cut))
                words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
                i, j = compare(words, tile[cut], int(m[cut[0]]), part.column("p").to_numpy(), part.column("cap").to_numpy())
                if not len(i):
                    continue
                row, other = np.concatenate((i, j)), np.concatenate((j, i))
                place = np.empty(len(words), dtype=np.int64)
                place[pc.sort_indices(pa.array(words)).to_numpy()] = np.arange(len(words))
                order = np.lexsort((place[other], -n[other], row))
                row, other = row[order], other[order]
                first = np.concatenate(([True], row[1:] != row[:-1]))
                count = np.diff(np.concatenate((np.flatnonzero(first), [len(row)])))
                names = pa.array(words, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(row[first])), pa.array(count, pa.int64()), pa.array(-n[other[first]], pa.int64()),
                     names.take(pa.array(other[first]))], names=["word", "n_near", "less", "near"])

    def run(batches):
        held, rows = None, 0
        for b in batches:
            part = pa.Table.from_batches([b])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows > CHUNK_ROWS:
                held = held.combine_chunks()
                tile = held.column("tile").to_numpy()
                width = max(int(held.column("m")[0].as_py()), 1)
                want = min(CHUNK_ROWS, max(SIDE, CHUNK_CELLS // width))
                change = np.flatnonzero(tile[1:] != tile[:-1]) + 1
                ready = change[change <= want]
                at = int(ready[-1]) if len(ready) else int(change[0]) if len(change) else 0
                if not at:
                    break  # one tile fills all that was read
                yield from solve(held.slice(0, at))
                held = held.slice(at)
        if held is not None and held.num_rows:
            yield from solve(held.combine_chunks())

    got = src.mapInArrow(run, "word string, n_near long, less long, near string")
    return got.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form. ``forms``: word, form. Each round
    moves every word one form on; counts grow by RATIO per form, so the rounds
    are bounded by the logarithm of the largest count."""
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = cut_lineage(now.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = nxt.select("word", "root")
        if not nxt.where("moved").limit(1).count():
            return now


def variants(words: DataFrame, ratio: int = RATIO, limit: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words and
    counts (word, n)."""
    words = words.select("word", "n")
    near = near_words(split_large(tiles(words), limit))
    found = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")).select(
            "word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of at least LEAST_LENGTH
    code points that occur LEAST_COUNT times."""
    return variants(cut_lineage(word_counts(docs, key, text).where(F.col("n") >= LEAST_COUNT)))
