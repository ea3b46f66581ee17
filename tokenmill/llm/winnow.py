"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are lower-cased (A-Z) runs of digits, a-z and non-ASCII characters. Every
``k``-word gram is hashed; of every ``span - k + 1`` consecutive grams the
smallest hash (leftmost on ties) is kept, so a text and an item that share
``span`` consecutive words keep the same gram there: no shared span of that
length can be missed. Kept grams are joined with those of the benchmark, and
each meeting is extended word by word to the whole run it lies in; a run of
``span`` words marks its words as hit. An item of fewer words is one window of
its own length; its whole hash is looked up at every position, for the lengths
that occur in the benchmark only.

Arrays stay in the row that holds the text, so only kept grams are exploded and
only the runs found are shuffled. The benchmark's grams are broadcast while they
take less than ``broadcast_bytes`` (measured); beyond that the grams are joined
by a shuffle without the words, and the words of matched rows are fetched
afterwards.

Cases: null and wordless texts have no words and no hits; null or wordless items
are ignored, an item_id that repeats counts once; rows that repeat (same key and
text) get the same result each; a null key is a key of its own. Empty tables on
either side give zero hits. Columns beside key and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import ascii_lower
from tokenmill.session import cut_lineage

K = 5
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
POS_MASK = (1 << 31) - 1
HASH_MASK = ~POS_MASK
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Array of the words of a text (empty for null)."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _shift(a: Column, by: int, n: Column) -> Column:
    """a[by : by + n] as an array."""
    return F.slice(a, by + 1, F.greatest(n, F.lit(0)))


def _pair(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _low(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def _doubling(df: DataFrame, src: str, size: int, join, made: str) -> DataFrame:
    """Adds ``made``: for every i the combination of src[i .. i + size - 1],
    built from halves (log2(size) passes over the array)."""
    step, have = 1, f"{made}_1"
    df = df.withColumn(have, F.col(src))
    parts = [(1, have)]
    while step * 2 <= size:
        n = F.size(have) - step
        new = f"{made}_{step * 2}"
        df = df.withColumn(new, join(_shift(F.col(have), 0, n), _shift(F.col(have), step, n)))
        step, have = step * 2, new
        parts.append((step, have))
    done, cur = step, have
    for width, name in reversed(parts[:-1]):
        if size - done >= width:
            new = f"{made}_{done + width}"
            n = F.least(F.size(cur), F.size(name) - done)
            df = df.withColumn(new, join(_shift(F.col(cur), 0, n), _shift(F.col(name), done, n)))
            done, cur = done + width, new
    keep = [c for c in df.columns if not c.startswith(f"{made}_")]
    return df.select(*keep, F.col(cur).alias(made))


def _grams(df: DataFrame, size: int) -> DataFrame:
    """Adds ``g``: hash and position of every ``size``-word gram in one long
    (33 bits of the hash above 31 bits of position)."""
    df = _doubling(df, "h", size, _pair, "gram")
    packed = F.transform("gram", lambda x, i: x.bitwiseAND(F.lit(HASH_MASK)).bitwiseOR(i.cast("long")))
    return df.withColumn("g", packed).drop("gram")


def _kept(df: DataFrame, size: int, window: int) -> DataFrame:
    """One row (``len``, ``hash``, ``pos``) for every kept gram beside the other
    columns of ``df``; needs ``h``, the array of word hashes."""
    df = _grams(df, size)
    if window > 1:
        df = _doubling(df, "g", window, _low, "low").withColumn("g", F.array_distinct("low")).drop("low")
    g = F.col("__g")
    # explode() would add a filter on the array's size, and the optimizer would
    # move that below all the steps that build the array and compute them twice
    return df.withColumn("__g", F.explode_outer("g")).drop("g", "h") \
        .withColumn("len", F.lit(size)).withColumn("hash", g.bitwiseAND(F.lit(HASH_MASK))) \
        .withColumn("pos", g.bitwiseAND(F.lit(POS_MASK)).cast("int")).drop("__g")


def _beside(met: DataFrame) -> DataFrame:
    """The words of the text beside the item (``part``, at most as many as the
    item has) instead of all its words, so a meeting is a small row. ``nth`` is
    a value that may not be computed again elsewhere: it keeps the optimizer
    from moving later conditions, which read ``part``, into the join."""
    at = F.col("pos") - F.col("ipos")
    part = F.slice("w", F.greatest(at, F.lit(0)) + 1, F.greatest(F.size("iw") + F.least(at, F.lit(0)), F.lit(0)))
    return met.select("k", "th", "item", "iw", "ipos", at.alias("at"), part.alias("part"),
                      F.monotonically_increasing_id().alias("nth"))


def hits(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", span: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per distinct (key, text) with a hit: k, th (hash of the text),
    n_hit, n_items, names (sorted item ids, comma-joined)."""
    k = min(K, span)
    window = span - k + 1
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    items = bench.select(F.col(item).alias("item"), words(F.col(item_text)).alias("iw")) \
        .where(F.size("iw") > 0).distinct()
    items = items.withColumn("iid", F.xxhash64("item", "iw"))
    long_items = items.where(F.size("iw") >= span).withColumn("w", F.col("iw")).withColumn("h", hashes).drop("w")
    grams = [_kept(long_items, k, window)]
    sizes = [r[0] for r in items.where(F.size("iw") < span).select(F.size("iw")).distinct().collect()]  # < span
    for n in sorted(sizes):
        own = items.where(F.size("iw") == n).withColumn("w", F.col("iw")).withColumn("h", hashes).drop("w")
        grams.append(_kept(own, n, 1))
    lists = grams[0]
    for g in grams[1:]:
        lists = lists.unionByName(g)
    lists = cut_lineage(lists.where(F.col("hash").isNotNull()).withColumnRenamed("pos", "ipos"))
    size = lists.agg(F.sum(F.length(F.concat_ws(" ", "iw")).cast("long") * 2 + 64)).first()[0] or 0

    mine = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), words(F.col(text)).alias("w"))
    small = size <= broadcast_bytes
    if not small:
        mine = cut_lineage(mine.withColumn("row", F.monotonically_increasing_id()))
    hashed = mine.withColumn("h", hashes)
    if not small:
        hashed = hashed.select("row", "h")
    found = None
    for n, win in [(k, window), *((n, 1) for n in sorted(sizes))]:
        kept = _kept(hashed, n, win)
        of = lists.where((F.size("iw") >= span) if win > 1 or n == span else (F.size("iw") == n)).drop("len")
        if small:
            met = kept.join(F.broadcast(of), "hash")
        else:
            met = kept.join(of.select("hash", "iid", "ipos"), "hash").select("row", "pos", "iid", "ipos").distinct()
            met = met.join(mine, "row").join(items, "iid")
        met = _beside(met)
        found = met if found is None else found.unionByName(met)

    # the run of equal words through the meeting, along its diagonal
    off = F.least("at", F.lit(0))
    same = F.transform("iw", lambda x, i: F.coalesce(F.get("part", i + off) == x, F.lit(False)))
    run = found.select("k", "th", "item", "at", "ipos", F.size("iw").alias("n"), same.alias("same"), "nth")
    gap_l = F.array_position(F.reverse(F.slice("same", F.lit(1), F.col("ipos"))), F.lit(False)).cast("int")
    gap_r = F.array_position(F.slice("same", F.col("ipos") + 1, F.col("n") - F.col("ipos")), F.lit(False)).cast("int")
    run = run.select("k", "th", "item", "n", "nth", (F.col("at") + F.col("ipos")).alias("mid"),
                     F.when(gap_l == 0, F.col("ipos")).otherwise(gap_l - 1).alias("l"),
                     F.when(gap_r == 0, F.col("n") - F.col("ipos")).otherwise(gap_r - 1).alias("r"))
    run = run.where((F.col("l") + F.col("r") >= F.least(F.col("n"), F.lit(span))) & (F.col("nth") >= 0)) \
        .select("k", "th", "item", F.struct((F.col("mid") - F.col("l")).alias("a"),
                                            (F.col("mid") + F.col("r")).alias("b")).alias("s"))
    hit = run.groupBy("k", "th").agg(F.array_sort(F.collect_set("s")).alias("s"), F.collect_set("item").alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("s", zero, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], x["b"]).alias("end")))["n"]
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hit.select("k", "th", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.concat_ws(",", names).alias("names"))


def decontaminate(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", **args) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, n_items, items_sha256,
    contaminated. ``args`` as in ``hits``."""
    hit = hits(docs, bench, key, text, **args)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("key_text"),
                       F.size(words(F.col(text))).cast("long").alias("n_words"))
    out = rows.join(hit, rows["key"].eqNullSafe(hit["k"]) & (rows["key_text"] == hit["th"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"),
                      F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                      F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", **args) -> DataFrame:
    """The rows, unchanged, that share no window with the benchmark."""
    hit = hits(docs, bench, key, text, **args).select(F.col("k").alias("__k"), F.col("th").alias("__th"))
    return docs.join(hit, docs[key].eqNullSafe(hit["__k"]) & (F.xxhash64(docs[text]) == hit["__th"]), "left_anti")
