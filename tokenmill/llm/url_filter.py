"""URL filter: host and path rules, then a blocked Bloom filter in front of an
exact join with listed URLs.

Rules come first (the longest that fits wins). Every other url is made canonical
and looked up in the list: the list's blocked Bloom filter (512-bit blocks, one
row per block, 7 probes in one block) passes the possible hits, and an equi-join
with the list removes the false positives. The filter is built by a map-side
bit_or per block. It is broadcast while its size (known from the list's count)
is at most ``broadcast_bytes`` and joined by block otherwise; urls that the
filter rejects never reach the exact join under a common key (each gets a key of
its own), so they cannot pile up in one task.

Canonical form: no scheme, host lower-cased (A-Z) without ``www.`` and default
port, path without trailing slashes, query without tracking parameters and
sorted, no fragment.

Cases: a null url or one without ``://`` has empty host and path, fits no rule
and is not listed: allow. Repeated pages give one row each, repeated or null
list entries count once or not. Empty tables and empty lists are fine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import ascii_lower
from tokenmill.session import cut_lineage

BITS_PER_URL = 16
PROBES = 7
BROADCAST_BYTES = 64 << 20
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def _part(url: Column, n: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", n), F.lit(""))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower."""
    return ascii_lower(_part(url, 1))


def path(url: Column) -> Column:
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """Canonical form of a url (null if it has no ``://``)."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    p = F.regexp_replace(path(url), r"/+$", "")
    q = F.regexp_replace(_part(url, 3), r"^\?", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(q, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(url.contains("://"), F.concat(h, p, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_for(h: Column, p: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest of ``rules`` [(host, path, verdict)]
    that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rh, rp, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, verdict = F.when(fits, rh + rp).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _mask(url: Column) -> list[Column]:
    """The eight 64-bit words of a url's probes in its block."""
    h = F.xxhash64(url, F.lit("probe"))
    at = [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(PROBES)]
    one = F.lit(1).cast("long")
    return [reduce(lambda a, b: a.bitwiseOR(b),
                   [F.when(F.shiftright(a, 6) == w, F.call_function("shiftleft", one, a.bitwiseAND(F.lit(63))))
                    .otherwise(F.lit(0).cast("long")) for a in at]) for w in range(8)]


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the distinct canonical urls in column ``url``."""
    words = [m.alias(f"w{i}") for i, m in enumerate(_mask(F.col(url)))]
    rows = listed.select(F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), *words)
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def judge(pages: DataFrame, listed: DataFrame, rules, key: str = "page_id", url: str = "url", listed_url: str = "url",
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: key, host, path, rule, verdict (allow or block)."""
    known = listed.select(canonical(F.col(listed_url)).alias("c")).where(F.col("c").isNotNull()).distinct()
    known = cut_lineage(known)
    n = known.count()
    blocks = max(1, -(-n * BITS_PER_URL // 512))
    sieve = bloom(known, "c", blocks)
    if blocks * 72 <= broadcast_bytes:
        sieve = F.broadcast(sieve)
    h, p = host(F.col(url)), path(F.col(url))
    rows = pages.select(F.col(key).alias("k"), h.alias("host"), p.alias("path"), canonical(F.col(url)).alias("c"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("k", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "c")
    open_ = F.when(F.col("verdict").isNull() & F.col("c").isNotNull(), F.col("c"))
    rows = rows.withColumn("c", open_).withColumn("own", F.monotonically_increasing_id())
    # rows that need no lookup get a block of their own below zero
    rows = rows.withColumn("block", F.when(F.col("c").isNotNull(), F.pmod(F.xxhash64("c"), F.lit(blocks)))
                           .otherwise(-1 - F.col("own")))
    rows = rows.join(sieve, "block", "left")
    passed = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_mask(F.col("c")))])
    maybe = F.when(F.col("c").isNotNull() & F.coalesce(passed, F.lit(False)), F.col("c")) \
        .otherwise(F.concat(F.lit("\0"), F.col("own").cast("string")))
    hit = known.select(F.col("c").alias("listed"))
    out = rows.select("k", "host", "path", "rule", "verdict", maybe.alias("maybe")) \
        .join(hit, F.col("maybe") == F.col("listed"), "left")
    final = F.coalesce("verdict", F.when(F.col("listed").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("k").alias(key), "host", "path", "rule", final.alias("verdict"))
