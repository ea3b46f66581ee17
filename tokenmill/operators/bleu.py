"""Corpus BLEU (L10-L13), counted inside the row.

Both sides of a pair are in one row, so their n-grams (n = 1..4) never leave it:
the two sides' n-grams are sorted together, runs of equal ones are measured, and
a run's hypothesis and reference counts give the clipped matches. The only
exchange is the final sum of eight integers and two lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import WS_CLASS
from tokenmill.functions.scores import let

# Fixed values of the public BLEU "zh" tokenizer. The Chinese-character test
# compares one character against two-character range bounds, so three of its
# bounds act as single characters: ' 0'..'⩭6' behaves as
# U+2001..U+2A6D and '⾀0'..'⾡d' as U+2F81..U+2FA1.
CJK_RANGES = [
    (0x3400, 0x4DB5), (0x4E00, 0x9FA5), (0x9FA6, 0x9FBB), (0xF900, 0xFA2D), (0xFA30, 0xFA6A),
    (0xFA70, 0xFAD9), (0x2001, 0x2A6D), (0x2F81, 0x2FA1), (0xFF00, 0xFFEF), (0x2E80, 0x2EFF),
    (0x3000, 0x303F), (0x31C0, 0x31EF), (0x2F00, 0x2FDF), (0x2FF0, 0x2FFF), (0x3100, 0x312F),
    (0x31A0, 0x31BF), (0xFE10, 0xFE1F), (0xFE30, 0xFE4F), (0x2600, 0x26FF), (0x2700, 0x27BF),
    (0x3200, 0x32FF), (0x3300, 0x33FF),
]
CJK_CLASS = "[" + "".join(f"\\x{{{a:04x}}}-\\x{{{b:04x}}}" for a, b in CJK_RANGES) + "]"

# The tokenizer's regex rules in order (pattern, replacement
# with groups written as \1, \2).
TOKEN_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]

MAX_ORDER = 4


def _java_repl(r: str) -> str:
    return r.replace("\\1", "$1").replace("\\2", "$2")


def zh_tokenize(col) -> Column:
    """Strip, space out each CJK character, apply the punctuation rules,
    split on whitespace. Case is kept."""
    from tokenmill.functions.text import strip_text
    s = F.regexp_replace(strip_text(col), f"({CJK_CLASS})", " $1 ")
    for pat, rep in TOKEN_RULES:
        s = F.regexp_replace(s, pat, _java_repl(rep))
    # splitting and dropping empty pieces also removes outer whitespace
    return F.array_remove(F.split(s, f"{WS_CLASS}+"), "")


def ngrams(tokens: Column, max_order: int = MAX_ORDER) -> Column:
    """All n-grams for n = 1..max_order as array<struct<n, ngram>>. Order n
    extends order n-1 by one token with ``zip_with`` (no per-position array
    slices); tokens hold no whitespace, so a space-joined n-gram is
    unambiguous."""
    size = F.size(tokens)
    orders = [tokens]
    for n in range(2, max_order + 1):
        k = F.greatest(size - n + 1, F.lit(0))
        prev = orders[-1]
        orders.append(F.zip_with(F.slice(prev, F.lit(1), k), F.slice(tokens, F.lit(n), k),
                                 lambda a, b: F.concat(a, F.lit(" "), b)))
    def tag(n):
        return lambda x: F.struct(F.lit(n).alias("n"), x.alias("ngram"))
    return F.concat(*[F.transform(g, tag(n)) for n, g in enumerate(orders, start=1)])


def gram_counts(hyp: Column, ref: Column, max_order: int = MAX_ORDER) -> Column:
    """The multiset of n-grams of two token arrays, as array<struct<n, ngram,
    hyp_count, ref_count>>: both sides' n-grams are sorted together and the runs
    of equal ones are measured, in one row, without an exchange."""
    def tagged(tokens, side):
        return F.transform(ngrams(tokens, max_order), lambda x: F.struct(x["n"].alias("n"), x["ngram"].alias("g"), F.lit(side).alias("h")))

    def same(x, y):
        return (x["n"] == y["n"]) & (x["g"] == y["g"])

    def starts(s):  # first place of every run of equal (n, n-gram, side); the reference's run comes first
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                        lambda i: (i == 0) | ~(same(F.get(s, i), F.get(s, i - 1)) & (F.get(s, i)["h"] == F.get(s, i - 1)["h"])))

    def runs(s, st):
        return F.transform(st, lambda p, j: F.struct(F.get(s, p)["n"].alias("n"), F.get(s, p)["g"].alias("g"), F.get(s, p)["h"].alias("h"),
                                                     (F.coalesce(F.get(st, j + 1), F.size(s)) - p).cast("bigint").alias("c")))

    def joined(r):
        zero = F.lit(0).cast("bigint")

        def pick(x, j):
            after, before = F.get(r, j + 1), F.get(r, j - 1)
            is_ref = x["h"] == 0
            hyp_count = F.when(~is_ref, x["c"]).when(F.coalesce(same(after, x), F.lit(False)), after["c"]).otherwise(zero)
            counted = ~is_ref & F.coalesce(same(before, x), F.lit(False))  # with its reference run
            return F.when(~counted, F.struct(x["n"].alias("n"), x["g"].alias("ngram"), hyp_count.alias("hyp_count"),
                                             F.when(is_ref, x["c"]).otherwise(zero).alias("ref_count")))
        return F.filter(F.transform(r, pick), lambda x: x.isNotNull())

    both = let(hyp, lambda h: let(ref, lambda r: F.sort_array(F.concat(tagged(h, 1), tagged(r, 0)))))
    return let(both, lambda s: F.when(F.size(s) > 0, let(starts(s), lambda st: let(runs(s, st), joined))))


def row_counts(df: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "pair_id", max_order: int = MAX_ORDER) -> DataFrame:
    """key and ``grams`` (``gram_counts``) of every row; one row is one pair."""
    def tokens(c):
        return zh_tokenize(F.coalesce(F.col(c), F.lit("")))
    return df.select(key, gram_counts(tokens(hyp), tokens(ref), max_order).alias("grams"))


def ngram_counts(df: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "pair_id",
                 max_order: int = MAX_ORDER) -> DataFrame:
    """Per (pair, n, ngram): hypothesis and reference occurrence counts."""
    return row_counts(df, hyp, ref, key, max_order).select(key, F.inline("grams"))


def clipped_rows(df: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "pair_id", max_order: int = MAX_ORDER) -> DataFrame:
    """L12 out of the row: (pair, n, correct, total) for every order that one of
    the sides has, without an exchange."""
    def order(g, n):
        own = F.filter(g, lambda x: x["n"] == n)
        return let(own, lambda o: F.when(F.size(o) > 0, F.struct(
            F.lit(n).alias("n"),
            F.aggregate(o, F.lit(0).cast("bigint"), lambda a, x: a + F.least(x["hyp_count"], x["ref_count"])).alias("correct"),
            F.aggregate(o, F.lit(0).cast("bigint"), lambda a, x: a + x["hyp_count"]).alias("total"))))
    rows = row_counts(df, hyp, ref, key, max_order)
    per = let(F.col("grams"), lambda g: F.filter(F.array(*[order(g, n) for n in range(1, max_order + 1)]), lambda x: x.isNotNull()))
    return rows.select(key, F.inline(per))


def clipped_matches(counts: DataFrame, key: str = "pair_id") -> DataFrame:
    """L12 over a table of counts: per (pair, n) clipped matches
    sum(min(hyp, ref)) and hyp n-grams. ``clipped_rows`` needs no exchange."""
    return counts.groupBy(key, "n").agg(
        F.sum(F.least("hyp_count", "ref_count")).cast("bigint").alias("correct"),
        F.sum("hyp_count").cast("bigint").alias("total"))


def bleu_stats(counts: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """The eight integers and two lengths that determine corpus BLEU."""
    aggs = []
    for n in range(1, max_order + 1):
        on = F.col("n") == n
        aggs.append(F.coalesce(F.sum(F.when(on, F.least("hyp_count", "ref_count"))), F.lit(0)).cast("bigint").alias(f"correct_{n}"))
        aggs.append(F.coalesce(F.sum(F.when(on, F.col("hyp_count"))), F.lit(0)).cast("bigint").alias(f"total_{n}"))
    aggs.append(F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("hyp_count"))), F.lit(0)).cast("bigint").alias("sys_len"))
    aggs.append(F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("ref_count"))), F.lit(0)).cast("bigint").alias("ref_len"))
    return counts.agg(*aggs)


def bleu_score(max_order: int = MAX_ORDER) -> tuple[Column, Column]:
    """BLEU (0-100, exp smoothing) and brevity penalty from bleu_stats columns.
    No match at all -> 0; an order with no hypothesis n-grams (and every
    higher one) -> precision 0 -> BLEU 0."""
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    bp = F.when(sys_len < ref_len, F.when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(0.0)).otherwise(1.0)
    logs = []
    zero_so_far = F.lit(0)
    for n in range(1, max_order + 1):
        c, t = F.col(f"correct_{n}"), F.col(f"total_{n}")
        zero_so_far = zero_so_far + F.when((c == 0) & (t > 0), 1).otherwise(0)
        p = F.when(t == 0, F.lit(0.0)).when(c == 0, 100.0 / (F.pow(F.lit(2.0), zero_so_far) * t)) \
            .otherwise(100.0 * c / t)
        logs.append(F.when(p > 0, F.log(p)).otherwise(F.lit(-9999999999.0)))
    mean_log = sum(logs[1:], logs[0]) / F.lit(float(max_order))
    any_match = sum([F.col(f"correct_{n}") for n in range(2, max_order + 1)], F.col("correct_1")) > 0
    return F.when(any_match, bp * F.exp(mean_log)).otherwise(0.0), bp


def corpus_bleu(df: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "pair_id") -> DataFrame:
    """Corpus BLEU-4 with its statistics and signature."""
    st = bleu_stats(ngram_counts(df, hyp, ref, key))
    score, bp = bleu_score()
    return st.select("*", score.alias("bleu"), bp.alias("bp"),
                     F.lit("nrefs:1|case:mixed|eff:no|tok:zh|smooth:exp").alias("signature"))


def sample_preview(df: DataFrame, order: str = "pair_id", n: int = 5) -> DataFrame:
    """The first ``n`` examples in order (the limit is the feature)."""
    return df.orderBy(order).limit(int(n))
