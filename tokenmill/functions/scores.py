"""Score-row math over ``array<float>`` logits (L1, L6, D1, D2) and the
hash-defined randomness (2.10-F). Max-shifted, pure SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round6(col) -> Column:
    return F.round(_c(col).cast("double"), 6)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and pass it to ``fn`` as a lambda
    variable. Lambdas get no common-subexpression elimination, so an outer
    expression used inside ``transform``/``aggregate`` would otherwise be
    recomputed for every element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def logsumexp(col) -> Column:
    c = _c(col)
    return let(F.array_max(c).cast("double"), lambda m: m + F.log(
        F.aggregate(c, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x.cast("double") - m))))


def token_xent(logits, target) -> Column:
    """L1: logsumexp(logits) - logits[target] (target is 0-based)."""
    lg = _c(logits)
    return logsumexp(lg) - F.element_at(lg, (_c(target) + 1).cast("int")).cast("double")


def log_softmax(col) -> Column:
    c = _c(col)
    return let(logsumexp(c), lambda lse: F.transform(c, lambda x: x.cast("double") - lse))


def softmax(col, temperature: float = 1.0) -> Column:
    """softmax(logits / temperature), max-shifted."""
    c = _c(col)
    t = float(temperature)
    return let(F.array_max(c).cast("double"), lambda m: let(
        F.transform(c, lambda x: F.exp((x.cast("double") - m) / F.lit(t))),
        lambda ex: F.aggregate(ex, F.lit(0.0).cast("double"), lambda a, x: a + x,
                               lambda tot: F.transform(ex, lambda x: x / tot))))


def argmax(col) -> Column:
    """0-based index of the max; ties -> lowest index."""
    c = _c(col)
    return (F.array_position(c, F.array_max(c)) - 1).cast("bigint")


def top_k(col, k: int) -> Column:
    """The k best (id, score) pairs, best first; ties -> lower id first."""
    c = _c(col)
    keyed = F.transform(c, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.cast("bigint").alias("id")))
    best = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(best, lambda s: F.struct(s["id"].alias("id"), (-s["neg"]).alias("score")))


def order_hash(seed, *keys) -> Column:
    """Seeded order key md5('seed:key...'): portable, oracle-checkable shuffle."""
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit(":"), _c(k).cast("string")]
    return F.md5(F.concat(*parts))


def uniform_hash(seed, *keys) -> Column:
    """Seeded uniform in [0,1) from the first 32 bits of the md5 order key."""
    h = order_hash(seed, *keys)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
