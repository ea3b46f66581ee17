"""Registered queries: BLEU pieces (L10-L13) and the sample preview."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.functions import WS_CLASS, round6
from tokenmill.operators import bleu as BL
from tokenmill.plans import fixtures as FX
from tokenmill.plans.registry import register, with_ctes


def sql_zh_tokens(x: str) -> str:
    """DuckDB form of zh_tokenize built from the same fixed rules."""
    ws = WS_CLASS
    s = f"regexp_replace(coalesce({x}, ''), '^{ws}+|{ws}+$', '', 'g')"
    s = f"regexp_replace({s}, '({BL.CJK_CLASS})', ' \\1 ', 'g')"
    for pat, rep in BL.TOKEN_RULES:
        s = f"regexp_replace({s}, '{pat}', '{rep}', 'g')"
    s = f"regexp_replace({s}, '^{ws}+|{ws}+$', '', 'g')"
    return f"(SELECT CASE WHEN z = '' THEN []::VARCHAR[] ELSE string_split_regex(z, '{ws}+') END FROM (SELECT {s} AS z))"


SQL_NGRAMS = FX.SQL_HYP_REF + f""",
tk AS (SELECT pair_id, 1 AS h, {sql_zh_tokens('hyp')} AS t FROM hyp_ref
       UNION ALL SELECT pair_id, 0 AS h, {sql_zh_tokens('ref')} AS t FROM hyp_ref),
ng AS (SELECT pair_id, h, n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS ngram
       FROM (SELECT pair_id, h, t, n, unnest(generate_series(1, len(t) - n + 1)) AS i
             FROM tk, range(1, 5) r(n) WHERE len(t) >= n)),
cnt AS (SELECT pair_id, n, ngram, CAST(sum(h) AS BIGINT) AS hyp_count, CAST(sum(1 - h) AS BIGINT) AS ref_count
        FROM ng GROUP BY ALL)"""

_stats = []
for _n in range(1, 5):
    _stats.append(f"CAST(coalesce(sum(CASE WHEN n = {_n} THEN least(hyp_count, ref_count) END), 0) AS BIGINT) AS correct_{_n}")
    _stats.append(f"CAST(coalesce(sum(CASE WHEN n = {_n} THEN hyp_count END), 0) AS BIGINT) AS total_{_n}")
_stats.append("CAST(coalesce(sum(CASE WHEN n = 1 THEN hyp_count END), 0) AS BIGINT) AS sys_len")
_stats.append("CAST(coalesce(sum(CASE WHEN n = 1 THEN ref_count END), 0) AS BIGINT) AS ref_len")
SQL_STATS = SQL_NGRAMS + ",\nst AS (SELECT " + ",\n  ".join(_stats) + " FROM cnt)"


def _sql_score() -> tuple[str, str]:
    bp = ("CASE WHEN sys_len < ref_len THEN CASE WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) ELSE 0.0 END "
          "ELSE 1.0 END")
    logs, zeros = [], []
    for n in range(1, 5):
        zeros.append(f"(CASE WHEN correct_{n} = 0 AND total_{n} > 0 THEN 1 ELSE 0 END)")
        z = " + ".join(zeros)
        p = (f"(CASE WHEN total_{n} = 0 THEN 0.0 WHEN correct_{n} = 0 THEN 100.0 / (power(2.0, {z}) * total_{n}) "
             f"ELSE 100.0 * correct_{n} / total_{n} END)")
        logs.append(f"(CASE WHEN {p} > 0 THEN ln({p}) ELSE -9999999999.0 END)")
    any_match = " + ".join(f"correct_{n}" for n in range(1, 5)) + " > 0"
    score = f"CASE WHEN {any_match} THEN ({bp}) * exp(({' + '.join(logs)}) / 4.0) ELSE 0.0 END"
    return score, bp


@register("zh_tokenize", sql=with_ctes(FX.SQL_HYP_REF) + f"""
SELECT pair_id, array_to_string({sql_zh_tokens('hyp')}, ' ') AS hyp_tokens,
       array_to_string({sql_zh_tokens('ref')}, ' ') AS ref_tokens FROM hyp_ref""")
def q_zh_tokenize(spark, sf):
    h = FX.hyp_ref(spark, sf)
    return h.select("pair_id", F.array_join(BL.zh_tokenize("hyp"), " ").alias("hyp_tokens"),
                    F.array_join(BL.zh_tokenize("ref"), " ").alias("ref_tokens"))


@register("ngram_counts", sql=with_ctes(SQL_NGRAMS) + "SELECT pair_id, CAST(n AS BIGINT) AS n, ngram, hyp_count, ref_count FROM cnt")
def q_ngram_counts(spark, sf):
    c = BL.ngram_counts(FX.hyp_ref(spark, sf))
    return c.select("pair_id", F.col("n").cast("bigint").alias("n"), "ngram", "hyp_count", "ref_count")


@register("clipped_matches", sql=with_ctes(SQL_NGRAMS) + """
SELECT pair_id, CAST(n AS BIGINT) AS n, CAST(sum(least(hyp_count, ref_count)) AS BIGINT) AS correct,
       CAST(sum(hyp_count) AS BIGINT) AS total FROM cnt GROUP BY pair_id, n""")
def q_clipped_matches(spark, sf):
    c = BL.clipped_rows(FX.hyp_ref(spark, sf))
    return c.select("pair_id", F.col("n").cast("bigint").alias("n"), "correct", "total")


_SCORE, _BP = _sql_score()
_STAT_COLS = ", ".join([f"correct_{n}, total_{n}" for n in range(1, 5)]) + ", sys_len, ref_len"


@register("corpus_bleu", sql=with_ctes(SQL_STATS) + f"""
SELECT {_STAT_COLS}, round({_SCORE}, 6) AS bleu, round({_BP}, 6) AS bp,
       'nrefs:1|case:mixed|eff:no|tok:zh|smooth:exp' AS signature FROM st""")
def q_corpus_bleu(spark, sf):
    b = BL.corpus_bleu(FX.hyp_ref(spark, sf))
    return b.select(*[c for c in b.columns if c not in ("bleu", "bp")], round6("bleu").alias("bleu"),
                    round6("bp").alias("bp"))


@register("sample_preview", sql=with_ctes(FX.SQL_PAIRS, FX.SQL_HYP_REF) + """
SELECT h.pair_id, p.src, h.ref, h.hyp, CAST(least(length(h.hyp), 126) AS BIGINT) AS hyp_len
FROM hyp_ref h JOIN pairs p USING (pair_id) ORDER BY h.pair_id LIMIT 5""")
def q_sample_preview(spark, sf):
    """First 5 examples with source, reference, hypothesis and the
    hypothesis id length (characters, wrapped at 128 and cleaned)."""
    h = FX.hyp_ref(spark, sf).join(FX.pairs(spark, sf).select("pair_id", "src"), "pair_id")
    out = h.select("pair_id", "src", "ref", "hyp", F.least(F.length("hyp"), F.lit(126)).cast("bigint").alias("hyp_len"))
    return BL.sample_preview(out, "pair_id", 5)
