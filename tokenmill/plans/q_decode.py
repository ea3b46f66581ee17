"""Registered queries: decoding over the character bigram score table (D3-D8,
U1). Keys are whole documents, each continued from its last character."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.functions import round6
from tokenmill.operators import decode as D
from tokenmill.plans import fixtures as FX
from tokenmill.plans.registry import register, with_ctes
from tokenmill.sources import read_table


def doc_starts(spark, sf):
    d = read_table(spark, sf, "documents").where(F.length("text") > 0)
    last = F.substring(F.translate("text", "\n", " "), -1, 1)
    return d.select(F.col("doc_id").alias("key"), "lang", F.array(last).alias("seq"))


_SQL_STARTS = "starts AS (SELECT doc_id AS key, lang, right(replace(text, chr(10), ' '), 1) AS first FROM documents WHERE length(text) > 0)"
_SQL_BEST = "best AS MATERIALIZED (SELECT lang, prev, first(nxt ORDER BY logp DESC, nxt) AS nxt, first(logp ORDER BY logp DESC, nxt) AS logp FROM next_scores GROUP BY lang, prev)"


def _text(seq):
    body = F.slice(seq, F.lit(2), F.greatest(F.size(seq) - 1, F.lit(0)))
    return F.array_join(F.filter(body, lambda t: t != "</s>"), "")


GREEDY_LEN = 128
# decoding depends on the start state only: the recursion runs over the distinct
# states (sequences as chr(1)-joined strings) and is joined to the keys
_SQL_STATES = "states AS (SELECT DISTINCT lang, first FROM starts)"
_SHOWN = "replace(replace(substr(seq, length(first) + 1), chr(1) || '</s>', ''), chr(1), '')"


def _sql_greedy(max_len: int) -> str:
    return "WITH RECURSIVE " + with_ctes(FX.SQL_NEXT_SCORES, _SQL_STARTS, _SQL_BEST, _SQL_STATES)[5:] + f""",
g AS (
  SELECT lang, first, 0 AS step, first AS prev, first AS seq, 1 AS n, 0.0::DOUBLE AS score, false AS ended FROM states
  UNION ALL
  SELECT g.lang, g.first, g.step + 1, b.nxt, g.seq || chr(1) || b.nxt, g.n + 1, g.score + b.logp, b.nxt = '</s>'
  FROM g JOIN best b ON b.lang = g.lang AND b.prev = g.prev
  WHERE NOT g.ended AND g.step < {max_len})""".replace("\n,\ng AS", ",\ng AS")


@register("greedy_decode", sql=_sql_greedy(GREEDY_LEN) + f""",
e AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY lang, first ORDER BY step DESC) = 1)
SELECT key, {_SHOWN} AS text, CAST(n AS BIGINT) AS n_tokens, CAST(ended OR n <= {GREEDY_LEN} AS INT) AS ended,
       round(score, 6) AS score
FROM starts JOIN e USING (lang, first)""")
def q_greedy_decode(spark, sf):
    g = D.greedy_decode(doc_starts(spark, sf), FX.next_scores(spark, sf), GREEDY_LEN)
    return g.select("key", _text(F.col("seq")).alias("text"), F.size("seq").cast("bigint").alias("n_tokens"),
                    F.col("ended").cast("int").alias("ended"), round6("score").alias("score"))


@register("length_norm_rerank", sql=_sql_greedy(GREEDY_LEN) + """,
e AS (SELECT lang, first, n, round(score / power((5.0 + n) / 6.0, 0.6), 6) AS norm FROM g
      QUALIFY row_number() OVER (PARTITION BY lang, first ORDER BY round(score / power((5.0 + n) / 6.0, 0.6), 9) DESC, seq) = 1)
SELECT key, CAST(n AS BIGINT) AS n_tokens, norm FROM starts JOIN e USING (lang, first)""")
def q_length_norm_rerank(spark, sf):
    """D5 over every prefix of each greedy continuation (one candidate per step)."""
    starts = doc_starts(spark, sf)
    # a continuation is a function of its start state: rerank the states' candidates
    states = starts.select("lang", "seq").distinct().withColumn("key", F.struct("lang", "seq"))
    g = D.greedy_decode(states, FX.next_scores(spark, sf), GREEDY_LEN, dedupe=False)
    c = g.select("key", "seq", "logps", F.explode(F.sequence(F.lit(0), F.size("logps"))).alias("i"))
    c = c.select("key", F.slice("seq", F.lit(1), F.col("i") + 1).alias("seq"),
                 F.aggregate(F.slice("logps", F.lit(1), F.col("i")), F.lit(0.0), lambda a, x: a + x).alias("score"))
    r = D.rerank(c, "key", 0.6).select(F.col("key.lang").alias("lang"), F.col("key.seq").alias("start"), "seq", "norm")
    j = starts.select("key", F.col("lang").alias("l"), F.col("seq").alias("s")).join(
        r, F.col("l").eqNullSafe(F.col("lang")) & (F.col("s") == F.col("start")))
    return j.select("key", F.size("seq").cast("bigint").alias("n_tokens"), round6("norm").alias("norm"))


BEAM, BEAM_LEN = 4, 128
_SQL_TOP = "top AS MATERIALIZED (SELECT lang, prev, nxt, logp FROM next_scores QUALIFY row_number() OVER (PARTITION BY lang, prev ORDER BY logp DESC, nxt) <= 4)"
_NORM = "round(score / power((5.0 + n) / 6.0, 0.6), 9)"


@register("beam_decode", sql="WITH RECURSIVE " + with_ctes(FX.SQL_NEXT_SCORES, _SQL_STARTS, _SQL_TOP, _SQL_STATES)[5:] + f""",
b AS (
  SELECT lang, first, 0 AS step, first AS prev, first AS seq, 1 AS n, 0.0::DOUBLE AS score, false AS ended FROM states
  UNION ALL
  SELECT lang, first, step, prev, seq, n, score, ended FROM (
    SELECT lang, first, step, prev, seq, n, score, ended,
           row_number() OVER (PARTITION BY lang, first ORDER BY {_NORM} DESC, seq) AS rk
    FROM (SELECT b.lang, b.first, b.step + 1 AS step, coalesce(t.nxt, b.prev) AS prev,
                 CASE WHEN t.nxt IS NULL THEN b.seq ELSE b.seq || chr(1) || t.nxt END AS seq,
                 CASE WHEN t.nxt IS NULL THEN b.n ELSE b.n + 1 END AS n, b.score + coalesce(t.logp, 0.0) AS score,
                 t.nxt IS NULL OR t.nxt = '</s>' AS ended
          FROM b LEFT JOIN top t ON NOT b.ended AND t.lang = b.lang AND t.prev = b.prev
          WHERE b.step < {BEAM_LEN}))
  WHERE rk <= 4),
e AS (SELECT * FROM b WHERE step = {BEAM_LEN}
      QUALIFY row_number() OVER (PARTITION BY lang, first ORDER BY {_NORM} DESC, seq) = 1)
SELECT key, {_SHOWN} AS text, CAST(n AS BIGINT) AS n_tokens, round(score, 6) AS score, round({_NORM}, 6) AS norm
FROM starts JOIN e USING (lang, first)""".replace("\n,\nb AS", ",\nb AS"))
def q_beam_decode(spark, sf):
    b = D.beam_decode(doc_starts(spark, sf), FX.next_scores(spark, sf), BEAM, BEAM_LEN, 0.6)
    return b.select("key", _text(F.col("seq")).alias("text"), F.size("seq").cast("bigint").alias("n_tokens"),
                    round6("score").alias("score"), round6("norm").alias("norm"))


GEN_STEPS = 500
WINDOW = 64
_SQL_WEIGHTS = """w0 AS (SELECT lang, prev, nxt, logp, exp((logp - max(logp) OVER (PARTITION BY lang, prev)) / 0.8::DOUBLE) AS w,
                row_number() OVER (PARTITION BY lang, prev ORDER BY logp DESC, nxt) AS rk FROM next_scores),
weights AS MATERIALIZED (SELECT lang, prev, list(nxt ORDER BY rk) AS nxts, list(w ORDER BY rk) AS ws FROM w0 WHERE rk <= 50 GROUP BY lang, prev)"""
_U = "(('0x' || substr(md5('1337:' || CAST(s.key AS VARCHAR) || ':' || CAST(s.step + 1 AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"


@register("generate_text", sql="WITH RECURSIVE " + with_ctes(FX.SQL_NEXT_SCORES, _SQL_STARTS, _SQL_WEIGHTS)[5:] + f""",
s AS (
  SELECT key, lang, 0 AS step, first AS prev, first AS text FROM starts
  UNION ALL
  SELECT key, lang, step + 1, nxts[i], text || nxts[i] FROM (
    SELECT key, lang, step, text, nxts, least(1 + len(list_filter(range(1, len(ws) + 1), lambda n: list_sum(ws[1:n]) / list_sum(ws) <= u)), len(ws)) AS i
    FROM (SELECT key, lang, step, text, nxts, u, list_transform(nxts, lambda t, i: ws[i] * (1 + len(list_filter(after, lambda x: x = t)))) AS ws
      FROM (SELECT s.key, s.lang, s.step, s.text, c.nxts, c.ws, {_U} AS u,
              list_filter(list_transform(range(1, length(right(s.text, {WINDOW}))), lambda j: CASE WHEN substr(right(s.text, {WINDOW}), j, 1) = s.prev
                THEN substr(right(s.text, {WINDOW}), j + 1, 1) END), lambda x: x IS NOT NULL) AS after
            FROM s JOIN weights c ON c.lang = s.lang AND c.prev = s.prev WHERE s.step < {GEN_STEPS}) AS a) AS b) AS c)
SELECT key, substr(text, 2) AS text, CAST(step + 1 AS BIGINT) AS n_tokens
FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY step DESC) = 1""".replace("\n,\ns AS", ",\ns AS"))
def q_generate_text(spark, sf):
    g = D.generate(doc_starts(spark, sf), FX.next_scores(spark, sf), GEN_STEPS, seed=1337)
    return g.select("key", F.array_join(F.slice("seq", F.lit(2), F.greatest(F.size("seq") - 1, F.lit(0))), "").alias("text"),
                    F.size("seq").cast("bigint").alias("n_tokens"))


SCORED_LEN, SCORED_TOP = 64, 8


@register("scorer_decode")
def q_scorer_decode(spark, sf):
    """D4 over U1: beams ranked by a scorer that sees the whole prefix (the
    language's bigram table mixed with what the prefix itself shows). The table
    holds at most SCORED_TOP successors per language and character."""
    from tokenmill.operators import frontier as FR
    top = D.cut_lineage(D.top_next(FX.next_scores(spark, sf), SCORED_TOP).select("lang", "prev", "nxt", "logp"))
    if D._bytes(top) > D.BROADCAST_BYTES:
        raise ValueError("the scorer's table does not fit a task")
    table: dict = {}
    for r in top.orderBy(F.col("logp").desc(), "nxt").collect():
        table.setdefault((r.lang, r.prev), []).append((r.nxt, r.logp))
    shared = spark.sparkContext.broadcast(table)
    b = D._by_distinct_start(doc_starts(spark, sf), "key", ("lang",), lambda u, k: FR.scorer_decode(
        u, lambda: FR.PrefixCache(shared.value, ("lang",)), BEAM, SCORED_LEN, 0.6, "</s>", k, ("lang",)))
    return b.select("key", _text(F.col("seq")).alias("text"), F.size("seq").cast("bigint").alias("n_tokens"),
                    round6("score").alias("score"), round6("norm").alias("norm"))
