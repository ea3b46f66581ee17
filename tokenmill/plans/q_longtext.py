"""Registered queries: one long text (the whole ``documents`` table in doc_id
order, each document followed by a newline) handled as lines with offsets
(2.10-C): windows (W1) and the contiguous split (W2) without ever holding the
text, or a split of it, in one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.operators import longtext as LT
from tokenmill.plans.registry import register
from tokenmill.sources import read_table


def corpus_lines(spark, sf):
    d = read_table(spark, sf, "documents")
    ln = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s"))
    return ln.select("doc_id", "i", F.concat("s", F.lit("\n")).alias("text"))


_SQL_LINES = """WITH ln AS (
  SELECT doc_id, i, s || chr(10) AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
    FROM documents)),
pc AS (SELECT doc_id, i, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS k FROM (
    SELECT doc_id, i, regexp_extract_all(line, '(?s).{1,1000}') AS ps FROM ln)),
lo AS (SELECT piece, length(piece) AS len,
         CAST(coalesce(sum(length(piece)) OVER (ORDER BY doc_id, i, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
       FROM pc),
tot AS (SELECT CAST(sum(len) AS BIGINT) AS n FROM lo)"""


@register("corpus_windows", sql=_SQL_LINES + """,
cnt AS (SELECT greatest((n - 128) // 64, 0) AS c FROM tot),
ex AS (SELECT off, len, piece, unnest(generate_series(CAST(greatest(floor((off - 129) / 64) + 1, 0) AS BIGINT),
                                                     CAST(least(floor((off + len - 1) / 64), c - 1) AS BIGINT))) AS w
       FROM lo, cnt),
fr AS (SELECT w, off, substring(piece, greatest(w * 64 - off, 0) + 1,
                                least(w * 64 + 129 - off, len) - greatest(w * 64 - off, 0)) AS frag FROM ex)
SELECT CAST(w AS BIGINT) AS window_id, CAST(w * 64 AS BIGINT) AS start, substring(s, 1, 128) AS x, substring(s, 2, 128) AS y
FROM (SELECT w, string_agg(frag, '' ORDER BY off) AS s FROM fr GROUP BY w)""")
def q_corpus_windows(spark, sf):
    pieces = LT.pieces_with_offsets(corpus_lines(spark, sf), ["doc_id", "i"])
    return LT.corpus_windows(pieces, 128, 64)


@register("corpus_split", sql=_SQL_LINES + """,
ab AS (SELECT CAST(floor(0.8::DOUBLE * n) AS BIGINT) AS a, CAST(floor(0.9::DOUBLE * n) AS BIGINT) AS b, n FROM tot),
rg AS (SELECT 'train' AS split, 0 AS lo_, a AS hi_ FROM ab UNION ALL SELECT 'val', a, b FROM ab UNION ALL SELECT 'test', b, n FROM ab)
SELECT split, CAST(greatest(off, lo_) - lo_ AS BIGINT) AS split_off,
       substring(piece, greatest(lo_ - off, 0) + 1, least(hi_ - off, len) - greatest(lo_ - off, 0)) AS piece
FROM lo, rg WHERE off < hi_ AND off + len > lo_""")
def q_corpus_split(spark, sf):
    pieces = LT.pieces_with_offsets(corpus_lines(spark, sf), ["doc_id", "i"])
    s = LT.corpus_split(pieces)
    return s.select("split", "split_off", "piece")
