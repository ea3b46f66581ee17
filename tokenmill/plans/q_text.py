"""Registered queries: text, vocabulary, ids, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.constants import MAX_SRC_LEN, MAX_TGT_LEN
from tokenmill.functions import (
    WS_CLASS, char_decode, char_tokens, clean_ids, cut_between_markers, flatten_newlines, ids_text,
    pad_mask, strip_text, tail_window, teacher_shift, wrap_pad_fixed, wrap_truncate,
)
from tokenmill.operators import batches as B
from tokenmill.operators import bpe as BPO
from tokenmill.operators import vocab as V
from tokenmill.plans import fixtures as FX
from tokenmill.plans.registry import register, with_ctes
from tokenmill.sources import read_table
from tokenmill.sources.corpus import corpus_flatten

BATCH = 16  # training batch size of the translation config

WS = WS_CLASS


# ------------------------------------------------------------------ text (T*)
@register("flatten_newlines", sql="SELECT doc_id, replace(text, chr(10), ' ') AS text_flat FROM documents")
def q_flatten_newlines(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", flatten_newlines("text").alias("text_flat"))


@register("strip_nonempty", sql=f"""
SELECT conv_id, turn, s AS text_stripped FROM (
  SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g') AS s FROM conversations)
WHERE s <> ''""")
def q_strip_nonempty(spark, sf):
    c = read_table(spark, sf, "conversations")
    s = c.select("conv_id", "turn", strip_text("text").alias("text_stripped"))
    return s.where(F.col("text_stripped") != "")


def _marked_spark():
    return (F.when(F.col("doc_id") % 3 == 0,
                   F.concat(F.lit("HEAD *** START OF TEXT ***\n"), F.col("text"), F.lit("\n*** END OF TEXT ***\nTAIL")))
            .when(F.col("doc_id") % 3 == 1, F.concat(F.col("text"), F.lit(" *** END tail")))
            .otherwise(F.col("text")))
_MARKED_SQL = """CASE WHEN doc_id % 3 = 0 THEN 'HEAD *** START OF TEXT ***' || chr(10) || text || chr(10) || '*** END OF TEXT ***' || chr(10) || 'TAIL'
     WHEN doc_id % 3 = 1 THEN text || ' *** END tail' ELSE text END"""


@register("cut_between_markers", sql=f"""
SELECT doc_id, split_part(CASE WHEN strpos(m, '*** START') > 0 THEN split_part(m, '*** START', 2) ELSE m END,
                          '*** END', 1) AS text_cut
FROM (SELECT doc_id, {_MARKED_SQL} AS m FROM documents)""")
def q_cut_between_markers(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", cut_between_markers(_marked_spark()).alias("text_cut"))


@register("corpus_flatten", sql=with_ctes(FX.SQL_PAIRS) + """
SELECT pair_id, CAST(0 AS BIGINT) AS side, replace(src, chr(10), ' ') AS text FROM pairs
UNION ALL SELECT pair_id, CAST(1 AS BIGINT), replace(tgt, chr(10), ' ') FROM pairs""")
def q_corpus_flatten(spark, sf):
    c = corpus_flatten(FX.pairs(spark, sf))
    return c.select("pair_id", F.col("side").cast("bigint").alias("side"), flatten_newlines("text").alias("text"))


@register("char_tokens", sql="""
SELECT conv_id, turn, CAST(len(t) AS BIGINT) AS n_chars, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct
FROM (SELECT conv_id, turn, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(text, '') END AS t
      FROM conversations)""")
def q_char_tokens(spark, sf):
    c = read_table(spark, sf, "conversations")
    t = char_tokens("text")
    return c.select("conv_id", "turn", F.size(t).cast("bigint").alias("n_chars"),
                    F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


# ------------------------------------------------------------------ vocab (V*)
_SQL_DOC_CHARS = """doc_chars AS (SELECT unnest(string_split(text, '')) AS token FROM documents WHERE text <> '')"""


@register("char_vocab", sql=with_ctes(_SQL_DOC_CHARS) + """
SELECT row_number() OVER (ORDER BY token) - 1 AS id, token FROM (SELECT DISTINCT token FROM doc_chars)""")
def q_char_vocab(spark, sf):
    return V.char_vocab(read_table(spark, sf, "documents"), "text")


@register("char_coverage", sql=with_ctes(_SQL_DOC_CHARS) + """
SELECT token, n, row_number() OVER w AS rank,
       CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () < 0.9995::DOUBLE AS INT) AS kept
FROM (SELECT token, count(*) AS n FROM doc_chars GROUP BY token)
WINDOW w AS (ORDER BY n DESC, token)""")
def q_char_coverage(spark, sf):
    c = V.char_coverage(read_table(spark, sf, "documents"), "text", 0.9995)
    return c.select("token", "n", F.col("rank").cast("bigint").alias("rank"), F.col("kept").cast("int").alias("kept"))


@register("special_ids", sql=with_ctes(_SQL_DOC_CHARS) + """
SELECT * FROM (VALUES (0, '<pad>', 'special'), (1, '<s>', 'special'), (2, '</s>', 'special'), (3, '<unk>', 'special')) s(id, piece, kind)
UNION ALL
SELECT row_number() OVER (ORDER BY token) + 3 AS id, token AS piece, 'char' AS kind FROM (SELECT DISTINCT token FROM doc_chars)""")
def q_special_ids(spark, sf):
    return V.with_specials(V.char_vocab(read_table(spark, sf, "documents"), "text"))


_SQL_WORDS = f"""doc_words AS (
  SELECT unnest(string_split_regex(s, '{WS}+')) AS word FROM (
    SELECT regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS s FROM documents) WHERE s <> '')"""


@register("word_freq", sql=with_ctes(_SQL_WORDS) + "SELECT word, count(*) AS n FROM doc_words GROUP BY word")
def q_word_freq(spark, sf):
    return V.word_freq(read_table(spark, sf, "documents"), "text")


@register("bpe_pair_counts", sql=with_ctes(_SQL_WORDS) + """,
wf AS (SELECT word, count(*) AS n FROM doc_words GROUP BY word),
sy AS (SELECT n, string_split('▁' || word, '') AS s FROM wf)
SELECT s[i] AS l, s[i + 1] AS r, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT n, s, unnest(generate_series(1, len(s) - 1)) AS i FROM sy) GROUP BY 1, 2""".replace("\n,\nwf", ",\nwf"))
def q_bpe_pair_counts(spark, sf):
    return BPO.bpe_pair_counts(V.word_freq(read_table(spark, sf, "documents"), "text"))


@register("vocab_profile", sql=with_ctes(_SQL_DOC_CHARS) + """
SELECT kind, CAST(length(piece) AS BIGINT) AS piece_len, count(*) AS n_pieces FROM (
  SELECT '<pad>' AS piece, 'special' AS kind UNION ALL SELECT '<s>', 'special' UNION ALL SELECT '</s>', 'special'
  UNION ALL SELECT '<unk>', 'special' UNION ALL SELECT DISTINCT token, 'char' FROM doc_chars) GROUP BY 1, 2""")
def q_vocab_profile(spark, sf):
    v = V.with_specials(V.char_vocab(read_table(spark, sf, "documents"), "text"))
    p = V.vocab_profile(v)
    return p.select("kind", F.col("piece_len").cast("bigint").alias("piece_len"), "n_pieces")


# ------------------------------------------------------------------ ids (E*)
def pair_vocab(p):
    """Character vocabulary of the parallel corpus, ids after the 4 specials."""
    return V.char_vocab(corpus_flatten(p), "text", offset=4)


def encoded_pairs(spark, sf):
    p = FX.pairs(spark, sf)
    v = pair_vocab(p)
    look = V.char_lookup(v)
    e = p.withColumn("src_raw", look("src")).withColumn("tgt_raw", look("tgt"))
    return e.select("pair_id", "src", "tgt",
                    wrap_truncate("src_raw", MAX_SRC_LEN).alias("src_ids"),
                    wrap_truncate("tgt_raw", MAX_TGT_LEN).alias("tgt_ids"), "src_raw", "tgt_raw"), v


SQL_ENC = with_ctes(FX.SQL_PAIRS) + """,
pv AS (SELECT row_number() OVER (ORDER BY token) + 3 AS id, token FROM (
  SELECT DISTINCT unnest(string_split(t, '')) AS token FROM (SELECT src AS t FROM pairs UNION ALL SELECT tgt FROM pairs) WHERE t <> '')),
pvm AS (SELECT map_from_entries(list({'k': token, 'v': id})) AS m, map_from_entries(list({'k': id, 'v': token})) AS rm FROM pv),
raw AS (SELECT pair_id, src, tgt,
  list_transform(CASE WHEN src = '' THEN []::VARCHAR[] ELSE string_split(src, '') END, lambda c: m[c]) AS src_raw,
  list_transform(CASE WHEN tgt = '' THEN []::VARCHAR[] ELSE string_split(tgt, '') END, lambda c: m[c]) AS tgt_raw
  FROM pairs, pvm),
enc AS (SELECT *, list_concat([1], list_slice(src_raw, 1, 126), [2]) AS src_ids,
               list_concat([1], list_slice(tgt_raw, 1, 126), [2]) AS tgt_ids FROM raw),
bat AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS row_idx, (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch FROM enc)
"""


@register("char_encode", sql=SQL_ENC + "SELECT pair_id, array_to_string(src_raw, ' ') AS src_ids FROM enc")
def q_char_encode(spark, sf):
    e, _ = encoded_pairs(spark, sf)
    return e.select("pair_id", ids_text("src_raw").alias("src_ids"))


@register("wrap_truncate", sql=SQL_ENC + """
SELECT pair_id, array_to_string(src_ids, ' ') AS src_ids, CAST(len(src_ids) AS BIGINT) AS src_len,
       CAST(len(tgt_ids) AS BIGINT) AS tgt_len FROM enc""")
def q_wrap_truncate(spark, sf):
    e, _ = encoded_pairs(spark, sf)
    return e.select("pair_id", ids_text("src_ids").alias("src_ids"), F.size("src_ids").cast("bigint").alias("src_len"),
                    F.size("tgt_ids").cast("bigint").alias("tgt_len"))


@register("wrap_pad_fixed", sql=SQL_ENC + """
SELECT pair_id, array_to_string(list_resize(list_slice(list_concat([1], src_raw, [2]), 1, 128), 128, 0), ' ') AS src_fixed FROM enc""")
def q_wrap_pad_fixed(spark, sf):
    e, _ = encoded_pairs(spark, sf)
    return e.select("pair_id", ids_text(wrap_pad_fixed("src_raw", 128)).alias("src_fixed"))


@register("teacher_shift", sql=SQL_ENC + """
SELECT pair_id, array_to_string(list_slice(tgt_ids, 1, len(tgt_ids) - 1), ' ') AS tgt_in,
       array_to_string(list_slice(tgt_ids, 2, len(tgt_ids)), ' ') AS tgt_out FROM enc""")
def q_teacher_shift(spark, sf):
    e, _ = encoded_pairs(spark, sf)
    tin, tout = teacher_shift("tgt_ids")
    return e.select("pair_id", ids_text(tin).alias("tgt_in"), ids_text(tout).alias("tgt_out"))


SQL_PAD = SQL_ENC + """,
pad AS (SELECT pair_id, batch,
  list_resize(src_ids, max(len(src_ids)) OVER (PARTITION BY batch), 0) AS src_pad,
  list_resize(list_slice(tgt_ids, 1, len(tgt_ids) - 1), max(len(tgt_ids)) OVER (PARTITION BY batch) - 1, 0) AS tgt_in_pad,
  list_resize(list_slice(tgt_ids, 2, len(tgt_ids)), max(len(tgt_ids)) OVER (PARTITION BY batch) - 1, 0) AS tgt_out_pad
  FROM bat)
""".replace("\n,\npad", ",\npad")


def padded_pairs(spark, sf):
    e, v = encoded_pairs(spark, sf)
    b = B.sequential_batches(e.select("pair_id", "src_ids", "tgt_ids"), "pair_id", BATCH)
    return B.pad_batches(b, "batch", "src_ids", "tgt_ids"), v


@register("pad_batches", sql=SQL_PAD + """
SELECT pair_id, CAST(batch AS BIGINT) AS batch, array_to_string(src_pad, ' ') AS src_pad,
       array_to_string(tgt_in_pad, ' ') AS tgt_in_pad, array_to_string(tgt_out_pad, ' ') AS tgt_out_pad FROM pad""")
def q_pad_batches(spark, sf):
    p, _ = padded_pairs(spark, sf)
    return p.select("pair_id", "batch", ids_text("src_pad").alias("src_pad"),
                    ids_text("tgt_in_pad").alias("tgt_in_pad"), ids_text("tgt_out_pad").alias("tgt_out_pad"))


@register("pad_mask", sql=SQL_PAD + """
SELECT pair_id, CAST(len(list_filter(src_pad, lambda x: x = 0)) AS BIGINT) AS n_pad,
       array_to_string(list_transform(src_pad, lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END), '') AS mask FROM pad""")
def q_pad_mask(spark, sf):
    p, _ = padded_pairs(spark, sf)
    m = pad_mask("src_pad")
    return p.select("pair_id", F.size(F.filter(m, lambda x: x)).cast("bigint").alias("n_pad"),
                    F.array_join(F.transform(m, lambda x: F.when(x, "1").otherwise("0")), "").alias("mask"))


_SQL_CLEAN = """CASE WHEN list_position(tgt_out_pad, 2) IS NULL THEN tgt_out_pad
     ELSE list_slice(tgt_out_pad, 1, list_position(tgt_out_pad, 2) - 1) END"""


@register("clean_ids", sql=SQL_PAD + f"""
SELECT pair_id, array_to_string(list_filter({_SQL_CLEAN}, lambda x: x <> 0 AND x <> 1), ' ') AS ref_ids FROM pad""")
def q_clean_ids(spark, sf):
    p, _ = padded_pairs(spark, sf)
    return p.select("pair_id", ids_text(clean_ids("tgt_out_pad")).alias("ref_ids"))


@register("char_decode", sql=SQL_PAD + f"""
SELECT pair_id, array_to_string(list_transform(list_filter({_SQL_CLEAN}, lambda x: x <> 0 AND x <> 1),
                                lambda i: rm[i]), '') AS ref_text FROM pad, pvm""")
def q_char_decode(spark, sf):
    p, v = padded_pairs(spark, sf)
    pieces = V.literal_pieces(V.with_specials(v.select((F.col("id") - 4).alias("id"), "token")).select(
        "id", F.when(F.col("kind") == "special", F.lit("")).otherwise(F.col("piece")).alias("piece")))
    return p.select("pair_id", char_decode(clean_ids("tgt_out_pad"), pieces).alias("ref_text"))


# ------------------------------------------------------------------ splits, batches (W*)
@register("offset_split", sql="""
SELECT doc_id, split, substring(text, s, l) AS part FROM (
  SELECT doc_id, text, 'train' AS split, 1 AS s, CAST(floor(0.8::DOUBLE * length(text)) AS BIGINT) AS l FROM documents
  UNION ALL SELECT doc_id, text, 'val', CAST(floor(0.8::DOUBLE * length(text)) AS BIGINT) + 1,
         CAST(floor(0.9::DOUBLE * length(text)) AS BIGINT) - CAST(floor(0.8::DOUBLE * length(text)) AS BIGINT) FROM documents
  UNION ALL SELECT doc_id, text, 'test', CAST(floor(0.9::DOUBLE * length(text)) AS BIGINT) + 1,
         length(text) - CAST(floor(0.9::DOUBLE * length(text)) AS BIGINT) FROM documents)""")
def q_offset_split(spark, sf):
    return B.offset_split(read_table(spark, sf, "documents"), "text")


_SQL_SPLIT = "(('0x' || substr(md5('1337:' || CAST(pair_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"


@register("named_splits", sql=with_ctes(FX.SQL_PAIRS) + f"""
SELECT pair_id, src, tgt FROM pairs WHERE {_SQL_SPLIT} >= 0.8::DOUBLE AND {_SQL_SPLIT} < 0.9::DOUBLE""")
def q_named_splits(spark, sf):
    p = B.assign_split(FX.pairs(spark, sf), "pair_id")
    return B.pick_split(p, "val").select("pair_id", "src", "tgt")


@register("sequential_batches", sql=with_ctes(FX.SQL_PAIRS) + """
SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS row_idx, (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch
FROM pairs""")
def q_sequential_batches(spark, sf):
    return B.sequential_batches(FX.pairs(spark, sf).select("pair_id"), "pair_id", BATCH).select("pair_id", "row_idx", "batch")


@register("shuffled_batches", sql=with_ctes(FX.SQL_PAIRS) + """
SELECT pair_id, row_number() OVER w - 1 AS row_idx, (row_number() OVER w - 1) // 16 AS batch
FROM pairs WINDOW w AS (ORDER BY md5('1337:2:' || CAST(pair_id AS VARCHAR)), pair_id)""")
def q_shuffled_batches(spark, sf):
    return B.shuffled_batches(FX.pairs(spark, sf).select("pair_id"), "pair_id", BATCH, seed=1337, epoch=2).select(
        "pair_id", "row_idx", "batch")


@register("first_n", sql=with_ctes(FX.SQL_PAIRS) + "SELECT pair_id, src, tgt FROM pairs ORDER BY pair_id LIMIT 100")
def q_first_n(spark, sf):
    return B.first_n(FX.pairs(spark, sf), "pair_id", 100)


@register("batch_stats", sql=SQL_ENC + """
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_rows, CAST(max(len(src_ids)) AS BIGINT) AS max_src,
       CAST(max(len(tgt_ids)) AS BIGINT) AS max_tgt, CAST(sum(greatest(len(tgt_ids) - 1, 0)) AS BIGINT) AS target_tokens
FROM bat GROUP BY batch""")
def q_batch_stats(spark, sf):
    e, _ = encoded_pairs(spark, sf)
    b = B.sequential_batches(e.select("pair_id", "src_ids", "tgt_ids"), "pair_id", BATCH)
    return B.batch_stats(b, "batch", "src_ids", "tgt_ids")


@register("global_step", sql=SQL_ENC + """
SELECT CAST(e AS BIGINT) AS epoch, CAST(batch AS BIGINT) AS batch, CAST((e - 1) * nb + batch + 1 AS BIGINT) AS step
FROM (SELECT DISTINCT batch FROM bat), (SELECT max(batch) + 1 AS nb FROM bat), range(1, 4) r(e)""")
def q_global_step(spark, sf):
    e, _ = encoded_pairs(spark, sf)
    b = B.sequential_batches(e.select("pair_id"), "pair_id", BATCH)
    return B.global_step(b, 3).select(F.col("epoch").cast("bigint").alias("epoch"), "batch", "step")


_SQL_CONV_VOCAB = """cv AS (SELECT row_number() OVER (ORDER BY token) - 1 AS id, token FROM (
   SELECT DISTINCT unnest(string_split(text, '')) AS token FROM conversations WHERE text <> '')),
cvm AS (SELECT map_from_entries(list({'k': token, 'v': id})) AS m FROM cv)"""


@register("tail_window", sql=with_ctes(_SQL_CONV_VOCAB) + """
SELECT conv_id, turn, array_to_string(CASE WHEN len(ids) >= 64 THEN list_slice(ids, len(ids) - 63, len(ids))
        ELSE list_concat(list_resize([]::BIGINT[], 64 - len(ids), coalesce(m[' '], 0)), ids) END, ' ') AS ctx
FROM (SELECT conv_id, turn, m, list_transform(CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(text, '') END,
      lambda c: m[c]) AS ids FROM conversations, cvm)""")
def q_tail_window(spark, sf):
    c = read_table(spark, sf, "conversations")
    v = V.char_vocab(c, "text")
    space = v.where(F.col("token") == " ").select("id").first()
    pad = space[0] if space else 0
    e = V.char_encode(c, "text", v, "ids")
    return e.select("conv_id", "turn", ids_text(tail_window("ids", 64, pad)).alias("ctx"))


@register("chunk_windows", sql="""
SELECT doc_id, CAST(w AS BIGINT) AS window_id, CAST(w * 64 AS BIGINT) AS start,
       substring(text, w * 64 + 1, 128) AS x, substring(text, w * 64 + 2, 128) AS y
FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 128) // 64 - 1)) AS w
      FROM documents WHERE length(text) >= 128 + 64)""")
def q_chunk_windows(spark, sf):
    w = B.chunk_windows(read_table(spark, sf, "documents"), "text", 128, 64)
    return w.select("doc_id", F.col("window_id").cast("bigint").alias("window_id"), "start", "x", "y")


@register("capped_sample", sql="""
SELECT doc_id, CAST(w AS BIGINT) AS window_id FROM (
  SELECT doc_id, unnest(generate_series(0, (length(text) - 128) // 64 - 1)) AS w FROM documents WHERE length(text) >= 192)
ORDER BY md5('3407:' || CAST(doc_id AS VARCHAR) || ':' || CAST(w AS VARCHAR)), doc_id, w LIMIT 6400""")
def q_capped_sample(spark, sf):
    w = B.chunk_windows(read_table(spark, sf, "documents"), "text", 128, 64).select(
        "doc_id", F.col("window_id").cast("bigint").alias("window_id"))
    return B.capped_sample(w, ["doc_id", "window_id"], 200, 32, 3407)
