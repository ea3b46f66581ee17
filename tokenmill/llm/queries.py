"""The thin ``opN_`` queries over the whole tables, and their DuckDB SQL where
SQL can say the same."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tokenmill.llm import (bpe_lexicon, langid, ngram_lm, packing, prefix_trie, simhash, sp_codec, spelling, topk_threshold, toxicity, url_filter, warc,
                           winnow)
from tokenmill.llm.common import BYTE_BPE_JSON
from tokenmill.session import checkpoint_dir as shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query("op1_language_id")
def op1(spark, sf_dir):
    """doc_id, held_out, lang_pred, score of every document."""
    shared_folder(spark)
    return langid.language_id(table(spark, sf_dir, "documents"))


@_query("op8_sentencepiece")
def op8(spark, sf_dir):
    """doc_id, ids, n_ids and round_trip (decoding gives the text back) of every
    document; null texts have null ids."""
    out = sp_codec.encode(table(spark, sf_dir, "documents"), "text", "ids", keep=["doc_id"], check=True)
    return out.selectExpr("doc_id", "ids", "size(ids) AS n_ids", "round_trip")


@_query("op6_simhash_near_dups")
def op6(spark, sf_dir):
    """doc_id, fingerprint, component_id of every document: 3-word shingles, at
    most 3 differing bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 3, 3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_W10 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query("op10_decontamination", f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_W10}) AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, {_W10}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT DISTINCT doc_id, item_id, pos.n, i FROM pos JOIN win USING (t, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""")
def op10(spark, sf_dir):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every
    document against every benchmark item, windows of ten words."""
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op4_toxicity")
def op4(spark, sf_dir):
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op5_ngram_lm")
def op5(spark, sf_dir):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every document."""
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"))


@_query("op2_topk_threshold", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
      FROM v AS q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.x) = len(v.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op2(spark, sf_dir):
    """query_id, rank, vec_id, score: the ten best inner products of every
    hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return topk_threshold.top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LISTED_HOSTS = r"(^|[.])(adult|free)-"


@_query("op3_url_filter", r"""
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
       coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
       regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1) AS q FROM pages),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN
        regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
        coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'),
          lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') END AS c FROM u),
l AS (SELECT DISTINCT c FROM c WHERE regexp_matches(host, '(^|[.])(adult|free)-')),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
      ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(rh, rp, v)),
f AS (SELECT page_id, url, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY len(rh || rp) DESC) AS n
      FROM c, r WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT c.page_id, c.host, c.path, f.rule,
       coalesce(f.v, CASE WHEN c.c IN (SELECT c FROM l WHERE c IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN f ON c.page_id = f.page_id AND f.n = 1
""")
def op3(spark, sf_dir):
    """page_id, host, path, rule, verdict of every page. The list that the
    method looks up: the urls that the table holds on the unwanted hosts."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(url_filter.host(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return url_filter.judge(pages, listed, RULES)


@_query("op7_pack_tokens")
def op7(spark, sf_dir):
    """Packed rows of all documents: shard, row, n_tokens, input_ids,
    position_ids, cu_seqlens, keys, offsets."""
    return packing.pack(table(spark, sf_dir, "documents"))


def _warc_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    crlf = "chr(13) || chr(10)"
    text = "payload"
    for pattern, to in warc.STRIP:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(to)}, 'g')"
    # references: a rule of its own, part by part behind every ampersand
    number = "CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) ELSE chr(n::INTEGER) END"
    names = ", ".join(f"({quote(k[:-1])}, {quote(v)})" for k, v in sorted(html5.items()) if k.endswith(";"))
    spaces = "t"
    for pattern, to in warc.SPACES:
        spaces = f"regexp_replace({spaces}, {quote(pattern)}, {quote(to)}, 'g')"
    part = ("CASE WHEN regexp_matches(x, '^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});') "
            "THEN coalesce(names[split_part(x, ';', 1)], numbers[split_part(x, ';', 1)], '&' || split_part(x, ';', 1) || ';') "
            "|| substr(x, strpos(x, ';') + 1) ELSE '&' || x END")
    read = (f"list_transform([list_transform([string_split({text}, '&')], lambda p: p[1] || array_to_string(list_transform(p[2:], "
            f"lambda x: {part}), ''))[1]], lambda t: trim({spaces}, ' ' || chr(10)))[1]")
    uuid = lambda h: (f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) "  # noqa: E731
                      f"|| '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'")
    size = lambda c: f"strlen({c})::VARCHAR"
    return f"""
WITH names AS (SELECT map_from_entries(list((k, v))) AS names FROM (VALUES {names}) AS t(k, v)),
numbers AS (SELECT map_from_entries(list((k, {number}))) AS numbers FROM (
  SELECT DISTINCT k, CASE WHEN k[2] IN ('x', 'X') THEN ('0x' || k[3:])::BIGINT ELSE k[2:]::BIGINT END AS n
  FROM (SELECT unnest(regexp_extract_all(html, '&(#0*[0-9]{{1,7}}|#[xX]0*[0-9a-fA-F]{{1,6}});', 1)) AS k FROM pages))),
p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
a AS (SELECT *, concat_ws(chr(31), '=response', coalesce('=' || page_id::VARCHAR, '-'), coalesce('=' || url, '-'), '=' || sha256(payload)) AS name,
        'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: '
        || {size('payload')} AS head FROM p),
b AS (SELECT *, {uuid('sha256(name)')} AS src, 'sha256:' || sha256(payload) AS pd,
        'sha256:' || sha256(head || {crlf} || {crlf} || payload) AS bd, {read} AS text,
        regexp_replace(regexp_extract(payload, '(?is)<title\\b[^>]*>(.*?)</title\\b', 1), '[\\r\\n]+', ' ', 'g') AS title,
        regexp_extract(payload, '(?i)<html\\b[^>]*lang="([A-Za-z-]*)"', 1) AS lang,
        len(regexp_extract_all(payload, '(?i)(<a [^>]*href=)')) AS links FROM a, names, numbers),
c AS (SELECT *, {uuid("sha256('=metadata' || chr(31) || '=' || src)")} AS mid, {uuid("sha256('=conversion' || chr(31) || '=' || src)")} AS tid,
        'source-status: HTTP/1.1 200 OK' || {crlf} || 'source-header: Content-Type: text/html; charset=utf-8' || {crlf}
        || 'source-header: Content-Length: ' || {size('payload')} || {crlf} || 'source-block-digest: ' || bd || {crlf}
        || 'source-payload-digest: ' || pd || {crlf} || 'title: ' || title || {crlf} || 'language: ' || lang || {crlf}
        || 'links: ' || links::VARCHAR || {crlf} || 'text-digest: sha256:' || sha256(text) || {crlf} AS fields FROM b),
d AS (SELECT page_id, url, src, pd, 'metadata' AS warc_type, mid AS record_id, tid AS other,
        'application/warc-fields' AS mime, fields AS body FROM c
      UNION ALL SELECT page_id, url, src, pd, 'conversion', tid, mid, 'text/plain; charset=utf-8', text FROM c)
SELECT page_id, warc_type, record_id, src AS refers_to,
  'WARC/1.1' || {crlf} || 'WARC-Type: ' || warc_type || {crlf} || 'WARC-Record-ID: ' || record_id || {crlf}
  || 'WARC-Refers-To: ' || src || {crlf} || 'WARC-Concurrent-To: ' || other || {crlf}
  || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), ''), chr(10), '') || {crlf}, '')
  || 'WARC-Date: 1970-01-01T00:00:00Z' || {crlf} || 'WARC-Source-Payload-Digest: ' || pd || {crlf}
  || 'WARC-Block-Digest: sha256:' || sha256(body) || {crlf} || 'Content-Type: ' || mime || {crlf}
  || 'Content-Length: ' || {size('body')} || {crlf} || {crlf} || body || {crlf} || {crlf} AS record
FROM d"""


@_query("op9_warc_derivatives", _warc_sql())
def op9(spark, sf_dir):
    """page_id, warc_type, record_id, refers_to, record: the metadata and the
    conversion record of every page's response."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


@_query("op13_prefix_trie", r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, i:
             CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b)) AS tab),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
            lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
f AS (SELECT conv_id AS c, depth, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '')
             OVER (PARTITION BY conv_id ORDER BY depth)) AS key,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM n
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY c) AS last FROM f),
g AS (SELECT key, min(c) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words,
        coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '') AS ends FROM l GROUP BY key),
k AS (SELECT up AS key, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT a.key, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves, sum((g.n_convs - 1) * g.words)::BIGINT AS saved_tokens
      FROM g JOIN l AS a ON a.c = g.conv_id AND a.depth <= g.depth LEFT JOIN k ON k.key = g.key GROUP BY 1)
SELECT g.conv_id, g.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n_children, 0) AS n_children,
  s.n_leaves, s.saved_tokens, sha256(g.ends) AS ends_sha256
FROM g LEFT JOIN g AS p ON p.key = g.up LEFT JOIN k ON k.key = g.key JOIN s ON s.key = g.key
""")
def op13(spark, sf_dir):
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 of every prefix of the rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@_query("op12_bpe_lexicon")
def op12(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; the
    automaton holds the documents' own frequent words."""
    docs = table(spark, sf_dir, "documents")
    lexicon = bpe_lexicon.build(docs, "text", BYTE_BPE_JSON)
    return bpe_lexicon.round_trip(docs, "doc_id", "text", BYTE_BPE_JSON, lexicon)


@_query("op11_spelling_variants", r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, i:
             CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b)) AS tab),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
      FROM documents),
e AS (SELECT k, run, count(*) AS n FROM d WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(k || ':' || run, ''),
        lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [(192 + unicode(s) // 64)::BIGINT, (128 + unicode(s) % 64)::BIGINT] END))),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM e, crc),
o AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM x AS a JOIN x AS b USING (short, i) WHERE a.word <> b.word
      UNION SELECT a.word, a.n, b.word, b.n FROM x AS a JOIN w AS b ON a.short = b.word
      UNION SELECT b.word, b.n, a.word, a.n FROM x AS a JOIN w AS b ON a.short = b.word),
q AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
        CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN q ON q.word = w.word AND q.r = 1),
t AS (SELECT word, word AS root, form AS next FROM f
      UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON t.word = f.word WHERE t.next IS NULL
""")
def op11(spark, sf_dir):
    """word, form, root, n, n_near, form_n of the documents' words."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
