"""WARC derivatives: metadata and plain-text conversion records of responses.

A response is (record_id, target_uri, date, block); its block is the HTTP header
section, an empty line and the payload. ``derive`` gives two records a response,
both refer to it (WARC-Refers-To) and to each other (WARC-Concurrent-To):

* metadata (application/warc-fields): the source's header lines, its block and
  payload digest, title, language, number of links, digest of the text;
* conversion (text/plain): the visible text.

The payload is read once, in Arrow batches, by a linear-time expression engine (no
pattern can run over a page twice, however many unclosed tags it has), where all
digests are taken too; the records are column expressions. No shuffle, no state: a lost task
is simply computed again. Record ids come from the source's id and the record
type, so building twice gives the same records.

Text: comments, scripts, styles, titles and templates go (to the end of the page where they
are not closed), block elements break the line, other tags go, character references
of HTML 5 that end in a semicolon are read (others stay), and white space is closed up.

Cases: a null or empty block, or one without an empty line, has no header lines
resp. no payload and still gives both records; a null target uri leaves its line
out; line breaks in a uri or header value cannot open a new header. Responses
that repeat give the same records each. Columns beside the four named ones do
not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tokenmill.llm.common import as_text, quoted, slices, text_batches

CRLF = "\r\n"
_ELEMENTS = ("script", "style", "noscript", "template", "title")
#: Replaced in this order: (pattern, replacement), in RE2's dialect.
STRIP = [
    ("(?is)<!--.*?(?:-->|\\z)" + "".join(rf"|<{e}\b[^>]*>.*?(?:</{e}\b[^>]*>|\z)" for e in _ELEMENTS), ""),
    (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|footer|header|nav|body|html|head)\b[^>]*>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
]
#: After the references: runs that are more than one space, line breaks with what surrounds them.
SPACES = [(r"[\t\x0B\f\r\x{a0}][\t\x0B\f\r\x{a0} ]*| [\t\x0B\f\r\x{a0} ]+", " "), (r" ?\n[\n ]*", "\n")]
REFERENCE = re.compile(r"&(?:#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});")
TITLE = r"(?is)<title\b[^>]*>(?P<x>.*?)</title\b"
LANG = r"(?i)<html\b[^>]*lang=\"(?P<x>[A-Za-z-]*)\""
LINK = r"(?i)<a [^>]*href="


def _reference(m: re.Match) -> str:
    """One character reference; a name that HTML 5 does not have stays."""
    ref = m.group()
    return html.unescape(ref) if ref[1] == "#" or ref[1:] in html.entities.html5 else ref


def plain_text(pages: pa.Array) -> pa.Array:
    """Visible text of HTML pages, one line a block element."""
    for pattern, to in STRIP:
        pages = pc.replace_substring_regex(pages, pattern, to)
    has = pc.match_substring(pages, "&")
    if pc.any(has).as_py():
        read = [REFERENCE.sub(_reference, t) for t in pages.filter(has).to_pylist()]
        pages = pc.replace_with_mask(pages, has, pa.array(read, pages.type))
    for pattern, to in SPACES:
        pages = pc.replace_substring_regex(pages, pattern, to)
    return pc.utf8_trim(pages, " \n")


def _first(pages: pa.Array, pattern: str) -> pa.Array:
    """The group x of the first match, '' without one."""
    return pc.fill_null(pc.struct_field(pc.extract_regex(pages, pattern), "x"), "")


def _sha(texts) -> pa.Array:
    return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())


READ = ["block_digest", "head", "payload_digest", "title", "lang", "links", "text", "text_digest"]


def _read(batches):
    """Batches of k, record_id, uri, date, block with the block read."""
    for b in batches:
        blocks = as_text(b.column(4))
        for at, n in slices(blocks):
            part = blocks.slice(at, n).to_pylist()
            cut = [t.partition(CRLF + CRLF) for t in part]
            payload = pa.array([c[2] for c in cut], pa.large_string())
            text = plain_text(payload)
            title = pc.replace_substring_regex(_first(payload, TITLE), r"[\r\n]+", " ")
            cols = [_sha(part), pa.array([c[0] for c in cut], pa.string()), _sha(c[2] for c in cut), title.cast(pa.string()),
                    _first(payload, LANG).cast(pa.string()), pc.count_substring_regex(payload, LINK).cast(pa.int64()),
                    text.cast(pa.string()), _sha(text.to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(i).slice(at, n) for i in range(4)], *cols],
                                             names=["k", "record_id", "uri", "date", *READ])


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A name-based urn:uuid of the parts (a null part is not an absent one)."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts]).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
              date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages: key, record_id, target_uri, date,
    block."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length(body).cast("string"))
    return pages.select(F.col(key), record_id(F.lit("response"), F.col(key).cast("string"), F.col(url),
                                              F.sha2(body.cast("binary"), 256)).alias("record_id"),
                        F.col(url).alias("target_uri"), F.lit(date).alias("date"),
                        F.concat(head, F.lit(CRLF + CRLF), body).alias("block"))


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, warc_type, record_id, refers_to, record): the metadata and the
    conversion record of every response; ``record`` is the whole WARC record."""
    text_batches(records.sparkSession)
    src = records.select(F.col(quoted(key)).alias("k"), "record_id", F.translate("target_uri", CRLF, "").alias("uri"),
                         F.translate("date", CRLF, "").alias("date"), "block")
    schema = StructType(src.schema.fields[:4] + [StructField(c, LongType() if c == "links" else StringType()) for c in READ])
    src = src.mapInArrow(_read, schema).select(
        "*", record_id(F.lit("metadata"), F.col("record_id")).alias("meta_id"),
        record_id(F.lit("conversion"), F.col("record_id")).alias("text_id"))
    sha = lambda c: F.concat(F.lit("sha256:"), c)
    status = F.regexp_extract("head", r"^([^\r\n]*)", 1)
    lines = F.regexp_replace(F.regexp_replace(F.col("head"), r"^[^\r\n]*[\r\n]*", ""), r"[\r\n]+", CRLF)
    source = F.when(lines == "", F.lit("")).otherwise(
        F.concat(F.lit("source-header: "), F.replace(lines, F.lit(CRLF), F.lit(CRLF + "source-header: ")), F.lit(CRLF)))
    fields = F.concat(
        F.lit("source-status: "), status, F.lit(CRLF), source,
        F.lit("source-block-digest: "), sha(F.col("block_digest")), F.lit(CRLF),
        F.lit("source-payload-digest: "), sha(F.col("payload_digest")), F.lit(CRLF),
        F.lit("title: "), F.col("title"), F.lit(CRLF), F.lit("language: "), F.col("lang"), F.lit(CRLF),
        F.lit("links: "), F.col("links").cast("string"), F.lit(CRLF),
        F.lit("text-digest: "), sha(F.col("text_digest")), F.lit(CRLF))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("t"), F.col("meta_id").alias("id"), F.col("text_id").alias("other"),
                 F.lit("application/warc-fields").alias("mime"), fields.alias("body"), F.lit(None).cast("string").alias("digest")),
        F.struct(F.lit("conversion").alias("t"), F.col("text_id").alias("id"), F.col("meta_id").alias("other"),
                 F.lit("text/plain; charset=utf-8").alias("mime"), F.col("text").alias("body"), sha(F.col("text_digest")).alias("digest")))
    out = src.select("k", "record_id", "uri", "date", "payload_digest", F.explode(kinds).alias("r"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit(CRLF))
    body = F.col("r.body")
    record = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("r.t")), line("WARC-Record-ID", F.col("r.id")),
        line("WARC-Refers-To", F.col("record_id")), line("WARC-Concurrent-To", F.col("r.other")),
        F.coalesce(line("WARC-Target-URI", F.col("uri")), F.lit("")), F.coalesce(line("WARC-Date", F.col("date")), F.lit("")),
        line("WARC-Source-Payload-Digest", sha(F.col("payload_digest"))),
        line("WARC-Block-Digest", F.coalesce("r.digest", digest(body))),
        line("Content-Type", F.col("r.mime")), line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF), body, F.lit(CRLF + CRLF))
    return out.select(F.col("k").alias(key), F.col("r.t").alias("warc_type"), F.col("r.id").alias("record_id"),
                      F.col("record_id").alias("refers_to"), record.alias("record"))
