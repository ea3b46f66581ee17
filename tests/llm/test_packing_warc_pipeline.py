"""op7, op9 and the pipeline: round trips, brute force, edge cases."""

import hashlib
import os
import shutil
import sys
import tempfile

import numpy as np
import pytest

from tokenmill.llm import packing as P
from tokenmill.llm import warc
from tokenmill.llm.common import BYTE_BPE


def brute_fit(lengths, room):
    free, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(f, r) for r, f in enumerate(free) if f >= lengths[i]]
        if fits:
            r = min(fits)[1]
        else:
            r = len(free)
            free.append(room)
        free[r] -= lengths[i]
        out[i] = r
    return out, free


def test_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for room in (1, 7, 64, 100):
        for _ in range(30):
            lengths = rng.integers(1, room + 1, rng.integers(0, 80))
            rows = P.best_fit(lengths, room)
            used = np.bincount(rows, weights=lengths, minlength=1)
            assert (used <= room).all()
            assert sorted(used[used > 0]) == sorted(room - f for f in brute_fit(lengths.tolist(), room)[1])


def test_pack_is_lossless(spark):
    enc = P.encoder(open(BYTE_BPE, "rb").read())
    texts = [(1, "hello world " * 50), (2, None), (3, ""), (4, "long " * 3000), (4, "long " * 3000), (None, "x"),
             (5, "<|endoftext|> é 😀\n\n  z")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts], "doc_id long, text string, row int, keys int").coalesce(1)
    rows = P.pack(df, room=128, shard_tokens=2000).collect()
    assert set(rows[0].asDict()) == {"shard", "row", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "keys", "offsets"}
    parts = []
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, np.uint16), np.frombuffer(r.position_ids, np.uint16)
        assert len(ids) == 128 and r.cu_seqlens[-1] == r.n_tokens <= 128
        for k, o, a, b in zip(r.keys, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (pos[a:b] == np.arange(b - a)).all()
            parts.append((k, o, ids[a:b].tolist()))
    for k, t in texts:
        want = enc.encode_ordinary(t or "") + [P.END_ID]
        mine = sorted((o, x) for q, o, x in parts if q == k)
        assert sum(len(x) for _, x in mine) == len(want) * sum(q == k for q, _ in texts)
        for o, x in mine:
            assert want[o:o + len(x)] == x
    assert P.pack(df.limit(0)).count() == 0
    seg = P.segments(P.pack(df, room=128)).collect()
    assert sum(s.length for s in seg) == sum(len(x) for _, _, x in parts)


def test_written_rows_read_back(spark, tmp_dir):
    df = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    P.write(P.pack(df, room=16), f"{tmp_dir}/packed")
    r = spark.read.parquet(f"{tmp_dir}/packed").first()
    assert r.keys == ["a"] and len(r.input_ids) == 32


PAGE = ('<!DOCTYPE html><html lang="de"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>'
        '<body><!-- no --><a href="/x">one</a> <a class="k" href="/y">two</a><p>x &lt;&nbsp;y</p><br>\n z</body></html>')


def test_derivatives(spark):
    rows = [(1, "http://a/\r\nX: y", PAGE, "t"), (2, None, None, "t"), (3, "http://b/", "", "t"), (3, "http://b/", "", "t"),
            (None, "http://c/", "<p>" * 20_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    source = warc.responses(pages)
    out = warc.derive(source).collect()
    assert len(out) == 2 * len(rows)
    for r in out:
        head, _, rest = r.record.partition("\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        body = rest[:-4]
        assert head.startswith("WARC/1.1\r\n") and rest.endswith("\r\n\r\n") and "X" not in lines
        assert lines["WARC-Type"] == r.warc_type and lines["WARC-Record-ID"] == r.record_id
        assert lines["WARC-Refers-To"] == r.refers_to and int(lines["Content-Length"]) == len(body.encode())
        assert lines["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body.encode()).hexdigest()
    by = {(r.page_id, r.warc_type): r for r in out}
    text = by[1, "conversion"].record.partition("\r\n\r\n")[2][:-4]
    assert text == "one two\nx < y\nz"
    meta = by[1, "metadata"].record
    for line in ("source-status: HTTP/1.1 200 OK", "source-header: Content-Type: text/html; charset=utf-8", "title: A &amp; B",
                 "language: de", "links: 2", "text-digest: sha256:" + hashlib.sha256(text.encode()).hexdigest(),
                 "source-payload-digest: sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()):
        assert line + "\r\n" in meta
    assert "WARC-Target-URI" not in by[2, "conversion"].record and by[2, "conversion"].record.endswith("\r\n\r\n\r\n\r\n")
    assert by[1, "metadata"].record_id != by[1, "conversion"].record_id
    assert by[1, "conversion"].record_id in meta
    assert warc.derive(source.limit(0)).count() == 0


def test_text_of_odd_pages(spark):
    import pyarrow as pa
    cases = [("a&#8217;b &eacute;&#x20AC;&#X41; &nope; &amp;lt; &notin; &amp &#0;&#xD800;&#99999999; &", "a\u2019b é€A &nope; &lt; ∉ &amp \ufffd\ufffd&#99999999; &"),
             ("x<script>a</style>b</script>y", "xy"), ("x<!-- a <script> --> y </script>z", "x y z"), ("x<!-- open <p>y", "x"),
             ("x<script>never closed <p>", "x"), ("a < b <b>c</b> <3", "a < b c <3"), ("a\t b\x0b\x0bc&nbsp;&nbsp;d \n \n e ", "a b c d\ne"),
             ("", ""), ("<p>", ""), ("x<", "x<"), ("x<p y", "x<p y"), ("  a  ", "a")]
    got = warc.plain_text(pa.array([c[0] for c in cases], pa.large_string())).to_pylist()
    assert got == [c[1] for c in cases]
    for bad in ("<!-- " * 200_000, "<script" * 100_000, "<" * 500_000, "&" * 500_000, " \n" * 300_000):
        assert len(warc.plain_text(pa.array([bad], pa.large_string()))[0].as_py()) <= len(bad)


def test_odd_pages_equal_sql(spark):
    import duckdb
    from tokenmill.llm.queries import ORACLES
    rows = [(1, "u", "<title>T\nt</title>a&#8217;b &eacute;&#x20AC; &nope; &amp;lt; &#0;&#xD800; &"), (2, None, None), (None, "u\r\nX: y", "x"),
            (4, "u", "x<script>a</style>b</script>y<!-- open <p>"), (4, "u", "x<script>a</style>b</script>y<!-- open <p>"), (None, None, "x")]
    out = warc.derive(warc.responses(spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, k string")))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    cols = ", ".join(out.columns)
    want = con.execute(f"SELECT {cols} FROM ({ORACLES['op9_warc_derivatives']})").fetchall()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert len({r.record_id for r in out.collect()}) == 10  # the repeated page alone shares its ids


def test_block_without_payload(spark):
    df = spark.createDataFrame([(1, "<urn:uuid:1>", None, None, None), (2, "<urn:uuid:2>", "u", "d", "HTTP/1.1 404\r\nA: b")],
                               "page_id long, record_id string, target_uri string, date string, block string")
    out = {(r.page_id, r.warc_type): r.record for r in warc.derive(df).collect()}
    assert len(out) == 4 and "WARC-Date" not in out[1, "metadata"]
    assert "source-status: HTTP/1.1 404\r\nsource-header: A: b\r\n" in out[2, "metadata"]


@pytest.fixture(scope="module")
def small(spark):
    """A folder with the three tables the pipeline reads: sf0.001 and a few
    planted rows."""
    top = tempfile.mkdtemp(prefix="tokenmill-test-")
    src = "/root/testdata/sf0.001"
    for t in ("labels", "benchmark"):
        shutil.copytree(f"{src}/{t}.parquet", f"{top}/{t}.parquet") if os.path.isdir(f"{src}/{t}.parquet") else \
            shutil.copy(f"{src}/{t}.parquet", f"{top}/{t}.parquet")
    docs = spark.read.parquet(f"{src}/documents.parquet")
    bench = spark.read.parquet(f"{src}/benchmark.parquet").where("text is not null").first().text
    en = docs.where("lang = 'en' and n_chars > 1500").first().text
    rows = [(90_000, en, "en", "s", 1), (90_001, en + " end", "en", "s", 1), (90_002, bench, "en", "s", 1),
            (90_003, None, None, None, None), (90_004, "", "en", "s", 0), (90_005, "12 34", "en", "s", 5)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{top}/documents.parquet")
    return top


def test_pipeline_keeps_what_the_operators_keep(spark, small):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as C
    from tokenmill.llm import langid, simhash, sp_codec, toxicity, winnow
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {r.doc_id: r for r in C.run(spark, small).collect()}
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert set(out) <= set(ids) and not {90_002, 90_003, 90_004, 90_005} & set(out)
    assert len({90_000, 90_001} & set(out)) <= 1

    def named(df, *ids):
        return docs.where(docs.doc_id.isin(*ids)) if ids else docs.limit(0)

    tox = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 0").collect()}
    step = named(docs, *tox)
    lang = {r.doc_id for r in langid.language_id(step).where("lang_pred <> 'und' and score >= 0.5").collect()}
    step = named(docs, *lang)
    near = {r.doc_id for r in simhash.near_duplicates(step).where("doc_id = component_id").collect()}
    step = named(docs, *near)
    bad = winnow.decontaminate(step, spark.read.parquet(f"{small}/benchmark.parquet")).where("contaminated")
    want = near - {r.doc_id for r in bad.collect()}
    assert set(out) == want
    ids = {r.doc_id: r.ids for r in sp_codec.encode(named(docs, *want), keep=["doc_id"]).collect()}
    assert all(out[d].ids == ids[d] and out[d].n_ids == len(ids[d]) for d in want)


def test_stages_on_an_empty_table(spark, small):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, small)
        assert got.columns == docs.columns and got.count() == 0, name
    assert C.STAGES[-1][1](spark, docs, small).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
