"""Readers, writers and the size-guarded fallback paths."""

import json
import os

from pyspark.sql import functions as F

from tokenmill.operators import vocab as V
from tokenmill.sources import corpus as C
from tokenmill.sources import logs as LG
from tokenmill.sources.vocab_files import read_vocab, write_vocab


def test_char_encode_over_all_planes(spark):
    text = "".join(chr(c) for c in [*range(32, 1200), *range(0x4E00, 0x5600), 0xFFFD, 0x1F600, 0x10FFFF])
    df = spark.createDataFrame([(1, text), (2, ""), (3, "aé中😀")], "k int, text string")
    v = V.char_vocab(df.where("k = 1"), "text")
    got = {r.k: r.ids for r in V.char_encode(df, "text", v, on_unknown="unk", unk_id=-7).collect()}
    want = {t: i for i, t in enumerate(sorted(set(text)))}
    assert got[1] == [want[c] for c in text] and got[2] == [] and got[3] == [want.get(c, -7) for c in "aé中😀"]


def test_vocab_file_round_trip(spark, tmp_dir):
    path = os.path.join(tmp_dir, "v.vocab")
    with open(path, "w", encoding="utf-8") as f:
        f.write("<pad>\t0\n<s>\t0\n</s>\t0\n<unk>\t0\n▁t\t-0\n\"\t-1\nab\tc\t-2\n")
    got = sorted((r.id, r.piece, r.score, r.kind) for r in read_vocab(spark, path).collect())
    assert got == [(0, "<pad>", 0, "special"), (1, "<s>", 0, "special"), (2, "</s>", 0, "special"),
                   (3, "<unk>", 0, "special"), (4, "▁t", 0, "piece"), (5, '"', -1, "piece"), (6, "ab\tc", -2, "piece")]
    out = os.path.join(tmp_dir, "out")
    v = spark.createDataFrame([(r[0], r[1]) for r in got], "id bigint, piece string")
    write_vocab(v, out)
    again = sorted((r.id, r.piece) for r in read_vocab(spark, out).collect())
    assert again == [(r[0], r[1]) for r in got]


def test_read_pairs_json_and_parquet(spark, tmp_dir):
    rows = [{"pair_id": 1, "split": "train", "translation": {"en": "hi", "zh": "你好"}},
            {"pair_id": 2, "split": "test", "translation": {"en": "bye", "zh": "再见"}}]
    jp = os.path.join(tmp_dir, "pairs.json")
    with open(jp, "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    got = C.read_pairs(spark, jp, "en", "zh", "train", fmt="json").collect()
    assert [(r.pair_id, r.src, r.tgt) for r in got] == [(1, "hi", "你好")]
    pq = os.path.join(tmp_dir, "pq")
    C.write_pairs(spark.read.schema(C.PAIR_SCHEMA).json(jp), pq)
    back = C.read_pairs(spark, pq, "zh", "en", "test").collect()
    assert [(r.pair_id, r.src, r.tgt) for r in back] == [(2, "再见", "bye")]


def test_run_logs_round_trip(spark, tmp_dir):
    lines = spark.createDataFrame([(7, 1, "VAL loss: 1.0, ppl=2.7"), (7, 2, "b"), (8, 1, "c")],
                                  "run bigint, line_no bigint, line string")
    path = os.path.join(tmp_dir, "logs")
    LG.write_run_logs(lines, path)
    got = LG.read_run_logs(spark, path).where(F.col("line") != "").orderBy("run", "line_no").collect()
    assert [(r.run, r.section, r.line) for r in got] == [("7", "stdout", "VAL loss: 1.0, ppl=2.7"), ("7", "stdout", "b"),
                                                        ("8", "stdout", "c")]


def test_load_or_train_reuses_saved_vocab(spark, tmp_dir):
    """A store is reused for the texts and size it was trained on, and for those
    only: another corpus gets a vocabulary of its own beside it."""
    from tokenmill.operators.vocab_store import fingerprint, load_or_train, path_exists
    df = spark.createDataFrame([("low lower lowest",), ("new newer",)], "text string")
    path = os.path.join(tmp_dir, "store")
    place = f"{path}/fit={fingerprint(df, 'text', 30, 0.9995)}"
    assert not path_exists(spark, place)
    first = sorted(tuple(r) for r in load_or_train(spark, path, df, "text", 30).collect())
    assert path_exists(spark, place)
    other = spark.createDataFrame([("zzz",)], "text string")  # trains a different vocabulary
    assert sorted(tuple(r) for r in load_or_train(spark, path, other, "text", 30).collect()) != first
    assert sorted(tuple(r) for r in load_or_train(spark, path, df, "text", 30).collect()) == first


def test_hot_run_log_spans_files_in_order(spark, tmp_dir):
    rows = [(1, i, f"line {i}") for i in range(300)] + [(2, i, f"x{i}") for i in range(3)]
    lines = spark.createDataFrame(rows, "run bigint, line_no bigint, line string")
    path = os.path.join(tmp_dir, "hot")
    LG.write_run_logs(lines, path, partitions=6)
    files = os.listdir(os.path.join(path, "run=1"))
    assert len([f for f in files if f.startswith("part-")]) > 1  # the hot run is written by several tasks
    got = LG.read_run_logs(spark, path).where(F.col("line") != "").orderBy("run", "line_no").collect()
    assert [(int(r.run), r.line) for r in got] == [(r, t) for r, _, t in rows]
    assert {r.section for r in got} == {"stdout"}
    with open(os.path.join(path, "run=2", "part-99999-extra.txt"), "w") as f:
        f.write("traceback line\n")  # sorts after the stderr marker file
    tail = LG.read_run_logs(spark, path).where("run = '2'").orderBy("line_no").collect()
    assert tail[-1].line == "traceback line" and tail[-1].section == "stderr"


def test_flat_run_logs(spark, tmp_dir):
    path = os.path.join(tmp_dir, "flat")
    os.makedirs(path)
    with open(os.path.join(path, "m11_lr=1_log.txt"), "w") as f:
        f.write("=== STDOUT ===\nVAL loss: 1.5, ppl=4.5\n\n\n=== STDERR ===\nboom\n")
    with open(os.path.join(path, "train_variant_01_20240101.log"), "w") as f:
        f.write("VAL loss: 2.5, ppl=9.5\n" + "x\n" * 500)
    logs = LG.read_run_logs(spark, path)
    got = {(r.run, r.line_no): (r.section, r.line) for r in logs.collect()}
    assert got["m11_lr=1", 1] == ("stdout", "VAL loss: 1.5, ppl=4.5") and got["m11_lr=1", 5] == ("stderr", "boom")
    assert got["train_variant_01_20240101", 0][0] == "stdout" and len(got) == 4 + 501
    from tokenmill.operators.runs import parse_metrics
    assert {r.run: r.eval_loss for r in parse_metrics(logs).collect()} == {"m11_lr=1": 1.5, "train_variant_01_20240101": 2.5}


def test_table_scores_and_corpus_loss(spark):
    from tokenmill.operators import decode as D, scoring as S
    padded = spark.createDataFrame([(1, [1, 5, 6], [5, 6, 0]), (2, [1, 9, 0], [9, 2, 0])], "pair_id int, tgt_in_pad array<bigint>, tgt_out_pad array<bigint>")
    bigram = spark.createDataFrame([(1, 5, -1.0), (5, 6, -2.0), (1, 9, -3.0)], "prev bigint, nxt bigint, logp double")
    out = D.table_scores(padded, bigram)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 5, -1.0), (1, 1, 6, -2.0), (2, 0, 9, -3.0), (2, 1, 2, -20.0)]
    r = S.corpus_loss(out).first()
    assert (r.loss, r.ntok) == (6.5, 4)


def test_bulk_translate_gives_one_row_per_source(spark):
    from tokenmill.operators import bpe as BP, decode as D
    df = spark.createDataFrame([(1, "low lower", "new newer"), (2, "lowest", "newest"), (3, "  ", "x"), (4, "new", "low"),
                                (5, "unseen zz", "qq")], "pair_id bigint, src string, tgt string")
    learn = df.where("pair_id < 3")
    vocab, _ = BP.bpe_train(learn.selectExpr("concat_ws(' ', src, tgt) AS text"), "text", 30)
    enc = BP.bpe_encode(BP.bpe_encode(learn, "src", vocab, "src_raw"), "tgt", vocab, "tgt_raw")
    for how in ("beam", "greedy"):
        got = {r.pair_id: r.hyp for r in D.bulk_translate(df, vocab, D.translation_scores(enc), how, max_len=12).collect()}
        assert set(got) == {1, 2, 3, 4, 5} and got[3] == "" and got[1] in ("new newer", "newest") and got[2] in ("newest", "new newer")


def test_documents_by_byte_ranges(spark, tmp_dir):
    """Files of many splits: pieces give the exact text back, windows agree with
    slicing, and the whole-file reader with both."""
    import os
    from tokenmill.operators import longtext as LT
    from tokenmill.sources import corpus as C
    texts = {"a.txt": "héllo\nwörld 🙂\r\nx" * 40, "b.txt": "ends with a break\n" * 30, "c.txt": "", "d.txt": "\n\n\n",
             "e.txt": "y" * 5000 + "\n" + "z" * 10, "f.txt": "one"}
    for name, t in texts.items():
        with open(os.path.join(tmp_dir, name), "w", encoding="utf-8", newline="") as f:
            f.write(t)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        pieces = C.read_document_pieces(spark, tmp_dir, 5)
        rows = sorted((r.off, r.doc.rsplit("/", 1)[1], r.piece) for r in pieces.collect())
        got = {}
        for _, name, piece in rows:
            got[name] = got.get(name, "") + piece
        assert got == {n: t for n, t in texts.items() if t}
        ranges = {r.doc.rsplit("/", 1)[1]: r for r in C.document_ranges(pieces).collect()}
        assert all((ranges[n].n_chars, ranges[n].n_lines) == (len(t), t.count("\n") + 1) for n, t in texts.items() if t)
        r = ranges["a.txt"]
        mine = pieces.where(pieces.doc.endswith("/a.txt"))
        w = sorted((x.window_id, x.x, x.y) for x in LT.corpus_windows(mine, 32, 16, base=r.first, total=r.n_chars).collect())
        t = texts["a.txt"]
        assert w == [(i, t[i * 16:i * 16 + 32], t[i * 16 + 1:i * 16 + 33]) for i in range((len(t) - 32) // 16)]
        whole = {r.doc.rsplit("/", 1)[1]: r.text for r in C.read_document(spark, tmp_dir).collect()}
        assert {n: t for n, t in whole.items() if t} == got
    finally:
        spark.conf.set(key, before)


def test_documents_and_logs_are_written_by_the_tasks(spark, tmp_dir):
    """One file a document, without a folder or a checksum file of its own; names and
    lines as Spark's writer has them, also for names that it escapes."""
    docs = spark.createDataFrame([(1, "a\nb"), (-2, None), (3, "é"), (3, "é"), (None, "n")], "doc_id long, text string").coalesce(1)
    top = os.path.join(tmp_dir, "docs")
    for _ in range(2):  # the second replaces the first
        C.write_documents(docs, "doc_id", "text", "file:" + top)
    files = [os.path.join(d, f) for d, _, names in os.walk(top) for f in names if not f.startswith(("_", "._"))]
    assert sorted(os.path.basename(f) for f in files) == ["doc_id=-2.txt", "doc_id=1.txt", "doc_id=3.txt", "doc_id=__HIVE_DEFAULT_PARTITION__.txt"]
    got = {r.doc.rsplit("=", 1)[1]: r.text for r in C.read_document(spark, top).collect()}
    assert got == {"1.txt": "a\nb\n", "-2.txt": "\n", "3.txt": "é\né\n", "__HIVE_DEFAULT_PARTITION__.txt": "n\n"}
    odd = ["a b", "x/y", "50%", "k=v", "q'\"", "a:b*?", "tab\t", "{z}", "[w]", "^", "back\\slash", "é", "", None]
    lines = spark.createDataFrame([(r, i, f"line {i}") for r in odd for i in range(3)], "run string, line_no bigint, line string")
    LG.write_run_logs(lines, "file:" + os.path.join(tmp_dir, "logs"), 4)
    lines.select("run", "line").write.partitionBy("run").text(os.path.join(tmp_dir, "spark"))
    names = {d: {n for n in os.listdir(os.path.join(tmp_dir, d)) if n.startswith("run=")} for d in ("logs", "spark")}
    assert names["logs"] == names["spark"]
    assert not [f for _, _, fs in os.walk(os.path.join(tmp_dir, "logs")) for f in fs if f.startswith(".part")]
    back = LG.read_run_logs(spark, os.path.join(tmp_dir, "logs")).where("line != ''")
    assert back.count() == 42 and back.select("run").distinct().count() == 13


def test_documents_are_listed_by_the_tasks(spark, tmp_dir):
    """The driver holds no entry for a file, and the rows are those of Spark's whole-text
    reader: addresses, hidden and empty files, links, bytes that are no UTF-8, codecs."""
    import gzip
    top = os.path.join(tmp_dir, "a b")
    files = {"50%.txt": b"x\r\ny\n", "q'\"\t#&[z].txt": b"\xef\xbb\xbfb", "é .txt": b"\xff\xfea\xc3", "empty.txt": b"", "none.gz": gzip.compress(b""),
             "UP.GZ": gzip.compress(b"up"), ".hidden": b"h", "_h": b"h", "_k=1": b"k", "_metadata": b"m", "c._COPYING_": b"c",
             "d/k=1/_e=2/f": b"deep", "d/_no/f": b"n", "d/.no/f": b"n", "d/_metadata_d/f": b"yes"}
    for name, data in files.items():
        os.makedirs(os.path.dirname(os.path.join(top, name)), exist_ok=True)
        with open(os.path.join(top, name), "wb") as f:
            f.write(data)
    os.symlink(os.path.join(top, "d/k=1"), os.path.join(top, "link"))
    os.symlink(os.path.join(tmp_dir, "nothing"), os.path.join(top, "broken"))
    lines = spark.range(60_000).selectExpr("concat('line ', id * id) AS v").coalesce(1)
    for codec in ("bzip2", "deflate", "gzip", "lz4", "snappy"):
        lines.write.option("compression", codec).text(os.path.join(top, codec))

    def rows(df):
        return sorted(tuple(r) for r in df.select("doc", F.hex("text"), F.length("text")).collect())

    def by_spark(path):
        return rows(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text")))

    want = by_spark(top)
    assert len(want) == 14 and [n for d, _, n in want if d.endswith("none.gz")] == [0]
    for path in (top, f"file:{top}/", f"file://{top}"):
        docs = C.read_document(spark, path)
        assert docs.inputFiles() == [] and rows(docs) == want
    assert rows(C.read_document(spark, top, 3)) == want
    for path in (os.path.join(top, "50%.txt"), os.path.join(tmp_dir, "a b/d/k*/*")):
        assert rows(C.read_document(spark, path)) == by_spark(path)


def test_read_document_query(spark, tmp_dir):
    """Every document's characters and lines, from files that the driver never lists."""
    from tokenmill.plans.q_io import q_read_document
    texts = [(1, "a\nb"), (-2, ""), (3, "é😀"), (None, "n\n"), (5, None)] + [(i, "x\n" * i) for i in range(10, 60)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(os.path.join(tmp_dir, "documents.parquet"))
    out = q_read_document(spark, tmp_dir)
    assert out.inputFiles() == []
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(
        [(i, len(t or ""), (t or "").count("\n") + 1) for i, t in texts], key=key)
