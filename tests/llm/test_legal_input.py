"""Input that is legal and odd: hot keys, clashing and quoted names, huge values,
runs of white space, workers without the package."""

import os
import subprocess
import sys
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import langid, packing, simhash, sp_codec, topk_threshold, toxicity
from tokenmill.llm.common import BYTE_BPE, free_name, sample_rows

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
EN = "the quick brown fox and the lazy dog were walking through the town with other animals"
DE = "der schnelle braune Fuchs und der faule Hund gingen mit anderen Tieren durch die Stadt"
ODD = "doc_id long, text string, lang string, `__row` long, `__score` string, `__lang` int, `__fp` int, row int, fp int, score int, " \
      "lang_pred int, worked int, `a b` struct<`x y`:int,`z-1`:string>, `a.b` int"


def odd_rows(rows):
    return [(i, t, lang, 7, "s", 1, 2, 3, 4, 5, 6, 7, (1, "z"), 9) for i, t, lang in rows]


def test_free_name():
    assert free_name(["a", "Worked", "_worked"], "worked") == "__worked"


def test_sample_is_by_row_and_bounded(spark):
    rows = [(1, "x", f"same {i % 3}") for i in range(900)] + [(i, "y", "t") for i in range(60)] + [(None, "x", None)] * 50
    df = spark.createDataFrame(rows, "k long, g string, t string").repartition(6)
    n = {r.g: r["count"] for r in sample_rows(df, "g", 100, ("k", "t")).groupBy("g").count().collect()}
    assert n == {"x": 100, "y": 60}


def test_a_language_under_one_key(spark):
    rows = [(4, f"{DE} {i % 50}", "de") for i in range(1500)] + [(i, f"{EN} {i % 40}", "en") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang", fit_rows=50)
    assert model["languages"] == ["de", "en"]
    got = langid.predict(df, model).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"de": 1500, "en": 1500}


def test_text_of_marks_only(spark):
    df = spark.createDataFrame([(i, EN, "en") for i in range(20)] + [(90, "́̂ ̈", None), (91, "é", None)],
                               "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(df).collect()}
    assert got[90] == ("und", 0.0) and got[91][0] == "en"


def test_stages_keep_every_column(spark):
    rows = [(i, f"{EN} {'abcdefgh'[i % 8] * (i % 40)}", "en") for i in range(60)] + [(None, None, None), (2, "", "en")]
    df = spark.createDataFrame(odd_rows(rows), ODD)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    for out in (langid.keep_recognised(df), simhash.one_per_group(df), toxicity.keep_clean(df, labels)):
        assert out.schema == df.schema
        kept = out.collect()
        assert kept and {tuple(r) for r in kept} <= {tuple(r) for r in df.collect()}
    enc = sp_codec.encode(df, check=True)
    assert enc.columns == df.columns + ["ids", "round_trip"] and enc.count() == 62
    assert sp_codec.decode(enc.drop("round_trip"), out="back").where("back <> text").count() == 0
    assert simhash.with_fingerprints(df, "text", 3, "out").count() == 62


def test_round_trip_is_of_the_raw_text(spark):
    df = spark.createDataFrame([(1, "a▁b"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.round_trip for r in sp_codec.encode(df, check=True).collect()} == {1: False, 2: True, 3: None}


def test_huge_components_and_many_query_blocks(spark):
    big = 1.7e308
    rows = [(0, [big, 1.0]), (100, [1.0, -big]), (1, [big, big]), (2, [-1.0, 0.5]), (3, [1e306, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk_threshold.top_k(df, df.where("vec_id % 100 = 0")).collect()}
    assert got[0, 1] == got[0, 3] == 2**63 - 1 and got[0, 2] == got[100, 1] == -2**63
    # block numbers come from monotonically_increasing_id: partition 1024 starts at 2^43
    many = spark.createDataFrame([(i * 100, [float(i % 7)]) for i in range(200)], "vec_id long, embedding array<double>")
    far = F.monotonically_increasing_id
    try:
        topk_threshold.F.monotonically_increasing_id = lambda: far() + F.lit(1 << 62)
        assert topk_threshold.top_k(many, many, block=64).count() == 2000
    finally:
        topk_threshold.F.monotonically_increasing_id = far


def test_runs_of_white_space(spark):
    enc = packing.encoder(open(BYTE_BPE, "rb").read())
    for text in ("a" + " " * 20_000 + "b", "\n" * 15_000, " " * 12_000 + "\n" + "x  y", "x" + "\t \n" * 9_000 + " y" + " " * 30_000 + "\n"):
        assert packing.text_ids(enc, text).tolist() == enc.encode_ordinary(text)
    df = spark.createDataFrame([(1, " " * 1_200_000 + "x"), (2, "a" + "\n" * 1_200_000)], "doc_id long, text string")
    assert packing.pack(df).selectExpr("sum(n_tokens)").first()[0] > 1000


@pytest.mark.parametrize("room, end, kind", [(70_000, packing.END_ID, np.uint32), (64, 7, np.uint16)])
def test_width_of_ids_and_positions(spark, room, end, kind):
    df = spark.createDataFrame([(1, "word " * 69_000)], "doc_id long, text string")
    r = packing.pack(df, room=room, end_id=end).orderBy("row").first()
    pos = np.frombuffer(r.position_ids, kind)
    assert len(pos) == room and (pos[:r.n_tokens] == np.arange(r.n_tokens)).all()


def test_workers_without_the_package(tmp_dir):
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local-cluster[1,2,1200]").config("spark.ui.enabled", "false") \\
            .config("spark.executor.memory", "1200m").config("spark.checkpoint.dir", "file://{tmp_dir}/shared").getOrCreate()
        spark.sparkContext.setCheckpointDir("file://{tmp_dir}/shared")
        from tokenmill.llm import langid, toxicity
        df = spark.createDataFrame([(i, {EN!r} + (" vile" if i % 2 else ""), "en") for i in range(90)], "doc_id long, text string, lang string")
        labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")
        print("ROWS", langid.language_id(df).count(), toxicity.toxicity(df, labels).count())
        spark.stop()
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 90 90" in got.stdout, got.stderr[-2000:]
