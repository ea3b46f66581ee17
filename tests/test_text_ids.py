"""Text projections and id-array expressions on hand-made rows (T*, E*)."""

from pyspark.sql import functions as F

from tokenmill.functions import (
    char_tokens, clean_ids, cut_between_markers, flatten_newlines, pad_mask, strip_text, tail_window,
    teacher_shift, wrap_pad_fixed, wrap_truncate,
)


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_flatten_newlines(spark):
    assert one(spark, flatten_newlines("x"), "a\nb\n\nc\r") == "a b  c\r"


def test_strip_unicode_whitespace(spark):
    assert one(spark, strip_text("x"), "　 \t hello world \n") == "hello world"
    assert one(spark, strip_text("x"), None) == ""
    assert one(spark, strip_text("x"), "   ") == ""


def test_cut_between_markers(spark):
    t = "junk *** START OF X ***\nbody text\n*** END OF X *** tail"
    assert one(spark, cut_between_markers("x"), t) == " OF X ***\nbody text\n"
    assert one(spark, cut_between_markers("x"), "no markers") == "no markers"
    # between the first and second START
    assert one(spark, cut_between_markers("x"), "a*** STARTb*** STARTc") == "b"
    assert one(spark, cut_between_markers("x"), "a *** END b") == "a "


def test_char_tokens_code_points(spark):
    assert one(spark, char_tokens("x"), "a中😀") == ["a", "中", "😀"]
    assert one(spark, char_tokens("x"), "") == []


def test_wrap_truncate_keeps_eos(spark):
    ids = list(range(10, 20))
    assert one(spark, wrap_truncate("x", 5), ids, "x array<bigint>") == [1, 10, 11, 12, 2]
    assert one(spark, wrap_truncate("x", 2), ids, "x array<bigint>") == [1, 2]
    assert one(spark, wrap_truncate("x", 128), [], "x array<bigint>") == [1, 2]


def test_wrap_pad_fixed_loses_eos(spark):
    ids = list(range(10, 20))
    assert one(spark, wrap_pad_fixed("x", 5), ids, "x array<bigint>") == [1, 10, 11, 12, 13]
    assert one(spark, wrap_pad_fixed("x", 6), [7], "x array<bigint>") == [1, 7, 2, 0, 0, 0]


def test_teacher_shift(spark):
    df = spark.createDataFrame([([1, 5, 6, 2],), ([1],), ([],)], "x array<bigint>")
    a, b = teacher_shift("x")
    rows = df.select(a.alias("a"), b.alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [([1, 5, 6], [5, 6, 2]), ([], []), ([], [])]


def test_clean_ids_order_of_rules(spark):
    # skip pad, stop at first eos, skip bos
    assert one(spark, clean_ids("x"), [0, 1, 5, 0, 6, 1, 2, 7, 2], "x array<bigint>") == [5, 6]
    assert one(spark, clean_ids("x"), [2, 5], "x array<bigint>") == []
    assert one(spark, clean_ids("x"), [5, 6], "x array<bigint>") == [5, 6]


def test_pad_mask_and_tail_window(spark):
    assert one(spark, pad_mask("x"), [3, 0, 4, 0], "x array<bigint>") == [False, True, False, True]
    assert one(spark, tail_window("x", 4, 9), [1, 2], "x array<bigint>") == [9, 9, 1, 2]
    assert one(spark, tail_window("x", 2, 9), [1, 2, 3], "x array<bigint>") == [2, 3]


def test_char_encode_unknown_is_error(spark):
    import pytest
    from tokenmill.operators import vocab as V
    v = spark.createDataFrame([(0, "a"), (1, "b")], "id bigint, token string")
    df = spark.createDataFrame([("ab",), ("abc",)], "text string")
    with pytest.raises(Exception):
        V.char_encode(df, "text", v).collect()
    ok = V.char_encode(df, "text", v, on_unknown="unk", unk_id=3).orderBy("text").collect()
    assert [r.ids for r in ok] == [[0, 1], [0, 1, 3]]
