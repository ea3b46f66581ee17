"""Physical-plan properties that matter at scale (checked on sf0.001)."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SAMPLE = ["word_freq", "bpe_pair_counts", "corpus_bleu", "ngram_counts", "batch_stats", "leaderboard", "greedy_decode",
          "beam_decode", "generate_text", "early_stop", "plateau_lr", "chunk_windows", "corpus_windows", "char_coverage",
          "metric_series", "parse_metrics", "pad_batches", "prefix_diff", "grid_trials", "apply_overrides"]


def plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p


def test_text_scan_is_pruned(spark):
    p = plan(spark, "word_freq")
    assert "ReadSchema: struct<text:string>" in p


def test_counts_combine_map_side(spark):
    for name in ["word_freq", "corpus_bleu", "metric_series", "parse_metrics"]:
        assert "partial_" in plan(spark, name), name


def test_index_offsets_are_broadcast(spark):
    p = plan(spark, "sequential_batches")
    assert "BroadcastHashJoin" in p


def test_bleu_is_counted_in_the_row(spark):
    """Given the pairs, counts and clipped matches need no exchange and the
    corpus score one, for the final sum."""
    from tokenmill.operators import bleu as BL
    df = spark.createDataFrame([(1, "a b a", "a b")], "pair_id long, hyp string, ref string")
    for out, exchanges in ((BL.ngram_counts(df), 0), (BL.clipped_rows(df), 0), (BL.corpus_bleu(df), 1)):
        p = out._jdf.queryExecution().executedPlan().toString()
        assert p.count("Exchange") == exchanges, p
