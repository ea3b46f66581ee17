"""The README's library flow, end to end on sf0.001."""

import os

from pyspark.sql import functions as F

from tokenmill.functions import wrap_truncate
from tokenmill.operators import batches, bleu, bpe, runs
from tokenmill.operators.batches import assign_split
from tokenmill.plans import fixtures as FX
from tokenmill.sources.corpus import corpus_flatten, read_pairs, shape_pairs, write_pairs

SF = "/root/testdata/sf0.001"


def test_readme_flow(spark, tmp_dir):
    path = os.path.join(tmp_dir, "corpus")
    write_pairs(shape_pairs(assign_split(FX.pairs(spark, SF), "pair_id")), path)
    pairs = read_pairs(spark, path, "en", "zh", split="train")
    vocab, merges = bpe.bpe_train(corpus_flatten(pairs), "text", vocab_size=120)
    assert vocab.count() <= 120 and merges.count() > 0
    enc = bpe.bpe_encode(pairs, "src", vocab, "src_raw")
    enc = bpe.bpe_encode(enc, "tgt", vocab, "tgt_raw")
    enc = enc.select("pair_id", wrap_truncate("src_raw", 128).alias("src_ids"),
                     wrap_truncate("tgt_raw", 128).alias("tgt_ids"))
    b = batches.shuffled_batches(enc, "pair_id", size=16, seed=1337, epoch=1)
    padded = batches.pad_batches(b, "batch", "src_ids", "tgt_ids").collect()
    assert padded and all(len(r.tgt_in_pad) == len(r.tgt_out_pad) for r in padded)
    per_batch = {}
    for r in padded:
        per_batch.setdefault(r.batch, set()).add(len(r.src_pad))
    assert all(len(v) == 1 for v in per_batch.values())
    hr = FX.hyp_ref(spark, SF)
    assert 0.0 < bleu.corpus_bleu(hr).first().bleu < 100.0
    ep = FX.epochs(spark, SF).select("run", "epoch", "val")
    assert runs.early_stop(ep, 5, 0.001).count() == ep.select("run").distinct().count()
    lb = runs.leaderboard(runs.parse_metrics(FX.log_lines(spark, SF)))
    assert [r["rank"] for r in lb.orderBy("rank").collect()] == list(range(1, lb.count() + 1))
