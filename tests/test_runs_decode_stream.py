"""Folds, decoding and streaming invariants."""

import os
import uuid

from pyspark.sql import functions as F

from tokenmill.operators import decode as D
from tokenmill.operators import runs as R


def epochs_df(spark):
    vals = {1: [5, 4, 4.5, 4.2, 3.0, 3.5, 3.6, 3.7, 3.8, 3.9, 2.0],
            2: [1.0, 0.9995, 0.9991, 0.999, 0.9989, 0.9, 0.95],
            3: [2.0]}
    rows = [(r, e + 1, float(v)) for r, vs in vals.items() for e, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run bigint, epoch bigint, val double")


def py_early(vs, patience, d):
    best, bad, be, stop = float("inf"), 0, None, None
    for e, v in enumerate(vs, 1):
        if v < best - d:
            best, bad, be = v, 0, e
        else:
            bad += 1
            if bad >= patience:
                stop = e
                break
    return best, be, stop


def test_early_stop_min_delta_and_chunks(spark):
    df = epochs_df(spark)
    for chunk in (2, 3, 4096):
        got = {r.run: (r.best, r.best_epoch, r.stop_epoch) for r in R.early_stop(df, 3, 0.001, chunk=chunk).collect()}
        vals = {}
        for r in df.collect():
            vals.setdefault(r.run, []).append((r.epoch, r.val))
        want = {k: py_early([v for _, v in sorted(x)], 3, 0.001) for k, x in vals.items()}
        assert got == want
        assert got[2] == (1.0, 1, 4)  # 0.999 is not < 1.0 - 0.001


def test_plateau_lr_chunks_agree(spark):
    df = epochs_df(spark)
    a = sorted(tuple(r) for r in R.plateau_lr(df, patience=1, chunk=3).collect())
    b = sorted(tuple(r) for r in R.plateau_lr(df, patience=1, chunk=1000).collect())
    assert a == b
    lr1 = [r.lr_after for r in sorted(R.plateau_lr(df, patience=1).where("run = 1").collect(), key=lambda r: r.epoch)]
    # bad epochs at 3,4 -> cut at 4; 6,7 -> cut at 7; 8,9 -> cut at 9
    assert lr1[3] == 2.5e-4 and lr1[6] == 1.25e-4 and lr1[8] == 6.25e-5


def test_parse_metrics_last_numeric_match(spark):
    lines = [(1, 1, "VAL loss: 3.5000, ppl=33.12"), (1, 2, "  TEST loss: 2.0, ppl=7.39 "), (1, 3, "VAL loss: nan, ppl=nan"),
             (1, 4, "VAL BLEU (full test set): 12.34"), (1, 5, "[RESULT] VAL loss=1.0"), (2, 1, "nothing")]
    df = spark.createDataFrame(lines, "run bigint, line_no bigint, line string")
    got = {r.run: (r.eval_loss, r.eval_ppl, r.eval_bleu) for r in R.parse_metrics(df).collect()}
    assert got == {1: (2.0, 7.39, 12.34), 2: (None, None, None)}


def test_grid_and_run_name(spark):
    g = R.grid_trials(spark.range(1).withColumnRenamed("id", "run")).orderBy("trial").collect()
    assert len(g) == 9 and g[1].overrides == {"training.lr": 5e-4, "training.weight_decay": 1e-3}
    df = spark.createDataFrame([("2024-01-02 03:04:05",)], "ts string").select(F.to_timestamp("ts").alias("ts"))
    name = df.select(R.run_name(F.lit("11"), F.create_map(F.lit("training.lr"), F.lit(3e-4)), F.col("ts"))).first()[0]
    assert name == R.RUN_NAME_PREFIX + "11_training-lr=3.0e-04_20240102-030405"


def bigram(spark):
    rows = [("x", "<s>", "a", -0.1), ("x", "<s>", "b", -2.0), ("x", "a", "b", -0.5), ("x", "a", "</s>", -0.9),
            ("x", "b", "</s>", -0.2), ("x", "b", "a", -1.7)]
    return spark.createDataFrame(rows, "lang string, prev string, nxt string, logp double")


def test_greedy_and_beam_one_agree(spark):
    s = spark.createDataFrame([(1, "x", ["<s>"])], "key bigint, lang string, seq array<string>")
    g = D.greedy_decode(s, bigram(spark), 10).first()
    assert g.seq == ["<s>", "a", "b", "</s>"] and abs(g.score - (-0.8)) < 1e-12
    b = D.beam_decode(s, bigram(spark), beam=1, max_len=10, alpha=0.0).first()
    assert b.seq == g.seq


def test_beam_prefers_normalised_score(spark):
    s = spark.createDataFrame([(1, "x", ["<s>"])], "key bigint, lang string, seq array<string>")
    b = D.beam_decode(s, bigram(spark), beam=2, max_len=5, alpha=0.6).first()
    assert b.seq == ["<s>", "a", "b", "</s>"]


def test_stream_early_stop_equals_batch(spark, tmp_dir):
    from tokenmill.streaming.early_stop_stream import early_stop_stream, latest_state
    df = epochs_df(spark)
    src = os.path.join(tmp_dir, "in")
    # later epochs first: the stream must still fold in epoch order
    df.where("epoch > 5").write.parquet(os.path.join(src, "part=0"))
    df.where("epoch <= 5").write.parquet(os.path.join(src, "part=1"))
    stream = spark.readStream.schema("run bigint, epoch bigint, val double").option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(tmp_dir, "out-" + uuid.uuid4().hex)
    q = early_stop_stream(stream, out, os.path.join(tmp_dir, "ck"), patience=3, min_delta=0.001)
    q.awaitTermination()
    got = {r.run: (r.best, r.best_epoch, r.stop_epoch) for r in latest_state(spark, out).collect()}
    want = {r.run: (r.best, r.best_epoch, r.stop_epoch) for r in R.early_stop(df, 3, 0.001).collect()}
    assert got == want


def py_plateau(vs, patience, lr=5e-4, factor=0.5, threshold=1e-4, eps=1e-8):
    best, bad, out = float("inf"), 0, []
    for v in vs:
        old = lr
        if v < best * (1 - threshold):
            best, bad = v, 0
        else:
            bad += 1
        if bad > patience:
            if lr - lr * factor > eps:
                lr *= factor
            bad = 0
        out.append((old, lr))
    return out


def test_folds_by_position(spark):
    """Gaps, zero-based and negative epoch numbers, NaN and negative values;
    every slice size gives the sequential answer."""
    import random
    random.seed(3)
    series, rows = {}, []
    for run in range(8):
        vs = [float("nan") if run == 2 and e < 4 else
              (random.random() * 5 - (4 if run > 5 else 0) if run % 2 else 9 - e * 0.05) for e in range(random.randint(1, 80))]
        names = [e * (1 + run % 3) - (run % 4) * 2 for e in range(len(vs))]
        series[run] = (names, vs)
        rows += [(run, n, v) for n, v in zip(names, vs)]
    df = spark.createDataFrame(rows, "run bigint, epoch bigint, val double")
    for chunk in (7, 1 << 18):
        got = {r.run: (r.best, r.best_epoch, r.stop_epoch, r.last_epoch) for r in R.early_stop(df, 3, 0.001, chunk=chunk).collect()}
        for run, (names, vs) in series.items():
            best, at, stop = py_early(vs, 3, 0.001)
            name = lambda e: None if e is None else names[e - 1]
            assert got[run] == (best, name(at), name(stop), name(stop or len(vs)))
        lrs = {(r.run, r.epoch): (r.lr_before, r.lr_after) for r in R.plateau_lr(df, patience=2, chunk=chunk).collect()}
        assert lrs == {(run, n): x for run, (names, vs) in series.items() for n, x in zip(names, py_plateau(vs, 2))}


def test_judged_epoch_cases(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 5, 0.5), (1, 9, 0.4), (2, 0, 1.0), (2, 1, 2.0), (2, 2, 3.0), (2, 3, 4.0)],
                               "run bigint, epoch bigint, val double")
    got = {r.run: tuple(r)[1:] for r in R.early_stop(df, 3, 0.001).collect()}
    assert got == {1: (0.4, 9, None, 9), 2: (1.0, 0, 3, 3)}
    assert R.plateau_lr(df).count() == 7 and R.early_stop(df.limit(0)).count() == 0


def test_run_analytics_cases(spark):
    lines = spark.createDataFrame([(1, 1, "\tVAL loss: 2.5, ppl=12.1"), (1, 2, "\rEpoch [3/50] ┃ train_loss: 1.5000 ┃ val_loss: 1.2500 ┃ lr: 0.000500"),
                                   (1, 3, "Improved! best_val=1.2 (saved)"), (1, 4, "No improvement (2/5)"),
                                   (1, 5, "Early stopping triggered."), (1, 6, "Epoch 4: train=1.0, val=nan, lr=0.0005"),
                                   (1, 7, "  >> no improvement (1/5)"), (1, 8, "other")], "run bigint, line_no bigint, line string")
    assert R.parse_metrics(lines).first().eval_loss == 2.5
    got = [tuple(r)[1:] for r in R.parse_epochs(lines, events=True).orderBy("line_no").collect()]
    assert [g[1] for g in got] == ["epoch", "improved", "no_improvement", "stopped", "epoch", "no_improvement"]
    assert got[0][2:6] == (3, 1.5, 1.25, 0.0005) and got[2][6:] == (2, 5) and got[5][6:] == (1, 5)
    cfg = R.base_configs(spark.range(1).withColumnRenamed("id", "run"))
    one = R.apply_overrides(cfg.withColumn("overrides", F.create_map(F.lit("training.lr"), F.lit(0.000345678912345))))
    assert float(one.first().config["training.lr"]) == 0.000345678912345
    mixed = F.create_map(F.lit("a.b"), F.lit("3"), F.lit("c"), F.lit("3e-4"), F.lit("d"), F.lit("adam"))
    ts = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    assert spark.range(1).select(R.run_name(F.lit("x"), mixed, ts, floats=False)).first()[0].endswith(
        "x_a-b=3_c=3.0e-04_d=adam_20240102-030405")
    m = spark.createDataFrame([(1, "t", 0, None), (1, "t", 1, 3.0), (1, "t", 2, float("nan"))], "run bigint, tag string, step bigint, value double")
    r = R.metric_series(m).first()
    assert (r.n_points, r.best, r.best_step) == (3, 3.0, 1)
    v = spark.createDataFrame([(10, 0, "a", 0), (11, 1, "a", 1), (12, 0, "a", 2), (20, 0, "b", 0)], "run bigint, returncode int, batch string, pos int")
    assert {r.run: r.status for r in R.variant_report(v).collect()} == {10: "ok", 11: "failed", 12: "skipped", 20: "ok"}


def test_metrics_of_any_run_and_bucket_count(spark, tmp_dir):
    from tokenmill.sources import logs
    rows = [(f"run{i}", "t", s, float(s)) for i in range(20) for s in range(3)]
    df = spark.createDataFrame(rows, "run string, tag string, step bigint, value double")
    logs.append_metrics(df, f"{tmp_dir}/m", buckets=8)
    assert all(logs.read_metrics(spark, f"{tmp_dir}/m", f"run{i}").count() == 3 for i in range(20))


def test_decoding_keeps_every_key(spark):
    """States without successors, separators inside tokens and null contexts: one
    row per key, whichever way the table travels."""
    rows = [(1, "x", ["<s>"]), (2, "x", ["nowhere"]), (3, "y", ["<s>"]), (4, None, ["<s>"]), (5, "x", ["z\u0002a"]),
            (6, "x", ["z", "a"]), (7, "x", ["<s>"])]
    s = spark.createDataFrame(rows, "key bigint, lang string, seq array<string>")
    for limit in (0, D.BROADCAST_BYTES):
        b = {r.key: r for r in D.beam_decode(s, bigram(spark), 3, 6, broadcast_bytes=limit).collect()}
        g = {r.key: r for r in D.greedy_decode(s, bigram(spark), 6, broadcast_bytes=limit).collect()}
        assert set(b) == set(g) == set(range(1, 8))
        for k in (2, 3, 4, 5):
            assert list(b[k].seq) == list(g[k].seq) == rows[k - 1][2]
        assert list(g[6].seq) == ["z", "a", "b", "</s>"] and list(g[1].seq) == list(g[7].seq) == ["<s>", "a", "b", "</s>"]
    a, c = (sorted((r.key, list(r.seq), r.norm) for r in D.beam_decode(s, bigram(spark), 3, 6, broadcast_bytes=x).collect())
            for x in (0, D.BROADCAST_BYTES))
    assert a == c


def test_generation_is_the_same_either_way(spark):
    s = spark.createDataFrame([(k, "x", ["<s>"]) for k in range(30)] + [(99, "x", ["q"]), (98, "w", ["<s>"])],
                              "key bigint, lang string, seq array<string>")
    a, b = (sorted((r.key, list(r.seq)) for r in D.generate(s, bigram(spark), 5, broadcast_bytes=x).collect())
            for x in (0, D.BROADCAST_BYTES))
    assert a == b and len(a) == 32 and dict(a)[99] == ["q"] and len({tuple(x) for _, x in a}) > 3


def test_a_round_reads_its_slice_only(spark):
    """Rows read over all rounds grow with the rows, not with rounds x rows."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, e, 1.0 / (e + 1)) for e in range(100)] + [(2, 0, 1.0)], "run long, epoch long, val double").repartition(4)
    ranked = R._ranked(df, 10)
    part = ranked.where(F.col("slice") == 3)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan and "= 3" in plan
    assert all("slice=3/" in r[0] for r in part.select(F.input_file_name()).collect()) and part.count() == 10
    assert sum(ranked.where(F.col("slice") == k).count() for k in range(10)) == 101
    got = {r.run: r.last_epoch for r in R.early_stop(df, 3, 0.001, chunk=10).collect()}
    assert got == {1: max(e for e in got.values()), 2: 0} and got[1] == {r.run: r.last_epoch for r in R.early_stop(df, 3, 0.001).collect()}[1]


def test_generation_makes_no_draws_in_rows(spark):
    """The draws are made beside the steps, not sent as a list a row; any key type, a
    null key included, gives what the joins give."""
    df = spark.createDataFrame([(k, lang, ["a"] if lang else None) for k in ("x", "y:1", None) for lang in ("l", "m", None)],
                               "key string, lang string, seq array<string>")
    scores = spark.createDataFrame([(lang, a, b, -0.1 * i) for lang in ("l", "m") for a in "abc" for i, b in enumerate("cab")],
                                   "lang string, prev string, nxt string, logp double")
    small = D.generate(df, scores, 6)
    assert "array<double>" not in small._jdf.queryExecution().analyzed().toString() and "_u#" not in small._jdf.queryExecution().analyzed().toString()
    a, b = (sorted(((r.key, r.lang, r.seq) for r in got.collect()), key=repr)
            for got in (small, D.generate(df, scores, 6, broadcast_bytes=0)))
    assert a == b and {len(r[2]) for r in a if r[1]} == {7}
    assert all(r[2] is None for r in a if r[1] is None) and len(a) == 9
