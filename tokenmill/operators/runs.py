"""Experiment analytics (X1-X11, L7): search spaces, run names, log mining,
leaderboards, early stopping and learning-rate replay.

Early stopping and the plateau scheduler are sequential state machines per
run. They run as folds over bounded slices of each run's epochs, by position:
each round hands every live run its next slice, carries the small state
``(best, bad, ...)`` on, and drops runs that have finished, so no task ever
holds an unbounded group and all runs proceed in parallel. Every run takes the
same path, whatever its length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import strip_text, uniform_hash
from tokenmill.operators.indexing import sequence_index
from tokenmill.session import checkpoint_dir, cut_lineage

# The translation config (training + dataset sections), the
# search grid, the random search space and the forced search budget.
BASE_CONFIG = {
    "training.seed": "1337", "training.batch_size": "16", "training.num_epochs": "50",
    "training.lr": "5e-4", "training.weight_decay": "1e-3", "training.grad_clip": "1.0",
    "training.patience_epochs": "5", "training.num_workers": "4", "training.min_delta": "0.001",
    "dataset.vocab_size": "8000", "dataset.max_src_len": "128", "dataset.max_tgt_len": "128",
    "model.num_blocks": "4", "model.embedding_dim": "256", "model.dropout": "0.1",
}
GRID = {"training.lr": [5e-4, 3e-4, 1e-4], "training.weight_decay": [1e-2, 1e-3, 1e-4]}
RANDOM_SPACE = {
    "training.lr": {"type": "loguniform", "low": 3e-4, "high": 1.5e-3},
    "training.weight_decay": {"type": "loguniform", "low": 1e-4, "high": 2e-2},
}
SEARCH_BUDGET = {"training.num_epochs": "6", "training.patience_epochs": "1"}
RUN_NAME_PREFIX = "xlstm"
VARIANTS = ["10", "01", "11"]


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in (kv[0], str(kv[1]))])


def set_keys(cfg: Column, overrides: Column) -> Column:
    """Dotted-key override: keys of ``overrides`` replace or create entries."""
    kept = F.map_filter(cfg, lambda k, v: ~F.array_contains(F.map_keys(overrides), k))
    return F.map_concat(kept, overrides)


def apply_overrides(df: DataFrame, cfg: str = "config", overrides: str = "overrides") -> DataFrame:
    """Overrides first, then the search budget, which therefore wins. Values
    are kept as they are (numbers as their shortest exact text)."""
    ov = F.transform_values(overrides, lambda k, v: v.cast("string"))
    return df.withColumn(cfg, set_keys(set_keys(F.col(cfg), ov), _lit_map(SEARCH_BUDGET)))


def base_configs(runs: DataFrame, run: str = "run") -> DataFrame:
    return runs.select(run, _lit_map(BASE_CONFIG).alias("config"))


def grid_trials(df: DataFrame, grid: dict | None = None) -> DataFrame:
    """Cartesian product of the grid's value lists per input row, in
    product order (first key slowest), by successive explodes."""
    grid = grid or GRID
    out = df
    pos_cols = []
    for i, (k, vals) in enumerate(grid.items()):
        out = out.select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in vals])).alias(f"_p{i}", f"_v{i}"))
        pos_cols.append((f"_p{i}", len(vals)))
    trial = F.lit(0)
    for p, n in pos_cols:
        trial = trial * n + F.col(p)
    ov = F.create_map(*[x for i, k in enumerate(grid) for x in (F.lit(k), F.col(f"_v{i}"))])
    res = out.withColumn("trial", trial.cast("bigint")).withColumn("overrides", ov)
    return res.drop(*[c for c in res.columns if c.startswith("_p") or c.startswith("_v")])


def random_trials(df: DataFrame, key: str, space: dict | None = None, seed: int = 1337) -> DataFrame:
    """One seeded draw per input row and parameter: loguniform =
    exp(ln lo + (ln hi - ln lo) * u), choice = values[floor(u * n)]."""
    import math
    space = space or RANDOM_SPACE
    parts = []
    kinds = {type(x) for spec in space.values() if spec["type"] == "choice" for x in spec["values"]}
    as_text = bool(kinds - {float})  # ints and strings keep their own form; floats print exactly
    for name, spec in space.items():
        u = uniform_hash(seed, key, F.lit(name))
        if spec["type"] == "loguniform":
            lo, hi = math.log(spec["low"]), math.log(spec["high"])
            v = F.exp(F.lit(lo) + F.lit(hi - lo) * u)
        elif spec["type"] == "choice":
            vals = F.array(*[F.lit(x) for x in spec["values"]])
            v = F.element_at(vals, (F.floor(u * len(spec["values"])) + 1).cast("int"))
        else:
            raise ValueError(f"unknown space type: {spec}")
        parts += [F.lit(name), v.cast("string") if as_text else v]
    return df.withColumn("overrides", F.create_map(*parts))


def run_name(variant: Column, overrides: Column, ts: Column, prefix: str = RUN_NAME_PREFIX,
             floats: bool = True) -> Column:
    """Prefix + variant + '_' + sorted key=value (dots -> dashes) joined by
    '_' + '_' + timestamp %Y%m%d-%H%M%S. ``floats``: the map holds floating-point
    values, printed as %.1e; otherwise ints and strings are printed as they are,
    and in a map of texts only those with a fraction or exponent are floats."""
    ents = F.array_sort(F.map_entries(overrides))

    def shown(v):
        if floats:
            return F.format_string("%.1e", v)
        text = v.cast("string")
        return F.when(text.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][+-]?[0-9]+)?$"),
                      F.format_string("%.1e", text.try_cast("double"))).otherwise(text)
    parts = F.transform(ents, lambda e: F.concat(F.translate(e["key"], ".", "-"), F.lit("="), shown(e["value"])))
    return F.concat(F.lit(prefix), variant, F.lit("_"), F.array_join(parts, "_"), F.lit("_"),
                    F.date_format(ts, "yyyyMMdd-HHmmss"))


# ------------------------------------------------------------------ log mining
# The line formats the trainers print.
_LOSS_RE = r"loss:\s*([0-9.]+),\s*ppl=([0-9.]+)"
_BLEU_RE = r"BLEU.*?:\s*([0-9.]+)"


def parse_metrics(lines: DataFrame, run: str = "run", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Last matching VAL/TEST loss line gives loss and ppl, last matching
    VAL/TEST BLEU line gives bleu; nan/inf do not match -> null."""
    s = strip_text(line)
    is_loss = (s.startswith("VAL loss:") | s.startswith("TEST loss:")) & s.rlike(_LOSS_RE)
    is_bleu = (s.startswith("VAL BLEU") | s.startswith("TEST BLEU")) & s.rlike(_BLEU_RE)
    lo = F.regexp_extract(s, _LOSS_RE, 1).try_cast("double")
    pp = F.regexp_extract(s, _LOSS_RE, 2).try_cast("double")
    bl = F.regexp_extract(s, _BLEU_RE, 1).try_cast("double")
    o_loss = F.when(is_loss, F.col(line_no))
    o_bleu = F.when(is_bleu, F.col(line_no))
    return lines.groupBy(run).agg(
        F.max_by(lo, o_loss).alias("eval_loss"), F.max_by(pp, o_loss).alias("eval_ppl"),
        F.max_by(bl, o_bleu).alias("eval_bleu"))


# The epoch and verdict lines the trainers print.
_EPOCH_RE = r"^Epoch (\d+): train=([^,]+), val=([^,]+), lr=(\S+)$"
_CHAR_EPOCH_RE = r"^Epoch \[(\d+)/(\d+)\] ┃ train_loss: (\S+) ┃ val_loss: (\S+) ┃ lr: (\S+)$"
_WORSE_RE = r"^(?:>> no improvement|No improvement) ?\((\d+)/(\d+)\).*$"


def epoch_lines(epochs: DataFrame) -> DataFrame:
    """Lines as the trainers print them (producer side of X6), by epoch: both
    epoch formats, the improvement verdicts and the stop."""
    lr = F.lit(5e-4) * F.pow(F.lit(0.5), F.least(F.expr("epoch div 10"), F.lit(5)))
    val, train = F.col("val") / 100.0, (F.col("val") + 1.0) / 100.0
    kind = F.pmod(F.col("epoch"), F.lit(6))
    line = (F.when(kind == 1, F.format_string("\rEpoch [%d/50] ┃ train_loss: %.4f ┃ val_loss: %.4f ┃ lr: %.6f",
                                              F.col("epoch"), train, val, lr))
            .when(kind == 2, F.lit("  >> improved, saved checkpoint at x.pt"))
            .when(kind == 3, F.concat(F.lit("\t>> no improvement ("), F.pmod(F.col("epoch"), F.lit(5)).cast("string"), F.lit("/5)")))
            .when(kind == 4, F.lit("Early stopping."))
            .otherwise(F.format_string("Epoch %d: train=%.4f, val=%.4f, lr=%.6e", F.col("epoch"), train, val, lr)))
    return epochs.select("run", F.col("epoch").alias("line_no"), line.alias("line"))


def parse_epochs(lines: DataFrame, line: str = "line", events: bool = False) -> DataFrame:
    """The epoch lines of both trainers -> (run, epoch, train, val, lr);
    other lines drop out. With ``events`` also the lines that report improvement,
    a bad epoch (count and patience) or the stop, and a ``kind`` column: epoch,
    improved, no_improvement, stopped. NaN and unreadable numbers are null resp.
    NaN as written."""
    s = strip_text(line)
    a, c = s.rlike(_EPOCH_RE), s.rlike(_CHAR_EPOCH_RE)
    kind = (F.when(a | c, "epoch").when(s.startswith(">> improved") | s.startswith("Improved!"), "improved")
            .when(s.rlike(_WORSE_RE), "no_improvement").when(s.startswith("Early stopping"), "stopped"))

    def num(pattern, n, kind_="double"):
        return F.regexp_extract(s, pattern, n).try_cast(kind_)
    cols = [F.when(a, num(_EPOCH_RE, 1, "bigint")).when(c, num(_CHAR_EPOCH_RE, 1, "bigint")).alias("epoch"),
            F.when(a, num(_EPOCH_RE, 2)).when(c, num(_CHAR_EPOCH_RE, 3)).alias("train"),
            F.when(a, num(_EPOCH_RE, 3)).when(c, num(_CHAR_EPOCH_RE, 4)).alias("val"),
            F.when(a, num(_EPOCH_RE, 4)).when(c, num(_CHAR_EPOCH_RE, 5)).alias("lr")]
    if not events:
        return lines.where(a | c).select("run", *cols)
    bad = s.rlike(_WORSE_RE)
    rest = [F.when(bad, num(_WORSE_RE, 1, "bigint")).alias("bad"), F.when(bad, num(_WORSE_RE, 2, "bigint")).alias("patience")]
    extra = ["line_no"] if "line_no" in lines.columns else []
    return lines.where(kind.isNotNull()).select("run", *extra, kind.alias("kind"), *cols, *rest)


def leaderboard(results: DataFrame, loss: str = "eval_loss", tiebreak: str = "run") -> DataFrame:
    """Every run, failed ones too, by loss ascending, missing (or NaN) last.
    The rank is an exact global index without a single-partition window."""
    r = results.withColumn(loss, F.when(F.isnan(loss), None).otherwise(F.col(loss)))
    r = r.withColumn("_missing", F.col(loss).isNull().cast("int"))
    return sequence_index(r, ["_missing", loss, tiebreak], name="rank", start=1).drop("_missing")


def variant_report(results: DataFrame, run: str = "run", rc: str = "returncode", batch: str = "batch",
                   order: str = "pos") -> DataFrame:
    """The runs of a ``batch`` are variants launched in ``order``; the first
    non-zero return code ends its batch, later variants are skipped. The first
    failing position per batch is one aggregate, joined back, so a batch of any
    size never sits in one task. The n-th run of a batch is the n-th variant
    (repeating); ``order`` counts from 0."""
    first = results.where(F.col(rc) != 0).groupBy(batch).agg(F.min(order).alias("_bad"))
    b = results.select(run, rc, batch, order).join(first, batch, "left")
    status = F.when(F.col(order) > F.col("_bad"), "skipped").when(F.col(rc) != 0, "failed").otherwise("ok")
    variant = F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), (F.pmod(F.col(order), F.lit(len(VARIANTS))) + 1).cast("int"))
    return b.select(run, batch, variant.alias("variant"), status.alias("status"))


def metric_series(metrics: DataFrame) -> DataFrame:
    """X11: per run and tag: points, latest value by step, best (lowest) value
    and the first step reaching it. Null and NaN values are points but never
    the best. Partial aggregation, no group collection."""
    real = F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))
    return metrics.groupBy("run", "tag").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.max_by("value", "step").alias("latest"),
        F.max("step").alias("last_step"),
        F.min(F.when(real, F.struct("value", "step"))).alias("_b")).select(
        "run", "tag", "n_points", "latest", "last_step", F.col("_b.value").alias("best"),
        F.col("_b.step").alias("best_step"))


def epoch_summary(steps: DataFrame, vals: DataFrame) -> DataFrame:
    """Per (run, epoch) token-weighted train loss joined with val loss and,
    if ``vals`` has it, the epoch's lr."""
    tr = steps.groupBy("run", "epoch").agg(
        (F.sum("loss_sum") / F.greatest(F.sum("ntok"), F.lit(1))).alias("train_loss"),
        F.count(F.lit(1)).alias("n_steps"))
    lr = [F.max("lr").alias("lr")] if "lr" in vals.columns else []
    va = vals.groupBy("run", "epoch").agg(F.avg("val_loss").alias("val_loss"), *lr)
    return tr.join(va, ["run", "epoch"], "left")


# ------------------------------------------------------------------ folds
SLICE_EPOCHS = 1 << 18  # epochs of one run that a task folds at a time


def _ranked(epochs: DataFrame, chunk: int) -> DataFrame:
    """(run, pos, epoch, val, slice): ``pos`` = 1-based order of the run's epochs,
    ``slice`` the run's slice of ``chunk`` epochs it lies in. Epoch numbers may have
    gaps, start anywhere and be negative; the folds count rows, so they work on
    positions and report epoch numbers. The rows are stored by slice in the shared
    folder: a round that filters on its slice reads that folder only."""
    e = sequence_index(epochs.select("run", "epoch", "val"), ["epoch", "val"], ["run"], name="pos", start=1)
    e = e.select("run", "pos", "epoch", "val", F.floor((F.col("pos") - 1) / chunk).cast("int").alias("slice"))
    spark = epochs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/epochs-{uuid.uuid4()}"
    e.write.partitionBy("slice").parquet(path)
    return spark.read.schema(e.schema).parquet(path)


def _fold_rounds(epochs: DataFrame, init: DataFrame, step_fn, state, chunk: int, stopped=None):
    """Every run, whatever its length, is folded in slices of ``chunk`` epochs:
    a round hands each live run its next slice and carries the small state on.
    Returns the list of round results (state columns plus what ``step_fn`` adds)."""
    ranked = _ranked(epochs, chunk)
    live = ranked.groupBy("run").agg(F.max("pos").alias("n"), F.max_by("epoch", "pos").alias("last")) \
        .select("run", "n", "last", *[v.alias(k) for k, v in init.items()])
    done, lo = [], 0
    while True:
        part = ranked.where(F.col("slice") == lo // chunk).select("run", "pos", "epoch", "val")
        if lo:
            part = part.join(live.select("run"), "run", "left_semi")
        g = part.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("pos", "epoch", "val"))).alias("xs"))
        st = cut_lineage(step_fn(live.join(g, "run")))
        over = F.col("n") <= lo + chunk
        if stopped is not None:
            over = over | stopped
        done.append((st, over))
        live = st.where(~over).select("run", "n", "last", *state)
        if live.isEmpty():
            return done
        lo += chunk


def early_stop(epochs: DataFrame, patience: int = 5, min_delta: float = 0.001, chunk: int = SLICE_EPOCHS) -> DataFrame:
    """Improvement when val < best - min_delta (best <- val, counter 0),
    else counter + 1; stop when the counter reaches patience. Per run: best,
    best epoch, stop epoch (null if never stopped) and last epoch seen. A null
    or NaN value is no improvement."""
    none = F.lit(None).cast("bigint")
    init = {"best": F.lit(float("inf")), "bad": F.lit(0), "best_epoch": none, "stop_epoch": none}

    def step(st):
        s0 = F.struct(*[F.col(k).alias(k) for k in init])

        def merge(s, x):
            better = F.coalesce(x["val"] < s["best"] - F.lit(float(min_delta)), F.lit(False))
            stop = F.when(s["bad"] + 1 >= patience, x["epoch"].cast("bigint"))
            return F.when(s["stop_epoch"].isNotNull(), s).when(better, F.struct(
                x["val"].alias("best"), F.lit(0).alias("bad"), x["epoch"].cast("bigint").alias("best_epoch"),
                none.alias("stop_epoch"))).otherwise(F.struct(
                    s["best"].alias("best"), (s["bad"] + 1).alias("bad"), s["best_epoch"].alias("best_epoch"),
                    stop.alias("stop_epoch")))
        r = F.aggregate("xs", s0, merge)
        return st.select("run", "n", "last", r.alias("r")).select("run", "n", "last", *[F.col("r")[k].alias(k) for k in init])

    out = None
    for st, over in _fold_rounds(epochs, init, step, list(init), chunk, F.col("stop_epoch").isNotNull()):
        part = st.where(over)
        out = part if out is None else out.unionByName(part)
    return out.select("run", "best", "best_epoch", "stop_epoch", F.coalesce("stop_epoch", "last").alias("last_epoch"))


def _plateau_slices(batches, factor, patience, threshold, min_lr, eps):
    """Replays the scheduler over each run's slice; one output row per run with
    the new state and the lr before and after every epoch."""
    import pyarrow as pa
    for b in batches:
        best, bad, lr = (b.column(c).to_pylist() for c in ("best", "bad", "lr"))
        before, after = [], []
        for i, xs in enumerate(b.column("vals").to_pylist()):
            m, k, cur, pre, post = best[i], bad[i], lr[i], [], []
            for v in xs:
                pre.append(cur)
                if v is not None and v < m * (1.0 - threshold):
                    m, k = v, 0
                else:
                    k += 1
                if k > patience:
                    new = max(cur * factor, min_lr)
                    cur, k = (new if cur - new > eps else cur), 0
                post.append(cur)
            best[i], bad[i], lr[i] = m, k, cur
            before.append(pre)
            after.append(post)
        doubles = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("run", "n", "last", "epochs")], pa.array(best, pa.float64()), pa.array(bad, pa.int32()),
             pa.array(lr, pa.float64()), pa.array(before, doubles), pa.array(after, doubles)],
            names=["run", "n", "last", "epochs", "best", "bad", "lr", "before", "after"])


def plateau_lr(epochs: DataFrame, lr: float = 5e-4, factor: float = 0.5, patience: int = 2,
               threshold: float = 1e-4, min_lr: float = 0.0, eps: float = 1e-8, chunk: int = SLICE_EPOCHS) -> DataFrame:
    """Reduce-on-plateau replay (mode min, relative threshold): improved
    when val < best * (1 - threshold); when bad epochs exceed patience the lr
    becomes max(lr * factor, min_lr) (if it moves by more than eps) and the
    counter resets. Per (run, epoch): lr before and after the step. A null or NaN
    value is no improvement; negative values follow the same rule."""
    init = {"best": F.lit(float("inf")), "bad": F.lit(0), "lr": F.lit(float(lr))}

    def step(st):
        kind = st.schema["run"].dataType.simpleString()
        args = (float(factor), int(patience), float(threshold), float(min_lr), float(eps))
        src = st.select("run", "n", F.col("last").cast("bigint").alias("last"), "best", "bad", "lr",
                        F.col("xs.epoch").cast("array<bigint>").alias("epochs"),
                        F.col("xs.val").cast("array<double>").alias("vals"))
        return src.mapInArrow(lambda it: _plateau_slices(it, *args),
                              f"run {kind}, n bigint, last bigint, epochs array<bigint>, best double, bad int, lr double, "
                              "before array<double>, after array<double>")

    out = None
    for st, _ in _fold_rounds(epochs, init, step, list(init), chunk):
        z = st.select("run", F.explode(F.arrays_zip("epochs", "before", "after")).alias("z"))
        part = z.select("run", F.col("z.epochs").alias("epoch"), F.col("z.before").alias("lr_before"),
                        F.col("z.after").alias("lr_after"))
        out = part if out is None else out.unionByName(part)
    return out
