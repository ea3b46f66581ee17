"""Registered queries: experiment analytics (X1-X11, L7) over run fixtures
derived from ``events`` (run = user)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tokenmill.functions import round6
from tokenmill.operators import runs as R
from tokenmill.plans import fixtures as FX
from tokenmill.plans.registry import register, with_ctes
from tokenmill.sources import read_table


def run_table(spark, sf):
    """One row per run (user) with the time of its first event."""
    ev = read_table(spark, sf, "events")
    return ev.groupBy(F.col("user_id").alias("run")).agg(F.min("ts").alias("first_ts"))


SQL_RUNS = "runs AS (SELECT user_id AS run, min(ts) AS first_ts FROM events GROUP BY user_id)"


def _sql_u(run: str, name: str, seed: int = 1337) -> str:
    return (f"(('0x' || substr(md5('{seed}:' || CAST({run} AS VARCHAR) || ':' || '{name}'), 1, 8))::BIGINT"
            " / 4294967296.0)")


def _sql_draw(run: str, name: str) -> str:
    spec = R.RANDOM_SPACE[name]
    lo, hi = math.log(spec["low"]), math.log(spec["high"])
    return f"exp({lo!r}::DOUBLE + {hi - lo!r}::DOUBLE * {_sql_u(run, name)})"


SQL_TRIALS = SQL_RUNS + f""",
trials AS (SELECT run, first_ts, {_sql_draw('run', 'training.lr')} AS lr,
                  {_sql_draw('run', 'training.weight_decay')} AS wd FROM runs)"""


def results(spark, sf):
    """F8: parsed metrics per run + return code (run % 7 = 0 failed)."""
    m = R.parse_metrics(FX.log_lines(spark, sf))
    return m.select("run", F.when(F.col("run") % 7 == 0, 1).otherwise(0).alias("returncode"),
                    "eval_loss", "eval_ppl", "eval_bleu")


_LOSS_RE, _BLEU_RE, _EPOCH_RE, _CHAR_EPOCH_RE, _WORSE_RE = (
    R._LOSS_RE, R._BLEU_RE, R._EPOCH_RE, R._CHAR_EPOCH_RE, R._WORSE_RE)
SQL_RESULTS = FX.SQL_LOG_LINES + f""",
parsed AS (SELECT run, line_no, s,
  (starts_with(s, 'VAL loss:') OR starts_with(s, 'TEST loss:')) AND regexp_matches(s, '{_LOSS_RE}') AS is_loss,
  (starts_with(s, 'VAL BLEU') OR starts_with(s, 'TEST BLEU')) AND regexp_matches(s, '{_BLEU_RE}') AS is_bleu
  FROM (SELECT run, line_no, trim(line) AS s FROM log_lines)),
results AS (SELECT run, CASE WHEN run % 7 = 0 THEN 1 ELSE 0 END AS returncode,
  arg_max(TRY_CAST(regexp_extract(s, '{_LOSS_RE}', 1) AS DOUBLE), line_no) FILTER (WHERE is_loss) AS eval_loss,
  arg_max(TRY_CAST(regexp_extract(s, '{_LOSS_RE}', 2) AS DOUBLE), line_no) FILTER (WHERE is_loss) AS eval_ppl,
  arg_max(TRY_CAST(regexp_extract(s, '{_BLEU_RE}', 1) AS DOUBLE), line_no) FILTER (WHERE is_bleu) AS eval_bleu
  FROM parsed GROUP BY run)"""


def _render(cfg):
    return F.array_join(F.transform(F.array_sort(F.map_entries(cfg)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


_BASE_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in R.BASE_CONFIG.items())
_BUDGET_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in R.SEARCH_BUDGET.items())


@register("apply_overrides", sql=with_ctes(SQL_TRIALS) + f""",
base(k, v) AS (VALUES {_BASE_VALUES}),
budget(k, v) AS (VALUES {_BUDGET_VALUES}),
ov AS (SELECT run, 'training.lr' AS k, printf('%.9e', lr) AS v FROM trials
       UNION ALL SELECT run, 'training.weight_decay', printf('%.9e', wd) FROM trials),
keys AS (SELECT run, k FROM runs, base UNION SELECT run, k FROM ov UNION SELECT run, k FROM runs, budget),
merged AS (SELECT keys.run, keys.k, coalesce(budget.v, ov.v, base.v) AS v FROM keys
  LEFT JOIN budget ON budget.k = keys.k LEFT JOIN ov ON ov.run = keys.run AND ov.k = keys.k
  LEFT JOIN base ON base.k = keys.k)
SELECT run, string_agg(k || '=' || v, ';' ORDER BY k) AS config FROM merged GROUP BY run""".replace("\n,\nbase", ",\nbase"))
def q_apply_overrides(spark, sf):
    t = R.random_trials(R.base_configs(run_table(spark, sf)), "run")
    a = R.apply_overrides(t)
    drawn = F.array(*[F.lit(k) for k in R.RANDOM_SPACE])  # full doubles: shown to nine places on both sides
    shown = F.transform_values("config", lambda k, v: F.when(F.array_contains(drawn, k), F.format_string(
        "%.9e", v.try_cast("double"))).otherwise(v))
    return a.select("run", _render(shown).alias("config"))


_GRID_VALUES = ", ".join(f"({i * 3 + j}, {lr!r}::DOUBLE, {wd!r}::DOUBLE)"
                         for i, lr in enumerate(R.GRID["training.lr"])
                         for j, wd in enumerate(R.GRID["training.weight_decay"]))


@register("grid_trials", sql=with_ctes(SQL_RUNS) + f""",
grid(trial, lr, wd) AS (VALUES {_GRID_VALUES})
SELECT run, CAST(trial AS BIGINT) AS trial, lr, wd FROM runs, grid""".replace("\n,\ngrid", ",\ngrid"))
def q_grid_trials(spark, sf):
    g = R.grid_trials(run_table(spark, sf).select("run"))
    return g.select("run", "trial", F.col("overrides")["training.lr"].alias("lr"),
                    F.col("overrides")["training.weight_decay"].alias("wd"))


@register("random_trials", sql=with_ctes(SQL_TRIALS) + """
SELECT run, printf('%.9e', lr) AS lr, printf('%.9e', wd) AS wd FROM trials""")
def q_random_trials(spark, sf):
    t = R.random_trials(run_table(spark, sf), "run")
    return t.select("run", F.format_string("%.9e", F.col("overrides")["training.lr"]).alias("lr"),
                    F.format_string("%.9e", F.col("overrides")["training.weight_decay"]).alias("wd"))


@register("run_name", sql=with_ctes(SQL_TRIALS) + f"""
SELECT run, '{R.RUN_NAME_PREFIX}11_' || 'training-lr=' || printf('%.1e', lr) || '_' || 'training-weight_decay=' || printf('%.1e', wd)
       || '_' || strftime(first_ts, '%Y%m%d-%H%M%S') AS run_name FROM trials""")
def q_run_name(spark, sf):
    t = R.random_trials(run_table(spark, sf), "run")
    return t.select("run", R.run_name(F.lit("11"), F.col("overrides"), F.col("first_ts")).alias("run_name"))


@register("parse_metrics", sql=with_ctes(SQL_RESULTS) + """
SELECT run, round(eval_loss, 6) AS eval_loss, round(eval_ppl, 6) AS eval_ppl, round(eval_bleu, 6) AS eval_bleu FROM results""")
def q_parse_metrics(spark, sf):
    m = R.parse_metrics(FX.log_lines(spark, sf))
    return m.select("run", *[round6(c).alias(c) for c in ["eval_loss", "eval_ppl", "eval_bleu"]])


@register("parse_epochs", sql=with_ctes(FX.SQL_EPOCHS) + f""",
ln AS (SELECT run, epoch, val / 100.0 AS val, (val + 1.0) / 100.0 AS train, epoch % 6 AS k,
              5e-4::DOUBLE * power(0.5, least(epoch // 10, 5)) AS lr FROM epochs),
el AS (SELECT run, epoch AS line_no, trim(CASE
  WHEN k = 1 THEN printf('Epoch [%d/50] ┃ train_loss: %.4f ┃ val_loss: %.4f ┃ lr: %.6f', epoch, train, val, lr)
  WHEN k = 2 THEN '>> improved, saved checkpoint at x.pt' WHEN k = 3 THEN '>> no improvement (' || (epoch % 5) || '/5)'
  WHEN k = 4 THEN 'Early stopping.'
  ELSE printf('Epoch %d: train=%.4f, val=%.4f, lr=%.6e', epoch, train, val, lr) END) AS s FROM ln),
m AS (SELECT *, regexp_matches(s, '{_EPOCH_RE}') AS a, regexp_matches(s, '{_CHAR_EPOCH_RE}') AS c,
             regexp_matches(s, '{_WORSE_RE}') AS w FROM el)
SELECT run, line_no, CASE WHEN a OR c THEN 'epoch' WHEN w THEN 'no_improvement' WHEN starts_with(s, '>> improved') THEN 'improved'
         ELSE 'stopped' END AS kind,
  TRY_CAST(CASE WHEN a THEN regexp_extract(s, '{_EPOCH_RE}', 1) WHEN c THEN regexp_extract(s, '{_CHAR_EPOCH_RE}', 1) END AS DOUBLE) AS epoch,
  round(TRY_CAST(CASE WHEN a THEN regexp_extract(s, '{_EPOCH_RE}', 2) WHEN c THEN regexp_extract(s, '{_CHAR_EPOCH_RE}', 3) END AS DOUBLE), 6) AS train,
  round(TRY_CAST(CASE WHEN a THEN regexp_extract(s, '{_EPOCH_RE}', 3) WHEN c THEN regexp_extract(s, '{_CHAR_EPOCH_RE}', 4) END AS DOUBLE), 6) AS val,
  TRY_CAST(CASE WHEN a THEN regexp_extract(s, '{_EPOCH_RE}', 4) WHEN c THEN regexp_extract(s, '{_CHAR_EPOCH_RE}', 5) END AS DOUBLE) AS lr,
  TRY_CAST(CASE WHEN w THEN regexp_extract(s, '{_WORSE_RE}', 1) END AS DOUBLE) AS bad,
  TRY_CAST(CASE WHEN w THEN regexp_extract(s, '{_WORSE_RE}', 2) END AS DOUBLE) AS patience
FROM m""".replace("\n,\nln", ",\nln"))
def q_parse_epochs(spark, sf):
    p = R.parse_epochs(R.epoch_lines(FX.epochs(spark, sf)), events=True)
    return p.select("run", "line_no", "kind", F.col("epoch").cast("double").alias("epoch"), round6("train").alias("train"),
                    round6("val").alias("val"), "lr", F.col("bad").cast("double").alias("bad"),
                    F.col("patience").cast("double").alias("patience"))


@register("leaderboard", sql=with_ctes(SQL_RESULTS) + """
SELECT run, returncode, round(eval_loss, 6) AS eval_loss, round(eval_bleu, 6) AS eval_bleu,
       row_number() OVER (ORDER BY eval_loss IS NULL, eval_loss, run) AS rank FROM results""")
def q_leaderboard(spark, sf):
    lb = R.leaderboard(results(spark, sf))
    return lb.select("run", "returncode", round6("eval_loss").alias("eval_loss"), round6("eval_bleu").alias("eval_bleu"),
                     "rank")


@register("variant_report", sql=with_ctes(SQL_RESULTS) + """
SELECT run, run // 3 AS batch, ['10', '01', '11'][run % 3 + 1] AS variant,
  CASE WHEN coalesce(sum(CASE WHEN returncode <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run // 3 ORDER BY run % 3
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'skipped'
       WHEN returncode <> 0 THEN 'failed' ELSE 'ok' END AS status FROM results""")
def q_variant_report(spark, sf):
    r = results(spark, sf).withColumn("batch", F.expr("run div 3")).withColumn("pos", F.col("run") % 3)
    return R.variant_report(r)


def metrics(spark, sf):
    e = FX.epochs(spark, sf)
    return e.select("run", F.concat(F.lit("event/"), F.col("event_type")).alias("tag"),
                    F.col("epoch").alias("step"), F.when(F.col("epoch") % 7 != 3, F.col("val")).alias("value"))


@register("metric_series", sql=with_ctes(FX.SQL_EPOCHS) + """
,
mv AS (SELECT run, event_type, epoch, CASE WHEN epoch % 7 <> 3 THEN val END AS val FROM epochs),
ms AS (SELECT run, event_type, count(*) AS n_points, arg_max({'v': val}, epoch).v AS latest, max(epoch) AS last_step,
       min({'v': val, 's': epoch}) FILTER (WHERE val IS NOT NULL) AS b FROM mv GROUP BY ALL)
SELECT run, 'event/' || event_type AS tag, n_points, latest, last_step, b.v AS best, b.s AS best_step FROM ms""".replace("\n,\nmv", ",\nmv"))
def q_metric_series(spark, sf):
    return R.metric_series(metrics(spark, sf))


@register("epoch_summary", sql=with_ctes(FX.SQL_EPOCHS) + """,
st AS (SELECT run, (epoch - 1) // 10 + 1 AS ep, 5e-4::DOUBLE * power(0.5, least((epoch - 1) // 10, 5)) AS lr, CAST(round(val * 100) AS BIGINT) AS loss_cents, event_id % 5 + 1 AS ntok,
              event_type FROM epochs),
tr AS (SELECT run, ep, sum(loss_cents) / greatest(sum(ntok), 1) / 100.0 AS train_loss, count(*) AS n_steps FROM st GROUP BY ALL),
va AS (SELECT run, ep, avg(loss_cents) / 10000.0 AS val_loss, max(lr) AS lr FROM st WHERE event_type = 'view' GROUP BY ALL)
SELECT tr.run, CAST(tr.ep AS BIGINT) AS epoch, train_loss, n_steps, val_loss, lr
FROM tr LEFT JOIN va USING (run, ep)""".replace("\n,\nst", ",\nst"))
def q_epoch_summary(spark, sf):
    """Step losses are whole cents, so every sum is exact and both engines
    end with the same single division (no rounding ties)."""
    e = FX.epochs(spark, sf).withColumn("epoch", F.expr("(epoch - 1) div 10 + 1")) \
        .withColumn("cents", F.round(F.col("val") * 100).cast("bigint"))
    steps = e.select("run", "epoch", F.col("cents").alias("loss_sum"), (F.col("event_id") % 5 + 1).alias("ntok"))
    lr = F.lit(5e-4) * F.pow(F.lit(0.5), F.least(F.col("epoch") - 1, F.lit(5)))
    vals = e.where(F.col("event_type") == "view").select("run", "epoch", F.col("cents").alias("val_loss"), lr.alias("lr"))
    s = R.epoch_summary(steps, vals)
    return s.select("run", F.col("epoch").cast("bigint").alias("epoch"), (F.col("train_loss") / 100.0).alias("train_loss"),
                    "n_steps", (F.col("val_loss") / 10000.0).alias("val_loss"), "lr")


_SQL_EARLY_STEPS = """
WITH RECURSIVE epochs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS val FROM events),
st AS (
  SELECT run, CAST(0 AS BIGINT) AS epoch, CAST('inf' AS DOUBLE) AS best, 0 AS bad, CAST(NULL AS BIGINT) AS best_epoch,
         CAST(NULL AS BIGINT) AS stop_epoch FROM (SELECT DISTINCT run FROM epochs)
  UNION ALL
  SELECT s.run, e.epoch,
    CASE WHEN e.val < s.best - 0.001 THEN e.val ELSE s.best END,
    CASE WHEN e.val < s.best - 0.001 THEN 0 ELSE s.bad + 1 END,
    CASE WHEN e.val < s.best - 0.001 THEN e.epoch ELSE s.best_epoch END,
    CASE WHEN e.val < s.best - 0.001 THEN NULL WHEN s.bad + 1 >= 5 THEN e.epoch ELSE NULL END
  FROM st s JOIN epochs e ON e.run = s.run AND e.epoch = s.epoch + 1 WHERE s.stop_epoch IS NULL)
"""
_LAST = " FROM st QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1"
_SQL_EARLY = _SQL_EARLY_STEPS + "SELECT run, round(best, 6) AS best, best_epoch, stop_epoch, epoch AS last_epoch" + _LAST
_SQL_EARLY_GAPPED = _SQL_EARLY_STEPS + """SELECT run, round(best, 6) AS best, (best_epoch - 1) * 3 - run % 2 * 6 AS best_epoch,
       (stop_epoch - 1) * 3 - run % 2 * 6 AS stop_epoch, (epoch - 1) * 3 - run % 2 * 6 AS last_epoch""" + _LAST


def gapped(spark, sf):
    """Epoch numbers that start at 0 or below and have gaps: 3 * (order - 1) -
    run % 2 * 6."""
    e = FX.epochs(spark, sf)
    return e.withColumn("epoch", (F.col("epoch") - 1) * 3 - F.pmod(F.col("run"), F.lit(2)) * 6)


@register("early_stop", sql=_SQL_EARLY_GAPPED)
def q_early_stop(spark, sf):
    r = R.early_stop(gapped(spark, sf), patience=5, min_delta=0.001)
    return r.select("run", round6("best").alias("best"), "best_epoch", "stop_epoch", "last_epoch")


_SQL_PLATEAU = """
WITH RECURSIVE epochs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value / 100.0 AS val FROM events),
st AS (
  SELECT run, CAST(0 AS BIGINT) AS epoch, CAST('inf' AS DOUBLE) AS best, 0 AS bad, 5e-4::DOUBLE AS lr,
         CAST(NULL AS DOUBLE) AS lr_before FROM (SELECT DISTINCT run FROM epochs)
  UNION ALL
  SELECT run, epoch, best, CASE WHEN bad > 2 THEN 0 ELSE bad END,
         CASE WHEN bad > 2 AND lr_prev - greatest(lr_prev * 0.5, 0.0) > 1e-8 THEN greatest(lr_prev * 0.5, 0.0) ELSE lr_prev END,
         lr_prev
  FROM (SELECT s.run, e.epoch, s.lr AS lr_prev,
          CASE WHEN e.val < s.best * (1.0 - 1e-4) THEN e.val ELSE s.best END AS best,
          CASE WHEN e.val < s.best * (1.0 - 1e-4) THEN 0 ELSE s.bad + 1 END AS bad
        FROM st s JOIN epochs e ON e.run = s.run AND e.epoch = s.epoch + 1))
SELECT run, (epoch - 1) * 3 - run % 2 * 6 AS epoch, lr_before, lr AS lr_after FROM st WHERE epoch > 0"""


@register("plateau_lr", sql=_SQL_PLATEAU)
def q_plateau_lr(spark, sf):
    e = gapped(spark, sf).withColumn("val", F.col("val") / 100.0)
    return R.plateau_lr(e, lr=5e-4, factor=0.5, patience=2)
