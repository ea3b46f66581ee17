"""ST2: out-of-order, missing and never-ending runs; the state stays bounded."""

import math
import os
import random
import time

from pyspark.errors import AnalysisException

from tokenmill.operators import runs as R
from tokenmill.streaming.early_stop_stream import Fold, early_stop_stream, latest_state

SCHEMA = "run bigint, epoch bigint, val double"


class Held(dict):
    most = 0

    def put(self, k, v):
        self[k] = v
        Held.most = max(Held.most, len(self))

    def remove(self, k):
        del self[k]

    def smallest(self):
        return min(self)


def folded(epochs, vals, patience=3, max_ahead=10**6):
    f = Fold(None, Held(), patience, 0.001, max_ahead)
    for e in epochs:
        f.add(e, vals[e])
    return f


def test_any_order_gives_the_ordered_result():
    rng = random.Random(3)
    for seed in range(50):
        vals = {e: rng.choice([rng.random(), math.nan, 1.0 / e]) for e in range(1, 40)}
        order = list(vals)
        want = folded(order, vals).state()
        rng.shuffle(order)
        got = folded(order, vals).state()
        assert repr(got) == repr(want)
        twice = folded(order + order, vals).state()
        assert repr(twice) == repr(want)


def test_a_missing_epoch_does_not_hold_everything():
    Held.most = 0
    vals = {e: -float(e) for e in range(1, 5000) if e != 7}
    f = folded(list(vals), vals, max_ahead=50)
    assert Held.most == 51 and f.skipped == 1 and f.next_epoch == 5000 and f.waiting == 0
    stuck = folded(list(vals), vals)
    assert stuck.next_epoch == 7 and stuck.waiting == 4992
    stuck.skip_gap()
    assert stuck.next_epoch == 5000 and stuck.waiting == 0 and not stuck.ahead
    ended = folded([5, 4, 3, 2, 1, 6, 7], dict.fromkeys(range(1, 8), 1.0), patience=2)
    assert ended.stop_epoch == 3 and ended.waiting == 0 and not ended.ahead


def run(spark, tmp_dir, files, **kw):
    src = os.path.join(tmp_dir, "in")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(src, f"part={i}"))
        time.sleep(0.01)  # files are taken in order of their time
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = early_stop_stream(stream, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), **kw)
    return q, os.path.join(tmp_dir, "out")


def test_stream_with_gaps_and_nulls(spark, tmp_dir):
    falling = [(1, e, 1.0 / e) for e in range(1, 31)]
    rows = falling + [(2, e, 1.0) for e in range(1, 31)] + [(3, e, 1.0 / e) for e in range(1, 31) if e != 4]
    files = [[r for r in rows if r[1] % 3 == k] for k in (2, 0, 1)] + [[(None, 1, 1.0), (4, None, 1.0), (5, 1, None)]]
    q, out = run(spark, tmp_dir, files, patience=3, max_ahead=25)
    q.awaitTermination()
    got = {r.run: r for r in latest_state(spark, out).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert (got[1].best_epoch, got[1].stop_epoch, got[1].last_epoch, got[1].waiting) == (30, None, 30, 0) and got[1].skipped == 0
    assert got[2].stop_epoch == 4 and got[2].waiting == 0
    assert got[3].last_epoch == 30 and got[3].skipped == 1 and got[3].waiting == 0
    assert got[5].best == math.inf and got[5].last_epoch == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_timer_closes_a_gap(spark, tmp_dir):
    q, out = run(spark, tmp_dir, [[(1, 1, 1.0), (1, 3, 0.5), (1, 4, 0.4)]], patience=3, available_now=False,
                 gap_timeout_ms=1500, interval="500 milliseconds")
    try:
        end = time.time() + 60
        while time.time() < end:
            time.sleep(1)
            try:
                if any(r.last_epoch == 4 for r in latest_state(spark, out).collect()):
                    break
            except AnalysisException:
                pass  # nothing is written yet
        r = latest_state(spark, out).first()
        assert (r.last_epoch, r.skipped, r.waiting, r.best_epoch) == (4, 1, 0, 4)
    finally:
        q.stop()


def test_stream_equals_batch_on_shuffled_files(spark, tmp_dir):
    rng = random.Random(8)
    rows = [(r, e, round(rng.random() + 3.0 / e, 3)) for r in range(6) for e in range(1, 25)]
    rng.shuffle(rows)
    q, out = run(spark, tmp_dir, [rows[i::4] for i in range(4)], patience=4)
    q.awaitTermination()
    got = {r.run: (r.best, r.best_epoch, r.stop_epoch, r.last_epoch) for r in latest_state(spark, out).collect()}
    df = spark.createDataFrame(rows, SCHEMA)
    assert got == {r.run: (r.best, r.best_epoch, r.stop_epoch, r.last_epoch) for r in R.early_stop(df, 4, 0.001).collect()}


def test_runs_share_a_bucket(spark, tmp_dir):
    """Many runs in two keys of state, with gaps and out of order over the files."""
    rng = random.Random(5)
    rows = [(r, e, round(rng.random() + 3.0 / e, 3)) for r in range(-20, 20) for e in range(1, 20) if (r, e) != (7, 3)]
    rng.shuffle(rows)
    q, out = run(spark, tmp_dir, [rows[i::3] for i in range(3)], patience=4, max_ahead=5000, buckets=2)
    q.awaitTermination()
    got = {r.run: (r.best, r.best_epoch, r.stop_epoch, r.last_epoch) for r in latest_state(spark, out).collect()}
    whole = spark.createDataFrame([r for r in rows if r[0] != 7], SCHEMA)
    want = {r.run: (r.best, r.best_epoch, r.stop_epoch, r.last_epoch) for r in R.early_stop(whole, 4, 0.001).collect()}
    assert got.pop(7)[3] == 2 and got == want


def test_a_part_is_one_batch_however_many_files(spark, tmp_dir, monkeypatch):
    from datetime import datetime, timedelta
    from pyspark.sql import functions as F
    from tokenmill.plans import q_stream as Q
    rows = [(u * 100 + e, datetime(2024, 1, 1) + timedelta(seconds=e), u, "click", 1.0 / e) for u in range(30) for e in range(1, 13)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(
        os.path.join(tmp_dir, "events.parquet"))
    at = []
    monkeypatch.setattr(Q, "_scratch", lambda s, name: at.append(os.path.join(tmp_dir, name)) or at[-1])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = Q.q_early_stop_stream(spark, tmp_dir).collect()
    finally:
        spark.conf.unset(key)
    src = next(p for p in at if p.endswith("epochs-in"))
    assert len(spark.read.parquet(src).inputFiles()) > Q.N_FILES
    out = next(p for p in at if p.endswith("es-out"))
    assert spark.read.parquet(out).agg(F.countDistinct("batch_id")).first()[0] <= Q.N_FILES
    assert len(got) == 30 and {(r.best_epoch, r.stop_epoch, r.last_epoch) for r in got} == {(12, None, 12)}
