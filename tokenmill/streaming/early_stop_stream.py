"""ST2: early stopping as a live monitor with bounded state.

State per run: a record (best, bad, best_epoch, stop_epoch, next_epoch, waiting,
skipped) and a map of the epochs that arrived ahead of a gap. Runs are kept by
buckets, so that a call to Python serves many of them. Epochs are folded
strictly in order, so files or batches that arrive out of order give the same
result as the batch operator X8. An epoch that is due is folded at once and never
stored; a stopped run keeps its value only; epochs before the next due one (late
or repeated) are ignored.

A missing epoch cannot grow a run's state for ever: when more than
``max_ahead`` epochs wait behind it, or when nothing has filled the gap for
``gap_timeout_ms`` of processing time (a timer), the run goes on from the
smallest waiting epoch, and ``skipped`` counts the epochs that never came. A null or
NaN value is no improvement.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

OUT_SCHEMA = ("run bigint, best double, best_epoch bigint, stop_epoch bigint, last_epoch bigint, waiting bigint, "
              "skipped bigint")
#: One run's fold in its bucket's state; -1 stands for no epoch and for no timer.
FOLD = [("run", "i8"), ("best", "f8"), ("bad", "i4"), ("best_epoch", "i8"), ("stop_epoch", "i8"), ("next_epoch", "i8"),
        ("waiting", "i8"), ("skipped", "i8"), ("due", "i8")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """One run's early stopping; ``ahead`` is any mapping-like store of waiting
    epochs (get, put, remove, smallest)."""

    def __init__(self, state, ahead, patience: int, min_delta: float, max_ahead: int):
        self.best, self.bad, self.best_epoch, self.stop_epoch, self.next_epoch, self.waiting, self.skipped = \
            state or (math.inf, 0, None, None, 1, 0, 0)
        self.ahead, self.patience, self.min_delta, self.max_ahead = ahead, patience, min_delta, max_ahead

    def state(self) -> tuple:
        return self.best, self.bad, self.best_epoch, self.stop_epoch, self.next_epoch, self.waiting, self.skipped

    def add(self, epoch: int, val: float) -> None:
        if self.stop_epoch is not None or epoch < self.next_epoch:
            return
        if epoch == self.next_epoch:
            if self.waiting and self.ahead.get(epoch) is not None:
                self._take(epoch)
            self._step(val)
            self._drain()
            return
        if self.ahead.get(epoch) is None:
            self.waiting += 1
        self.ahead.put(epoch, val)
        if self.waiting > self.max_ahead:
            self.skip_gap()

    def skip_gap(self) -> None:
        """Goes on from the smallest waiting epoch."""
        if self.waiting and self.stop_epoch is None:
            first = self.ahead.smallest()
            self.skipped += first - self.next_epoch
            self.next_epoch = first
            self._drain()

    def _take(self, epoch):
        self.waiting -= 1
        self.ahead.remove(epoch)

    def _drain(self):
        while self.stop_epoch is None and self.waiting:
            val = self.ahead.get(self.next_epoch)
            if val is None:
                return
            self._take(self.next_epoch)
            self._step(val)
        if self.stop_epoch is not None and self.waiting:
            self.ahead.clear()  # epochs after the stop are ignored
            self.waiting = 0

    def _step(self, val):
        if val < self.best - self.min_delta:
            self.best, self.bad, self.best_epoch = val, 0, self.next_epoch
        else:
            self.bad += 1
            if self.bad >= self.patience:
                self.stop_epoch = self.next_epoch
        self.next_epoch += 1


class _Ahead:
    """One run's waiting epochs in the bucket's map state."""

    def __init__(self, state, run: int):
        self.of, self.run = state, run

    def get(self, epoch):
        return self.of.getValue((self.run, epoch))[0] if self.of.containsKey((self.run, epoch)) else None

    def put(self, epoch, val):
        self.of.updateValue((self.run, epoch), (val,))

    def remove(self, epoch):
        self.of.removeKey((self.run, epoch))

    def _epochs(self):
        return (int(k[1]) for k in self.of.keys() if int(k[0]) == self.run)

    def smallest(self):
        return min(self._epochs())

    def clear(self):
        for epoch in list(self._epochs()):
            self.remove(epoch)


class EarlyStop(StatefulProcessor):
    """Keys are buckets of runs: one call, one read and one write of the state for all
    runs of a bucket. The folds of a bucket are one binary value, records of FOLD
    in the order of the runs; waiting epochs are map state by run and epoch."""

    def __init__(self, patience: int, min_delta: float, max_ahead: int, gap_timeout_ms: int | None):
        self.rule, self.gap_timeout_ms = (patience, min_delta, max_ahead), gap_timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.folds = handle.getValueState("folds", "folds binary")
        self.ahead = handle.getMapState("ahead", "run bigint, epoch bigint", "val double")

    def _load(self) -> tuple[dict, dict]:
        """{run: fold record without the run}, {run: when its gap runs out}."""
        import numpy as np
        kept = np.frombuffer(self.folds.get()[0], FOLD).tolist() if self.folds.exists() else []
        states = {r: (best, bad, None if best_epoch < 0 else best_epoch, None if stop_epoch < 0 else stop_epoch, *rest)
                  for r, best, bad, best_epoch, stop_epoch, *rest, _ in kept}
        return states, {k[0]: k[-1] for k in kept if k[-1] >= 0}

    def _fold(self, states: dict, run: int) -> Fold:
        return Fold(states.get(run), _Ahead(self.ahead, run), *self.rule)

    def _save(self, states: dict, due: dict, changed: list):
        import numpy as np
        import pandas as pd
        rows = [(r, best, bad, -1 if best_epoch is None else best_epoch, -1 if stop_epoch is None else stop_epoch, *rest, due.get(r, -1))
                for r, (best, bad, best_epoch, stop_epoch, *rest) in sorted(states.items())]
        self.folds.update((np.array(rows, dtype=FOLD).tobytes(),))
        if self.gap_timeout_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if due:
                self.handle.registerTimer(min(due.values()))
        best, _, best_epoch, stop_epoch, next_epoch, waiting, skipped = zip(*(states[r] for r in changed))
        last = [n - 1 if s is None else s for s, n in zip(stop_epoch, next_epoch)]
        yield pd.DataFrame({"run": pd.array(changed, dtype="int64"), "best": pd.array(best, dtype="float64"),
                            "best_epoch": pd.array(best_epoch, dtype="Int64"), "stop_epoch": pd.array(stop_epoch, dtype="Int64"),
                            "last_epoch": pd.array(last, dtype="int64"), "waiting": pd.array(waiting, dtype="int64"),
                            "skipped": pd.array(skipped, dtype="int64")})

    def _note(self, states: dict, due: dict, run: int, fold: Fold, timers):
        states[run] = fold.state()
        due.pop(run, None)
        if self.gap_timeout_ms is not None and fold.waiting:
            due[run] = timers.getCurrentProcessingTimeInMs() + self.gap_timeout_ms

    def handleInputRows(self, key, rows, timerValues):
        """The rows that a micro-batch has for the bucket are sorted together, so
        their order within it leaves nothing waiting."""
        import numpy as np
        parts = [(p["run"].to_numpy(np.int64), p["epoch"].to_numpy(np.int64), p["val"].to_numpy(np.float64, na_value=np.nan)) for p in rows]
        run, epoch, val = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((epoch, run))
        run, epoch, val = run[order], epoch[order], val[order]
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        states, due = self._load()
        changed = run[first].tolist()
        for r, a, b in zip(changed, first.tolist(), [*first[1:].tolist(), len(run)]):
            fold = self._fold(states, r)
            for at in range(a, b, 1 << 16):
                for e, v in zip(epoch[at:min(b, at + (1 << 16))].tolist(), val[at:min(b, at + (1 << 16))].tolist()):
                    fold.add(e, v)
            self._note(states, due, r, fold, timerValues)
        yield from self._save(states, due, changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        states, due = self._load()
        now = timerValues.getCurrentProcessingTimeInMs()
        changed = sorted(r for r, t in due.items() if t <= now)
        for r in changed:
            fold = self._fold(states, r)
            fold.skip_gap()
            self._note(states, due, r, fold, timerValues)
        if changed:
            yield from self._save(states, due, changed)

    def close(self) -> None:
        pass


def early_stop_stream(stream: DataFrame, out_path: str, checkpoint: str, patience: int = 5,
                      min_delta: float = 0.001, available_now: bool = True, max_ahead: int = 10_000,
                      gap_timeout_ms: int | None = None, interval: str = "10 seconds", buckets: int = 4096) -> StreamingQuery:
    """Stream of (run, epoch, val) -> per micro-batch, the updated state of
    every run that received epochs (or whose gap ran out of time), appended
    under ``batch_id=N``. Rows without a run or an epoch are ignored. Runs are dealt
    into ``buckets`` by their hash, each one key of the stateful operator."""
    spark = stream.sparkSession
    timed = gap_timeout_ms is not None
    upd = stream.where(F.col("run").isNotNull() & F.col("epoch").isNotNull()).select(
        F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int").alias("bucket"), "run", "epoch", "val") \
        .groupBy("bucket").transformWithStateInPandas(
            EarlyStop(patience, min_delta, max_ahead, gap_timeout_ms), OUT_SCHEMA, "Update", "ProcessingTime" if timed else "None")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = upd.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # map state and timers need it; a query keeps the settings it started with
    try:
        return w.start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def latest_state(spark, out_path: str) -> DataFrame:
    """The last reported state per run (max batch id)."""
    o = spark.read.parquet(out_path)
    last = o.groupBy("run").agg(F.max("batch_id").alias("batch_id"))
    return o.join(last, ["run", "batch_id"]).drop("batch_id")
