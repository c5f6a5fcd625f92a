"""The ledger as a stream: events of a unit wait for the watermark, are folded in order, and leave nothing once the unit is registered."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import Cancellation, Recovery, fold
from ..shipping import ship, spread

OUTPUT = "task_id string, unit_id string, seq long, outcome string"
#: What folding an event needs to know of it.
_EVENT = ("kind", "attempt_id", "category", "fingerprint", "initiator", "reason")
_TEXTS = ", ".join(f"{c} string" for c in _EVENT)


class UnitLedger(StatefulProcessor):
    """One unit's budgets, cancels and events that wait.

    Events are kept until the watermark has passed them, by number, so that a repeated one counts once and late ones find
    their place; then they are folded by time and number.  A registration ends what the unit has: no state is left.  ``at_once``
    folds events as they come, by number within a batch, where they have no time.
    """

    def __init__(self, at_once: bool = False):
        self.at_once = at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", f"at long, {_TEXTS}")
        self.used = handle.getMapState("used", "category string", "n int")
        self.attempts = handle.getMapState("attempts", "attempt string", "category string, fingerprint string")
        self.cancels = handle.getListState("cancels", "kind string, attempt string, initiator string, reason string, undone boolean")
        self.current = handle.getValueState("current", "attempt string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.at_once:
            own = {r["seq"]: (0, *(r[c] for c in _EVENT)) for r in sorted(rows, key=lambda r: r["seq"], reverse=True)}
            yield from self._folded(key, [(0, seq, own[seq]) for seq in sorted(own)])
            return
        for r in rows:
            at = int(r["at"].timestamp() * 1000)
            if not self.waiting.containsKey((r["seq"],)):
                self.waiting.updateValue((r["seq"],), (at, *(r[c] for c in _EVENT)))
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(((value[0], seq[0], tuple(value)) for seq, value in self.waiting.iterator() if value[0] <= now), key=lambda x: x[:2])
        for _, seq, _ in due:
            self.waiting.removeKey((seq,))
        if due:
            yield from self._folded(key, due)

    def _folded(self, key: tuple, due: list[tuple[int, int, tuple]]) -> Iterator[Row]:
        recovery = Recovery({k[0]: v[0] for k, v in self.used.iterator()}, {k[0]: list(v) for k, v in self.attempts.iterator()})
        cancels = Cancellation([list(x) for x in self.cancels.get()], self.current.get()[0] if self.current.exists() else None)
        done = fold([{"seq": seq, **dict(zip(_EVENT, value[1:], strict=True))} for _, seq, value in due], recovery, cancels)
        self._keep(recovery, cancels)
        for seq, outcome in done:
            yield Row(task_id=key[0], unit_id=key[1], seq=seq, outcome=outcome)

    def _keep(self, recovery: Recovery, cancels: Cancellation) -> None:
        """Write what has changed; what is empty is cleared, and so are a registered unit's."""
        for held, now in ((self.used, {k: (n,) for k, n in recovery.used.items()}), (self.attempts, {k: tuple(v) for k, v in recovery.attempts.items()})):
            there = {k[0]: tuple(v) for k, v in held.iterator()}
            for k in there.keys() - now.keys():
                held.removeKey((k,))
            for k, v in now.items():
                if there.get(k) != v:
                    held.updateValue((k,), v)
        if cancels.log:
            self.cancels.put([tuple(x) for x in cancels.log])
        else:
            self.cancels.clear()
        if cancels.current is None:
            self.current.clear()
        else:
            self.current.update((cancels.current,))

    def close(self) -> None:
        pass


def _keep_in_rocksdb(spark: SparkSession) -> None:
    """Processors of one's own need this store; a session that has chosen one keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _complete(events: DataFrame) -> DataFrame:
    rest = [F.col(c).cast("string").alias(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in _EVENT]
    return events.select(F.col("task_id").cast("string").alias("task_id"), F.col("unit_id").cast("string").alias("unit_id"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"), *rest)


def fold_stream(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(task_id, unit_id, seq, outcome) of every event of a stream or table of (task_id, unit_id, seq, at, kind, attempt_id, ...).

    Events of a unit are folded by ``at``, then ``seq``; of those with one number the first counts.  A table is folded at once.
    A stream's events come out once the watermark, ``lateness`` behind the latest event, has passed them; what comes later than
    that is dropped by Spark and counted there.  State is what waits, and budgets and cancels of units that aren't registered:
    a ``registered`` event ends a unit's, so that state follows the units at work and not those there have ever been.  Streams
    without ``at`` are folded as they come.
    """
    ship(events.sparkSession)
    if events.isStreaming:
        _keep_in_rocksdb(events.sparkSession)
        if "at" not in events.columns:
            return _complete(events.withColumn("at", F.lit(None))).groupBy("task_id", "unit_id").transformWithState(UnitLedger(at_once=True), OUTPUT, "append", "None")
        timed = _complete(events).withWatermark("at", lateness)
        return timed.groupBy("task_id", "unit_id").transformWithState(UnitLedger(), OUTPUT, "append", "EventTime")
    if "at" not in events.columns:
        events = events.withColumn("at", F.timestamp_seconds("seq"))

    rows = spread(_complete(events), "task_id", "unit_id").sortWithinPartitions("task_id", "unit_id", F.asc_nulls_last("at"), F.asc_nulls_last("seq"))
    return rows.select("task_id", "unit_id", "seq", *_EVENT).mapInArrow(_folded_in_order, OUTPUT)


def _folded_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of a task's events, which come unit by unit in order: of each unit at hand its budgets, cancels and numbers are kept."""
    unit, recovery, cancels, seen = None, Recovery(), Cancellation(), set()
    for batch in batches:
        places, outcomes = [], []
        for i, (task_id, unit_id, seq, *event) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if unit != (task_id, unit_id):
                unit, recovery, cancels, seen = (task_id, unit_id), Recovery(), Cancellation(), set()
            if seq in seen:
                continue
            seen.add(seq)
            places.append(i)
            outcomes.append(fold([{"seq": seq, **dict(zip(_EVENT, event, strict=True))}], recovery, cancels)[0][1])
        kept = batch.select(["task_id", "unit_id", "seq"]).take(pa.array(places, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(outcomes, pa.string())], names=["task_id", "unit_id", "seq", "outcome"])


class LastPhase(StatefulProcessor):
    """A unit's last phase, for as long as events come: ``idle`` milliseconds of event time after the last one it is forgotten."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, phase string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self.last.get()) if self.last.exists() else None
        newest = max(((int(r["at"].timestamp() * 1000), r["seq"], r["phase"]) for r in rows), key=lambda x: x[:2])
        if before is None or newest[:2] > before[:2]:
            if before is not None:
                self.handle.deleteTimer(before[0] + self.idle)
            self.last.update(newest)
            self.handle.registerTimer(newest[0] + self.idle)
            yield Row(task_id=key[0], unit_id=key[1], phase=newest[2], at=pd.Timestamp(newest[0], unit="ms").to_pydatetime())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_stream(events: DataFrame, lateness: str = "1 hour", idle_hours: int = 24) -> DataFrame:
    """(task_id, unit_id, phase, at) of a stream, in update mode: a unit's last phase by event time, whenever there is a later one.

    A unit without events for ``idle_hours`` is forgotten.
    """
    ship(events.sparkSession)
    _keep_in_rocksdb(events.sparkSession)
    timed = events.select(F.col("task_id").cast("string").alias("task_id"), F.col("unit_id").cast("string").alias("unit_id"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"), "phase").withWatermark("at", lateness)
    return timed.groupBy("task_id", "unit_id").transformWithState(LastPhase(idle_hours * 3_600_000), "task_id string, unit_id string, phase string, at timestamp", "update", "EventTime")


def activity(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events of each kind in tumbling windows of event time."""
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width), "kind").agg(F.count("*").alias("n"))
