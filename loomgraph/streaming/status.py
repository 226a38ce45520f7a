"""Repository statuses as a stream with state: one machine a repository, whatever the order and number of events.

A worker's events say what a repository's run has come to.  The machine of a repository holds the run's latest status and
answers each event with what holds then, but for events that change nothing.  An event counts if its status is one of
``catalog.STATUSES``, its progress 0 to 100 or null, it is later than the last that counted, and its status may follow
the one that holds (``FOLLOWS``).  So repeated events, late ones and those that skip back are harmless.  A run that
hasn't ended and hears nothing for ``patience`` fails by a timer of event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators.catalog import PROGRESS, STATUSES

#: The order of a run; a run may skip ahead, ends in COMPLETED or FAILED, and may be queued again then.
_RUN = ("QUEUED", "CLONING", "SCANNING", "PARSING", "INDEXING", "DOCUMENTING", "COMPLETED")
FOLLOWS: dict[str, frozenset[str]] = {
    "NOT_STARTED": frozenset(_RUN) | {"FAILED"},
    **{status: frozenset(_RUN[i:]) | {"FAILED"} for i, status in enumerate(_RUN[:-1])},
    "COMPLETED": frozenset({"QUEUED"}),
    "FAILED": frozenset({"QUEUED"}),
}
EVENTS = "repository_id string, status string, progress int, at timestamp"
RESULT = "repository_id string, status string, progress int, at timestamp, counted bigint, ignored bigint"


class Run:
    """What a machine knows; pure, so that it can be replayed without a stream."""

    def __init__(self, status: str = "NOT_STARTED", progress: int = 0, at: int = -1, counted: int = 0, ignored: int = 0):
        self.status, self.progress, self.at, self.counted, self.ignored = status, progress, at, counted, ignored

    def take(self, status: str | None, progress: int | None, at: int) -> bool:
        """Takes an event (``at`` in microseconds); whether it counted."""
        legal = status in STATUSES and (progress is None or 0 <= progress <= 100)
        if not legal or at <= self.at or status not in FOLLOWS[self.status]:
            self.ignored += 1
            return False
        self.status, self.at, self.counted = status, at, self.counted + 1
        known = PROGRESS.get(status, 0 if status == "QUEUED" else self.progress)
        self.progress = known if progress is None else progress
        return True

    @property
    def ended(self) -> bool:
        return self.status in ("NOT_STARTED", "COMPLETED", "FAILED")

    def values(self) -> tuple[str, int, int, int, int]:
        return self.status, self.progress, self.at, self.counted, self.ignored


class StatusMachine(StatefulProcessor):
    def __init__(self, patience: timedelta):
        self.patience = int(patience.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, progress int, at bigint, counted bigint, ignored bigint")

    def _held(self) -> Run:
        held = self.run.get()
        return Run(*held) if held is not None else Run()

    def _timer(self, run: Run) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not run.ended:
            self.handle.registerTimer(run.at // 1000 + self.patience)

    @staticmethod
    def _row(key: str, run: Run) -> pd.DataFrame:
        columns = ["repository_id", "status", "progress", "at", "counted", "ignored"]
        status, progress, at, counted, ignored = run.values()
        return pd.DataFrame([(key, status, progress, pd.Timestamp(at, unit="us") if at >= 0 else pd.NaT, counted, ignored)], columns=columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events["micros"] = events["at"].astype("datetime64[us]").astype("int64")
        run = self._held()
        # Of one trigger's events the order is that of their times; ties by status, so that replays agree.
        order = events.sort_values(["micros", "status", "progress"], kind="stable", na_position="first")
        for status, progress, micros in zip(order["status"], order["progress"], order["micros"], strict=True):
            run.take(status, None if pd.isna(progress) else int(progress), int(micros))
        self.run.update(run.values())
        self._timer(run)
        yield self._row(key[0], run)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        run = self._held()
        if not run.ended:
            run.take("FAILED", None, int(expiredTimerInfo.getExpiryTimeInMs()) * 1000)
            self.run.update(run.values())
            yield self._row(key[0], run)

    def close(self) -> None:
        pass


def statuses(events: DataFrame, lateness: str = "1 hour", patience: timedelta = timedelta(hours=6)) -> DataFrame:
    """The stream of what holds for each repository, once a trigger that has events of it or ends its patience."""
    kept = events.filter("repository_id is not null and at is not null").withWatermark("at", lateness)
    machine = StatusMachine(patience)
    return kept.groupBy("repository_id").transformWithStateInPandas(machine, RESULT, "Append", "EventTime")


_STORE = "spark.sql.streaming.stateStore.providerClass"


def run(spark: SparkSession, events: str, told: str, checkpoint: str, lateness: str = "1 hour", patience: timedelta = timedelta(hours=6)) -> None:
    """Takes what has come to the folder ``events`` (Parquet) since the last run and appends what holds now to ``told``.

    State lies in RocksDB under the checkpoint; the session's own choice of a store is put back.
    """
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = statuses(spark.readStream.schema(EVENTS).parquet(events), lateness, patience)
        stream.writeStream.format("parquet").option("path", told).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def latest(told: DataFrame) -> DataFrame:
    """Of what a stream of ``statuses`` has told, the last word on each repository."""
    newest = F.max_by(F.struct("status", "progress", "at", "counted", "ignored"), F.struct(F.col("counted") + F.col("ignored"), "at")).alias("r")
    return told.groupBy("repository_id").agg(newest).select("repository_id", "r.*")
