"""Silent documents by state and event-time timers.

Each event of a document stays in its state until the watermark has passed the event by the threshold. Then nothing
earlier can arrive, and a timer decides all events that are due: no other event within the threshold, and a kind
that leaves the document in work, and it goes back to the queue.  Out-of-order events find their
place because a decision waits for the watermark.  A completion or failure that arrives for a document
already sent back takes that back: a row with the new status follows.

A document keeps the events of the watermark delay plus the threshold, and one time.  The state lives in the
checkpoint of the query; a restarted query goes on from there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliary import fixed_values as fv
from foliary.session import new_folder

AT_WORK = ("start", "heartbeat")
ENDED = {"complete": "COMPLETED", "fail": "FAILED"}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUTPUT = "document_id long, seen long, status string, changed long"


class SilentDocuments(StatefulProcessor):
    """Times are microseconds, so that no worker's time zone matters."""

    def __init__(self, seconds: int):
        self.threshold = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "micros long, kind string")
        self.queued = handle.getValueState("queued", "micros long")

    def timer_of(self, micros: int) -> int:
        """Milliseconds at which an event can be decided."""
        return -(-(micros + self.threshold) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [(row["micros"], row["kind"]) for row in rows]
        self.pending.appendList(fresh)
        # a timer decides all that is due by then, and sets the next one
        self.handle.registerTimer(self.timer_of(min(micros for micros, _ in fresh)))
        if self.queued.exists():
            since = self.queued.get()[0]
            later = sorted(e for e in fresh if e[0] > since and e[1] in ENDED)
            if later:
                self.queued.clear()
                micros, kind = later[0]
                yield Row(document_id=key[0], seen=micros, status=ENDED[kind], changed=micros)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # timers that expire together find the first one's work done
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        events = sorted(tuple(e) for e in self.pending.get())
        decided = bisect_right(events, due, key=lambda e: self.timer_of(e[0]))
        if not decided:
            return
        ends = [micros for micros, kind in events if kind in ENDED]
        since = None
        for i, (micros, kind) in enumerate(events[:decided]):
            following = events[i + 1][0] if i + 1 < len(events) else None
            if kind in AT_WORK and (following is None or following - micros > self.threshold):
                # an end that came before this decision needs no correction
                if not ends or ends[-1] <= micros:
                    since = micros
                yield Row(document_id=key[0], seen=micros, status="QUEUED", changed=micros + self.threshold)
        if since is not None:
            self.queued.update((since,))
        left = events[decided:]
        if left:
            self.pending.put(left)
            self.handle.registerTimer(self.timer_of(left[0][0]))
        else:
            self.pending.clear()

    def close(self) -> None:
        pass


def silent_documents_by_timer(events: DataFrame, delay: str = "10 minutes", seconds: int = fv.ZOMBIE_SECONDS) -> DataFrame:
    """``document_id, last_seen, status, changed_at`` of a stream of events (``document_id, ts, kind``); see the module."""
    stamped = events.select("document_id", F.col("ts").cast("timestamp").alias("ts"), "kind").withWatermark("ts", delay)
    keyed = stamped.select(F.col("document_id").cast("long").alias("document_id"), "ts", F.unix_micros("ts").alias("micros"), "kind")
    rows = keyed.groupBy("document_id").transformWithState(
        statefulProcessor=SilentDocuments(seconds), outputStructType=_OUTPUT, outputMode="append", timeMode="EventTime"
    )
    return rows.select("document_id", F.timestamp_micros("seen").alias("last_seen"), "status", F.timestamp_micros("changed").alias("changed_at"))


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Timers need this state store; the session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_silent_documents(events: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Process all events that are there, go on from the checkpoint in ``folder`` if it has one, and return the table."""
    spark = events.sparkSession
    folder = folder or new_folder(spark, "silent")
    result = silent_documents_by_timer(events, **options)
    with state_in_rocksdb(spark):
        query = (
            result.writeStream.format("parquet")
            .option("path", f"{folder}/rows")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/rows")
