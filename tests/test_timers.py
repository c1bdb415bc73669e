"""Silent documents by state and timers: out-of-order events, restarts, late completions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliary.session import new_folder
from foliary.streaming import timers

START = datetime(2024, 1, 1)
SCHEMA = "document_id long, t string, kind string"


def stored(spark, path, rows):
    text = [(d, str(START + timedelta(seconds=s)), k) for d, s, k in rows]
    df = spark.createDataFrame(text, SCHEMA).select("document_id", F.to_timestamp("t").alias("ts"), "kind")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def run(spark, path, schema, folder):
    stream = spark.readStream.schema(schema).parquet(path)
    out = timers.run_silent_documents(stream, folder).collect()
    seconds = lambda x: round((x - START).total_seconds())
    return sorted((r["document_id"], seconds(r["last_seen"]), r["status"], seconds(r["changed_at"])) for r in out)


def silent(rows, until, threshold=360):
    """The rule itself: an event at work that nothing follows within the threshold."""
    out = []
    for d in {d for d, _, _ in rows}:
        own = sorted((s, k) for e, s, k in rows if e == d)
        for (s, k), following in zip(own, [*(s for s, _ in own[1:]), None]):
            if k in timers.AT_WORK and (following is None or following - s > threshold) and s + threshold <= until:
                out.append((d, s, "QUEUED", s + threshold))
    return sorted(out)


def test_events_out_of_order_and_restarts(spark):
    r = random.Random(3)
    rows = {(d, r.randrange(9000), r.choice(["start", "heartbeat", "heartbeat", "complete", "fail"])) for d in range(12) for _ in range(25)}
    rows = list({(d, s): (d, s, k) for d, s, k in sorted(rows)}.values())
    # an event comes at most nine minutes after others that are later
    arrived = sorted(rows, key=lambda x: x[1] + r.randrange(540))
    path, folder = new_folder(spark, "events"), new_folder(spark, "silent")
    for i in range(4):
        schema = stored(spark, path, arrived[len(arrived) * i // 4 : len(arrived) * (i + 1) // 4])
        found = run(spark, path, schema, folder)
    last = max(s for _, s, _ in rows)
    assert [x for x in found if x[2] == "QUEUED"] == silent(rows, last - 600)
    # whatever was taken back had been sent back before
    for d, s, status, _ in found:
        if status != "QUEUED":
            assert any(e == d and q == "QUEUED" and at < s for e, at, q, _ in found)


def test_a_completion_after_the_timeout_takes_it_back(spark):
    path, folder = new_folder(spark, "events"), new_folder(spark, "silent")
    schema = stored(spark, path, [(1, 0, "start"), (2, 0, "start"), (2, 100, "complete"), (9, 2000, "start")])
    assert run(spark, path, schema, folder) == [(1, 0, "QUEUED", 360)]
    stored(spark, path, [(1, 2500, "complete"), (9, 2100, "heartbeat")])
    assert run(spark, path, schema, folder) == [(1, 0, "QUEUED", 360), (1, 2500, "COMPLETED", 2500)]
    # a second completion corrects nothing, and a run without news adds nothing
    stored(spark, path, [(1, 2600, "complete"), (9, 2300, "heartbeat")])
    two = run(spark, path, schema, folder)
    assert two == run(spark, path, schema, folder)
    assert [x for x in two if x[0] == 1] == [(1, 0, "QUEUED", 360), (1, 2500, "COMPLETED", 2500)]
    assert spark.conf.get(timers.PROVIDER, None) != timers.ROCKS


class CountedState:
    """List, value and timers of one document, and how often they are used."""

    def __init__(self):
        self.events, self.since, self.timers, self.reads = [], None, set(), 0

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        state = CountedState()
        state.exists = lambda: False
        state.update = lambda value: None
        return state

    def appendList(self, rows):
        self.events += rows

    def put(self, rows):
        self.events = list(rows)

    def clear(self):
        self.events = []

    def get(self):
        self.reads += 1
        return list(self.events)

    def registerTimer(self, millis):
        self.timers.add(millis)


def test_due_events_are_decided_in_one_pass():
    """The work of a document grows with its events, not with their square."""
    state, seconds = CountedState(), 1_000_000
    processor = timers.SilentDocuments(360)
    processor.init(state)
    rows = [{"micros": i * 400 * seconds, "kind": "heartbeat"} for i in range(300)]
    list(processor.handleInputRows((1,), iter(rows), None))
    assert len(state.timers) == 1

    class Now:
        def getCurrentWatermarkInMs(self):
            return 250 * 400 * 1000 + 360 * 1000

    class First:
        def getExpiryTimeInMs(self):
            return min(state.timers)

    out = list(processor.handleExpiredTimer((1,), Now(), First()))
    assert [r["seen"] for r in out] == [i * 400 * seconds for i in range(251)]
    assert state.reads == 1 and len(state.events) == 49 and len(state.timers) == 2
