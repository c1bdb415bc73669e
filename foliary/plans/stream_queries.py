"""Registered queries: streaming jobs run over the given tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.plans.derived import Tables
from foliary.plans.registry import query
from foliary.session import new_folder
from foliary.streaming import jobs, timers


def _stream(t: Tables, name: str):
    schema = t.spark.read.parquet(f"{t.folder}/{name}.parquet").schema
    return jobs.stream_table(t.spark, t.folder, name, schema)


@query(
    "T01_ingest",
    """SELECT sha256(text) AS content_hash, min(concat('f', doc_id, '.pdf')) AS file_id, 'QUEUED' AS status FROM documents GROUP BY 1""",
)
def ingest(t: Tables):
    files = _stream(t, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.length("text").cast("long").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
        F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
    )
    folder = new_folder(t.spark, "ingest")
    jobs.ingest(jobs.ingest_rows(files), f"{folder}/catalog", f"{folder}/checkpoint")
    rows = t.spark.read.schema(jobs.INGEST_SCHEMA).parquet(f"{folder}/catalog")
    return rows.select("content_hash", "file_id", "status")


_SILENT = """SELECT document_id, CAST(ts AS VARCHAR) AS last_seen, 'QUEUED' AS status FROM
    (SELECT *, lead(ts) OVER (PARTITION BY document_id ORDER BY ts) AS nxt FROM status_events)
    WHERE kind IN ('start','heartbeat') AND (nxt IS NULL OR nxt - ts > INTERVAL '360' SECOND)"""


@query(
    "T02_silent_documents",
    _SILENT
    + " AND ts + INTERVAL '360' SECOND <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10' MINUTE FROM events)",
)
def silent_documents(t: Tables):
    events = _stream(t, "events").select(
        F.col("user_id").alias("document_id"), "ts", _kind().alias("kind")
    )
    rows = jobs.run_available(jobs.silent_documents(events), "silent")
    return rows.select("document_id", "last_seen", "status")


def _kind():
    e = F.col("event_type")
    return (
        F.when(e == "signup", "start")
        .when(e.isin("view", "click"), "heartbeat")
        .when(e == "purchase", "complete")
        .otherwise("fail")
    )


@query(
    "T02_silent_documents_by_timer",
    _SILENT
    + " AND ts + INTERVAL '360' SECOND <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10' MINUTE FROM events)",
)
def silent_documents_by_timer(t: Tables):
    """By state and timers instead of session windows."""
    events = _stream(t, "events").select(
        F.col("user_id").alias("document_id"), "ts", _kind().alias("kind")
    )
    rows = timers.run_silent_documents(events)
    return rows.where("status = 'QUEUED'").select("document_id", "last_seen", "status")


@query("T02_silent_documents_batch", _SILENT)
def silent_documents_batch(t: Tables):
    """The same operator on the table."""
    events = t.status_events.select("document_id", "ts", "kind")
    return jobs.silent_documents(events).select("document_id", "last_seen", "status")


@query(
    "T03_daily_counts",
    """SELECT event_type AS series, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS count FROM events
    WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL '1' DAY <= (SELECT max(ts) - INTERVAL '1' HOUR FROM events) GROUP BY ALL""",
)
def daily_counts(t: Tables):
    return jobs.run_available(jobs.daily_counts(_stream(t, "events"), "event_type"), "daily")


@query(
    "T04_zero_result_alerts",
    """SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, count(*) AS zero_results FROM events WHERE (event_type='error' OR floor(value)=0)
    AND date_trunc('hour', ts) + INTERVAL '1' HOUR <= (SELECT max(ts) - INTERVAL '10' MINUTE FROM events WHERE event_type='error' OR floor(value)=0) GROUP BY 1 HAVING count(*) >= 2""",
)
def zero_result_alerts(t: Tables):
    searches = _stream(t, "events").select(
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "error", 0)
        .otherwise(F.floor("value").cast("int"))
        .alias("result_count"),
    )
    return jobs.run_available(jobs.zero_result_alerts(searches, at_least=2), "alerts")
