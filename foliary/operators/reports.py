"""Dashboard, quality, temporal and usage reports.

Each report is one pass over its table: conditional counts side by side in a
single aggregation, or a grouped count reduced to its top rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.operators.common import before, frequency, moment, percent, seconds, top_k



def _is(status: str) -> Column:
    return F.col("status") == status


def catalog_statistics(catalog: DataFrame, as_of) -> DataFrame:
    """Totals, four status counts, uploads of the last week, sizes."""
    size = F.sum("file_size")
    return catalog.agg(
        F.count("*").alias("total_documents"),
        *[
            F.count_if(_is(s)).alias(s.lower())
            for s in fv.STATUSES
            if s != "QUEUED"
        ],
        F.count_if(F.col("created_at") >= before(as_of, days=7)).alias("recent_uploads"),
        F.coalesce(F.floor(F.avg("file_size")), F.lit(0)).cast("long").alias("average_file_size"),
        F.coalesce(size, F.lit(0)).alias("total_storage_bytes"),
        F.round(F.coalesce(size, F.lit(0)) / (1024 * 1024), 2).alias("total_storage_mb"),
    )


def processing_metrics(catalog: DataFrame, as_of) -> DataFrame:
    """Success rate, mean time from upload to completion, waiting, last day."""
    done, failed = F.count_if(_is("COMPLETED")), F.count_if(_is("FAILED"))
    took = seconds(F.col("processed_at")) - seconds(F.col("created_at"))
    return catalog.agg(
        percent(done, done + failed, 100.0).alias("processing_success_rate"),
        F.coalesce(F.avg(F.when(_is("COMPLETED"), took)), F.lit(0.0)).alias(
            "average_processing_time_seconds"
        ),
        F.count_if(_is("PENDING")).alias("queue_depth"),
        F.count_if(_is("COMPLETED") & (F.col("processed_at") >= before(as_of, days=1))).alias(
            "processing_throughput_24h"
        ),
    )


def analysis_quality(catalog: DataFrame) -> DataFrame:
    """Share of completed documents with analysis, mappings and vector."""
    done = F.count_if(_is("COMPLETED"))

    def share(condition):
        return percent(F.count_if(_is("COMPLETED") & condition), done, 0.0)

    return catalog.agg(
        share(F.col("ai_analysis").isNotNull()).alias("analysis_completion_rate"),
        share(F.col("mapping_count") > 0).alias("keyword_mapping_success_rate"),
        share(F.col("search_vector").isNotNull()).alias("embedding_generation_rate"),
    )


def engagement(catalog: DataFrame, searches: DataFrame, as_of) -> DataFrame:
    """Searches and uploads of the last week."""
    week = before(as_of, days=7)
    uploads = catalog.agg(F.count_if(F.col("created_at") >= week))
    return searches.agg(
        F.count_if(F.col("timestamp") >= week).alias("search_query_volume_7d")
    ).withColumn("upload_volume_7d", uploads.scalar())


def top_queries(searches: DataFrame, limit: int = 8) -> DataFrame:
    """Most frequent query texts."""
    return top_k(frequency(searches, "query", "query"), limit, "count", "query")


def queue_health(catalog: DataFrame, as_of) -> DataFrame:
    """Documents per status, total, and age of the oldest queued one."""
    oldest = F.min(F.when(_is("QUEUED"), F.col("created_at")))
    return catalog.agg(
        *[F.count_if(_is(s)).alias(s.lower()) for s in fv.STATUSES],
        F.count_if(F.col("status").isin(fv.STATUSES)).alias("total"),
        (seconds(moment(as_of)) - seconds(oldest)).alias("oldest_queued_seconds"),
    )


def key_metrics(catalog: DataFrame, as_of) -> DataFrame:
    """Completed, weekly success rate, mean worker time, waiting."""
    recent = F.col("processed_at") >= before(as_of, days=7)
    done = F.count_if(recent & _is("COMPLETED"))
    failed = F.count_if(recent & _is("FAILED"))
    took = seconds(F.col("processed_at")) - seconds(F.col("processing_started_at"))
    return catalog.agg(
        F.count_if(_is("COMPLETED")).alias("completed_documents"),
        percent(done, done + failed, 100.0).alias("success_rate_7d"),
        F.round(F.coalesce(F.avg(F.when(_is("COMPLETED"), took)), F.lit(0.0)), 2).alias(
            "avg_processing_time_seconds"
        ),
        F.count_if(_is("PENDING")).alias("queue_depth"),
    )


def daily_counts(rows: DataFrame, ts: str, as_of, days: int = 30) -> DataFrame:
    """Rows per calendar day of the last ``days`` days."""
    return (
        rows.filter(F.col(ts) >= before(as_of, days=days))
        .groupBy(F.to_date(ts).alias("date"))
        .agg(F.count("*").alias("count"))
    )


def daily_trends(catalog: DataFrame, searches: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Uploads, completions and searches per day, as ``(series, date, count)``."""
    series = {
        "uploads": daily_counts(catalog, "created_at", as_of, days),
        "completions": daily_counts(
            catalog.filter(_is("COMPLETED")), "processed_at", as_of, days
        ),
        "searches": daily_counts(searches, "timestamp", as_of, days),
    }
    parts = [d.select(F.lit(n).alias("series"), "date", "count") for n, d in series.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def status_breakdown(catalog: DataFrame) -> DataFrame:
    """Documents per status for the four reported ones, zero included."""
    shown = ["PENDING", "PROCESSING", "COMPLETED", "FAILED"]
    return catalog.agg(*[F.count_if(_is(s)).alias(s.lower()) for s in shown])


def recent_documents(catalog: DataFrame, limit: int = 10) -> DataFrame:
    return (
        catalog.select("id", "filename", "status", "created_at", "processed_at")
        .orderBy(F.col("created_at").desc(), "id")
        .limit(limit)
    )


def review_reasons(catalog: DataFrame) -> DataFrame:
    """How many documents need review, by reason."""
    text = F.col("extracted_text")
    done = _is("COMPLETED")
    return catalog.agg(
        F.count_if(F.col("needs_review")).alias("needs_review_flagged"),
        F.count_if(done & F.col("search_vector").isNull()).alias("missing_embeddings"),
        F.count_if(done & (text.isNull() | (text == ""))).alias("missing_text"),
        F.count_if(done & F.col("mapping_count").isNull()).alias("missing_keywords"),
        F.count_if(F.col("processing_error").isNotNull()).alias("has_errors"),
        *[
            F.count_if(F.col(f"{f}_confidence") == "LOW").alias(f"low_{f}_confidence")
            for f in ("date", "client", "state")
        ],
    )


def confidence_distribution(catalog: DataFrame) -> DataFrame:
    """Documents per field and confidence level."""
    fields = ["date", "client", "state"]
    levels = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.col(f"{f}_confidence").alias("level"))
                for f in fields
            ]
        )
    )
    return (
        catalog.select(levels.alias("x"))
        .select("x.field", "x.level")
        .filter(F.col("level").isNotNull())
        .groupBy("field", "level")
        .agg(F.count("*").alias("count"))
    )


def weakest_clients(catalog: DataFrame, at_least: int = 3, limit: int = 15) -> DataFrame:
    """Clients with the lowest mean confidence.  No confidence counts as LOW."""

    def points(field):
        c = F.col(f"{field}_confidence")
        return F.when(c == "HIGH", 1.0).when(c == "MEDIUM", 0.5).otherwise(0.0)

    quality = points("date") + points("client") + points("state")
    graded = (
        catalog.filter(F.col("client_canonical").isNotNull())
        .groupBy(F.col("client_canonical").alias("client"))
        .agg(
            F.count("*").alias("doc_count"),
            F.round(F.avg(quality) / 3.0, 3).alias("avg_quality"),
        )
        .filter(F.col("doc_count") >= at_least)
    )
    return top_k(graded, limit, "avg_quality", "client", descending=False)


def top_clients(catalog: DataFrame, limit: int = 20) -> DataFrame:
    return top_k(
        frequency(catalog, "client_canonical", "client", "doc_count"),
        limit,
        "doc_count",
        "client",
    )


def dirty_clients(catalog: DataFrame, limit: int = 20) -> DataFrame:
    """Canonical clients with several raw spellings.  Spellings are counted
    before clients, so a client with very many rows is already reduced when it
    reaches its group."""
    spellings = (
        catalog.filter(F.col("client_canonical").isNotNull() & F.col("client").isNotNull())
        .groupBy("client_canonical", "client")
        .agg(F.count("*").alias("n"))
    )
    clients = (
        spellings.groupBy(F.col("client_canonical").alias("client"))
        .agg(F.count("*").alias("variants"), F.sum("n").alias("doc_count"))
        .filter(F.col("variants") > 1)
    )
    return top_k(clients, limit, "variants", "client")


def _with_state(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.trim("state").alias("state"), "is_frank").filter(
        F.col("state") != ""
    )


def state_distribution(catalog: DataFrame) -> DataFrame:
    """Documents per state and share of the total."""
    counted = _with_state(catalog).groupBy("state").agg(F.count("*").alias("doc_count"))
    return share_of_total(counted, "doc_count", "pct")


def share_of_total(counted: DataFrame, count: str, name: str, digits: int = 1) -> DataFrame:
    """Percentage of the grand total beside each aggregated row."""
    total = counted.agg(F.sum(count)).scalar()
    return counted.withColumn(name, F.round(F.col(count) * 100.0 / total, digits))


def frank_by_state(catalog: DataFrame) -> DataFrame:
    return (
        _with_state(catalog)
        .groupBy("state")
        .agg(F.count_if("is_frank").alias("frank_count"), F.count("*").alias("total"))
    )


def frank_totals(catalog: DataFrame) -> DataFrame:
    franked, total = F.count_if("is_frank"), F.count("*")
    return catalog.agg(
        total.alias("total"),
        franked.alias("frank_count"),
        percent(franked, total, 0.0, 1).alias("frank_pct"),
    )


def frank_by_client(catalog: DataFrame, limit: int = 15) -> DataFrame:
    counted = (
        catalog.filter(F.col("client_canonical").isNotNull())
        .groupBy(F.col("client_canonical").alias("client"))
        .agg(F.count_if("is_frank").alias("frank_count"), F.count("*").alias("total"))
        .filter(F.col("frank_count") > 0)
    )
    return top_k(counted, limit, "frank_count", "client")


def _month() -> Column:
    return F.date_trunc("month", F.col("date_created")).cast("date").alias("month")


def frank_by_month(catalog: DataFrame) -> DataFrame:
    return (
        catalog.filter(F.col("date_created").isNotNull())
        .groupBy(_month())
        .agg(F.count_if("is_frank").alias("frank_count"), F.count("*").alias("total"))
    )


def filter_usage(searches: DataFrame) -> DataFrame:
    """How often each search filter is used, empty results, filter-only use."""
    filters = ["client", "state", "date_year"]
    used = {f: F.col(f"filter_{f}").isNotNull() for f in filters}
    return searches.agg(
        F.count("*").alias("total_searches_logged"),
        *[F.count_if(used[f]).alias(f"used_{f}") for f in filters],
        F.count_if(F.col("result_count") == 0).alias("zero_result_searches"),
        F.count_if(
            (F.col("query") == fv.FILTER_ONLY_LABEL)
            & (used["client"] | used["state"] | used["date_year"])
        ).alias("filter_only_searches"),
    )


def top_filter_values(searches: DataFrame, limit: int = 10) -> DataFrame:
    """Most used values of each filter, as ``(filter, value, count)``.  The log
    is read once: its filter combinations are counted first."""
    filters = ["client", "state", "date_year"]
    columns = [f"filter_{f}" for f in filters]
    combos = searches.groupBy(*columns).agg(F.count("*").alias("n"))
    value = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("filter"), F.col(f"filter_{f}").cast("string").alias("value"))
                for f in filters
            ]
        )
    )
    counted = (
        combos.select(value.alias("x"), "n")
        .filter(F.col("x.value").isNotNull())
        .groupBy("x.filter", "x.value")
        .agg(F.sum("n").alias("count"))
    )
    parts = [
        top_k(counted.filter(F.col("filter") == f), limit, "count", "value") for f in filters
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def top_zero_result_queries(searches: DataFrame, limit: int = 10) -> DataFrame:
    empty = searches.filter(F.col("result_count") == 0)
    return top_k(frequency(empty, "query", "query"), limit, "count", "query")


def documents_by_month(catalog: DataFrame) -> DataFrame:
    return (
        catalog.filter(F.col("date_created").isNotNull())
        .groupBy(_month())
        .agg(F.count("*").alias("doc_count"))
    )


def busiest_days(catalog: DataFrame, limit: int = 10) -> DataFrame:
    days = frequency(catalog, "date_created", "date", "doc_count")
    return top_k(days, limit, "doc_count", "date")


def average_lag(catalog: DataFrame) -> DataFrame:
    """Mean days from the document's own date to its upload."""
    lag = (seconds(F.col("created_at")) - seconds(F.col("date_created"))) / 86400
    return catalog.agg(F.round(F.avg(lag), 1).alias("avg_lag_days"))


def year_facet(catalog: DataFrame) -> DataFrame:
    """Valid document years of documents whose date is not under review."""
    flagged = F.coalesce(F.col("needs_date_review"), F.lit(False))
    year = F.year("date_created")
    return (
        catalog.filter(~flagged & year.between(*fv.VALID_YEARS))
        .select(year.alias("year"))
        .distinct()
    )


def client_facet(catalog: DataFrame) -> DataFrame:
    """All clients with their document counts."""
    return frequency(
        catalog.filter(F.col("client_canonical") != ""), "client_canonical", "client"
    )


def review_count(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count_if(
            F.coalesce(F.col("needs_date_review"), F.lit(False))
            | F.coalesce(F.col("needs_review"), F.lit(False))
        ).alias("count")
    )


def date_parts(df: DataFrame, ts: str, date: str) -> DataFrame:
    """Calendar parts of a time stamp as the reports use them, and its distance
    from a date."""
    c = F.col(ts)
    return df.select(
        "id",
        F.to_date(c).alias("day"),
        F.date_trunc("month", c).cast("date").alias("month"),
        F.year(c).alias("year"),
        seconds(c).alias("epoch"),
        (seconds(c) - seconds(F.col(date))).alias("lag_seconds"),
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
    )
