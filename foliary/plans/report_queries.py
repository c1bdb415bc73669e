"""Registered queries: dashboard, quality, temporal and usage reports."""

from __future__ import annotations

from foliary.operators import reports as r
from foliary.plans.derived import AS_OF, Tables
from foliary.plans.registry import query

_T = f"TIMESTAMP '{AS_OF}'"


def _pct(part: str, whole: str, empty: str, digits: int = 2) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN round(CAST({part} AS DOUBLE) / {whole} * 100, {digits}) "
        f"ELSE {empty} END"
    )


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


_DONE, _FAILED = "status='COMPLETED'", "status='FAILED'"


@query(
    "A01_catalog_statistics",
    f"""SELECT count(*) AS total_documents, {_n("status='PENDING'")} AS pending,
    {_n("status='PROCESSING'")} AS processing, {_n(_DONE)} AS completed, {_n(_FAILED)} AS failed,
    {_n(f"created_at >= {_T} - INTERVAL '7' DAY")} AS recent_uploads,
    CAST(floor(avg(file_size)) AS BIGINT) AS average_file_size,
    CAST(sum(file_size) AS BIGINT) AS total_storage_bytes,
    round(CAST(sum(file_size) AS DOUBLE) / 1048576, 2) AS total_storage_mb FROM catalog""",
)
def catalog_statistics(t: Tables):
    return r.catalog_statistics(t.catalog("status", "created_at", "file_size"), AS_OF)


@query(
    "A02_processing_metrics",
    f"""SELECT {_pct(_n(_DONE), _n("status IN ('COMPLETED','FAILED')"), "100.0")} AS processing_success_rate,
    avg(epoch(processed_at) - epoch(created_at)) FILTER (WHERE {_DONE}) AS average_processing_time_seconds,
    {_n("status='PENDING'")} AS queue_depth,
    {_n(f"{_DONE} AND processed_at >= {_T} - INTERVAL '1' DAY")} AS processing_throughput_24h FROM catalog""",
)
def processing_metrics(t: Tables):
    return r.processing_metrics(t.catalog("status", "created_at", "processed_at"), AS_OF)


@query(
    "A03_analysis_quality",
    f"""SELECT {_pct(_n(_DONE + " AND ai_analysis IS NOT NULL"), _n(_DONE), "0.0")} AS analysis_completion_rate,
    {_pct(_n(_DONE + " AND mapping_count > 0"), _n(_DONE), "0.0")} AS keyword_mapping_success_rate,
    {_pct(_n(_DONE + " AND search_vector IS NOT NULL"), _n(_DONE), "0.0")} AS embedding_generation_rate FROM catalog""",
)
def analysis_quality(t: Tables):
    return r.analysis_quality(t.catalog("status", "ai_analysis", "mapping_count", "search_vector"))


@query(
    "A04_engagement",
    f"""SELECT (SELECT count(*) FROM search_queries WHERE timestamp >= {_T} - INTERVAL '7' DAY) AS search_query_volume_7d,
    (SELECT count(*) FROM catalog WHERE created_at >= {_T} - INTERVAL '7' DAY) AS upload_volume_7d""",
)
def engagement(t: Tables):
    return r.engagement(t.catalog("created_at"), t.search_queries, AS_OF)


@query(
    "A05_queue_health",
    f"""SELECT {", ".join(_n(f"status='{s}'") + f" AS {s.lower()}" for s in ["PENDING", "QUEUED", "PROCESSING", "COMPLETED", "FAILED"])},
    count(*) AS total, epoch({_T}) - epoch(min(created_at) FILTER (WHERE status='QUEUED')) AS oldest_queued_seconds FROM catalog""",
)
def queue_health(t: Tables):
    return r.queue_health(t.catalog("status", "created_at"), AS_OF)


@query(
    "A06_key_metrics",
    f"""SELECT {_n(_DONE)} AS completed_documents,
    {_pct(_n(f"{_DONE} AND processed_at >= {_T} - INTERVAL '7' DAY"), _n(f"status IN ('COMPLETED','FAILED') AND processed_at >= {_T} - INTERVAL '7' DAY"), "100.0")} AS success_rate_7d,
    round(avg(epoch(processed_at) - epoch(processing_started_at)) FILTER (WHERE {_DONE}), 2) AS avg_processing_time_seconds,
    {_n("status='PENDING'")} AS queue_depth FROM catalog""",
)
def key_metrics(t: Tables):
    return r.key_metrics(
        t.catalog("status", "processed_at", "processing_started_at"), AS_OF
    )


@query(
    "A07_daily_trends",
    f"""SELECT 'uploads' AS series, CAST(CAST(created_at AS DATE) AS VARCHAR) AS date, count(*) AS count FROM catalog
    WHERE created_at >= {_T} - INTERVAL '30' DAY GROUP BY ALL
    UNION ALL SELECT 'completions', CAST(CAST(processed_at AS DATE) AS VARCHAR), count(*) FROM catalog
    WHERE processed_at >= {_T} - INTERVAL '30' DAY AND {_DONE} GROUP BY ALL
    UNION ALL SELECT 'searches', CAST(CAST(timestamp AS DATE) AS VARCHAR), count(*) FROM search_queries
    WHERE timestamp >= {_T} - INTERVAL '30' DAY GROUP BY ALL""",
)
def daily_trends(t: Tables):
    return r.daily_trends(
        t.catalog("status", "created_at", "processed_at"), t.search_queries, AS_OF
    )


@query(
    "A08_status_breakdown",
    f"""SELECT {", ".join(_n(f"status='{s}'") + f" AS {s.lower()}" for s in ["PENDING", "PROCESSING", "COMPLETED", "FAILED"])} FROM catalog""",
)
def status_breakdown(t: Tables):
    return r.status_breakdown(t.catalog("status"))


@query(
    "A09_review_reasons",
    f"""SELECT {_n("needs_review")} AS needs_review_flagged, {_n(_DONE + " AND search_vector IS NULL")} AS missing_embeddings,
    {_n(_DONE + " AND coalesce(extracted_text,'')=''")} AS missing_text, {_n(_DONE + " AND mapping_count IS NULL")} AS missing_keywords,
    {_n("processing_error IS NOT NULL")} AS has_errors, {_n("date_confidence='LOW'")} AS low_date_confidence,
    {_n("client_confidence='LOW'")} AS low_client_confidence, {_n("state_confidence='LOW'")} AS low_state_confidence FROM catalog""",
)
def review_reasons(t: Tables):
    return r.review_reasons(
        t.catalog(
            "status", "needs_review", "search_vector", "extracted_text", "mapping_count",
            "processing_error", "date_confidence", "client_confidence", "state_confidence",
        )
    )


@query(
    "A10_confidence_distribution",
    """SELECT 'date' AS field, date_confidence AS level, count(*) AS count FROM catalog WHERE date_confidence IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'client', client_confidence, count(*) FROM catalog WHERE client_confidence IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'state', state_confidence, count(*) FROM catalog WHERE state_confidence IS NOT NULL GROUP BY ALL""",
)
def confidence_distribution(t: Tables):
    return r.confidence_distribution(
        t.catalog("date_confidence", "client_confidence", "state_confidence")
    )


def _points(field: str) -> str:
    return f"CASE {field}_confidence WHEN 'HIGH' THEN CAST(1.0 AS DOUBLE) WHEN 'MEDIUM' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"


@query(
    "A11_weakest_clients",
    f"""SELECT client_canonical AS client, count(*) AS doc_count,
    round(avg({_points("date")} + {_points("client")} + {_points("state")}) / 3.0, 3) AS avg_quality
    FROM catalog WHERE client_canonical IS NOT NULL GROUP BY client_canonical HAVING count(*) >= 3
    ORDER BY avg_quality, client LIMIT 15""",
)
def weakest_clients(t: Tables):
    return r.weakest_clients(
        t.catalog("client_canonical", "date_confidence", "client_confidence", "state_confidence")
    )


@query(
    "A12_top_clients",
    """SELECT client_canonical AS client, count(*) AS doc_count FROM catalog WHERE client_canonical IS NOT NULL
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def top_clients(t: Tables):
    return r.top_clients(t.catalog("client_canonical"))


@query(
    "A13_dirty_clients",
    """SELECT client_canonical AS client, count(DISTINCT client) AS variants, count(*) AS doc_count FROM catalog
    WHERE client_canonical IS NOT NULL AND client IS NOT NULL GROUP BY 1 HAVING count(DISTINCT client) > 1
    ORDER BY 2 DESC, 1 LIMIT 20""",
)
def dirty_clients(t: Tables):
    return r.dirty_clients(t.catalog("client_canonical", "client"))


_STATE_SQL = """SELECT trim(state) AS state, count(*) AS doc_count,
    round(count(*) * CAST(100.0 AS DOUBLE) / sum(count(*)) OVER (), 1) AS pct
    FROM catalog WHERE state IS NOT NULL AND trim(state) <> '' GROUP BY trim(state)"""


@query("A14_state_distribution", _STATE_SQL)
def state_distribution(t: Tables):
    return r.state_distribution(t.catalog("state", "is_frank"))


@query("W02_share_of_total", _STATE_SQL)
def share_of_total(t: Tables):
    return r.state_distribution(t.catalog("state", "is_frank"))


@query(
    "A15_frank_by_state",
    """SELECT trim(state) AS state, count(*) FILTER (WHERE is_frank) AS frank_count, count(*) AS total
    FROM catalog WHERE state IS NOT NULL AND trim(state) <> '' GROUP BY trim(state)""",
)
def frank_by_state(t: Tables):
    return r.frank_by_state(t.catalog("state", "is_frank"))


@query(
    "A16_frank_totals",
    f"""SELECT count(*) AS total, {_n("is_frank")} AS frank_count, {_pct(_n("is_frank"), "count(*)", "0.0", 1)} AS frank_pct FROM catalog""",
)
def frank_totals(t: Tables):
    return r.frank_totals(t.catalog("is_frank"))


@query(
    "A17_frank_by_client",
    """SELECT client_canonical AS client, count(*) FILTER (WHERE is_frank) AS frank_count, count(*) AS total FROM catalog
    WHERE client_canonical IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE is_frank) > 0 ORDER BY 2 DESC, 1 LIMIT 15""",
)
def frank_by_client(t: Tables):
    return r.frank_by_client(t.catalog("client_canonical", "is_frank"))


@query(
    "A18_frank_by_month",
    """SELECT CAST(CAST(date_trunc('month', date_created) AS DATE) AS VARCHAR) AS month,
    count(*) FILTER (WHERE is_frank) AS frank_count, count(*) AS total
    FROM catalog WHERE date_created IS NOT NULL GROUP BY 1""",
)
def frank_by_month(t: Tables):
    return r.frank_by_month(t.catalog("date_created", "is_frank"))


@query(
    "A19_filter_usage",
    f"""SELECT count(*) AS total_searches_logged, count(filter_client) AS used_client, count(filter_state) AS used_state,
    count(filter_date_year) AS used_date_year, {_n("result_count=0")} AS zero_result_searches,
    {_n("query='(filter only)' AND (filter_client IS NOT NULL OR filter_state IS NOT NULL OR filter_date_year IS NOT NULL)")} AS filter_only_searches
    FROM search_queries""",
)
def filter_usage(t: Tables):
    return r.filter_usage(t.search_queries)


def _top_values(f: str) -> str:
    return (
        f"(SELECT '{f}' AS filter, CAST(filter_{f} AS VARCHAR) AS value, count(*) AS count FROM search_queries "
        f"WHERE filter_{f} IS NOT NULL GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 10)"
    )


@query(
    "A19_top_filter_values",
    " UNION ALL ".join("SELECT * FROM " + _top_values(f) for f in ["client", "state", "date_year"]),
)
def top_filter_values(t: Tables):
    return r.top_filter_values(t.search_queries)


@query(
    "A19_top_zero_result_queries",
    "SELECT query, count(*) AS count FROM search_queries WHERE result_count=0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_zero_result_queries(t: Tables):
    return r.top_zero_result_queries(t.search_queries)


@query(
    "A20_documents_by_month",
    """SELECT CAST(CAST(date_trunc('month', date_created) AS DATE) AS VARCHAR) AS month, count(*) AS doc_count
    FROM catalog WHERE date_created IS NOT NULL GROUP BY 1""",
)
def documents_by_month(t: Tables):
    return r.documents_by_month(t.catalog("date_created"))


@query(
    "A20_busiest_days",
    """SELECT CAST(date_created AS VARCHAR) AS date, count(*) AS doc_count FROM catalog
    WHERE date_created IS NOT NULL GROUP BY date_created ORDER BY 2 DESC, date_created LIMIT 10""",
)
def busiest_days(t: Tables):
    return r.busiest_days(t.catalog("date_created"))


@query(
    "A20_average_lag",
    "SELECT round(avg((epoch(created_at) - epoch(CAST(date_created AS TIMESTAMP))) / 86400.0), 1) AS avg_lag_days FROM catalog",
)
def average_lag(t: Tables):
    return r.average_lag(t.catalog("created_at", "date_created"))


@query(
    "A23_top_queries",
    "SELECT query, count(*) AS count FROM search_queries GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
)
def top_queries(t: Tables):
    return r.top_queries(t.search_queries)


@query(
    "A24_year_facet",
    """SELECT DISTINCT CAST(year(date_created) AS BIGINT) AS year FROM catalog
    WHERE year(date_created) BETWEEN 2019 AND 2026 AND needs_date_review IS NOT TRUE""",
)
def year_facet(t: Tables):
    return r.year_facet(t.catalog("date_created", "needs_date_review"))


@query(
    "A25_client_facet",
    "SELECT client_canonical AS client, count(*) AS count FROM catalog WHERE client_canonical <> '' GROUP BY 1",
)
def client_facet(t: Tables):
    return r.client_facet(t.catalog("client_canonical"))


@query(
    "A26_review_count",
    "SELECT count(*) AS count FROM catalog WHERE needs_date_review OR needs_review",
)
def review_count(t: Tables):
    return r.review_count(t.catalog("needs_date_review", "needs_review"))


@query(
    "K05_recent_documents",
    """SELECT id, filename, status, CAST(created_at AS VARCHAR) AS created_at, CAST(processed_at AS VARCHAR) AS processed_at
    FROM catalog ORDER BY catalog.created_at DESC, id LIMIT 10""",
)
def recent_documents(t: Tables):
    return r.recent_documents(t.catalog("id", "filename", "status", "created_at", "processed_at"))


@query(
    "F32_date_scalars",
    """SELECT id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, CAST(CAST(date_trunc('month', created_at) AS DATE) AS VARCHAR) AS month,
    CAST(year(created_at) AS BIGINT) AS year, epoch(created_at) AS epoch,
    epoch(created_at) - epoch(CAST(date_created AS TIMESTAMP)) AS lag_seconds, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM catalog""",
)
def date_scalars(t: Tables):
    return r.date_parts(t.catalog("id", "created_at", "date_created"), "created_at", "date_created")
