"""Selections and views of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.functions import analysis as an
from foliary.functions.text import contains_term, download_path, preview_path, query_reject_reason
from foliary.operators.common import before, lookup_join

SEARCH_COLUMNS = [
    "id", "filename", "file_size", "status", "created_at", "ai_analysis", "keywords",
    "thumbnail_url", "file_path", "client_canonical", "state", "date_created",
]
REVIEW_COLUMNS = [
    "id", "filename", "needs_date_review", "needs_review", "date_created", "date_confidence",
    "client_canonical", "client_confidence", "state", "state_confidence", "created_at",
]
DONE_OR_FAILED = ["COMPLETED", "FAILED"]


def newest_first(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), "id").limit(limit)


def document_by_id(catalog: DataFrame, doc_id: int) -> DataFrame:
    return catalog.filter(F.col("id") == doc_id).limit(1)


def list_documents(
    catalog: DataFrame,
    status: str | None = None,
    order_by: str = "created_at",
    descending: bool = True,
    skip: int = 0,
    limit: int = 100,
) -> DataFrame:
    """One page of documents; ids break ties so that pages do not overlap."""
    if status:
        catalog = catalog.filter(F.col("status") == status)
    key = F.col(order_by).desc() if descending else F.col(order_by).asc()
    return catalog.orderBy(key, "id").offset(skip).limit(limit)


def narrow(catalog: DataFrame) -> DataFrame:
    """The columns a result page needs; the scan reads no others."""
    return catalog.select(*SEARCH_COLUMNS)


def document_view(
    catalog: DataFrame, full_detail: bool = False, include_heavy: bool = False
) -> DataFrame:
    """Result view: summary columns, on request full detail and heavy columns."""
    mappings = F.coalesce(F.col("keywords.keyword_mappings"), an.no_mappings())
    analysis = an.parse_analysis(F.col("ai_analysis"))
    columns = [
        F.col("id"),
        F.col("filename"),
        F.col("file_size"),
        F.col("status"),
        F.col("created_at"),
        an.summary_of(analysis).alias("summary"),
        an.canonical_terms(mappings).alias("canonical_terms"),
        F.col("thumbnail_url"),
        preview_path(F.col("file_path")).alias("preview_url"),
        download_path(F.col("id"), F.col("file_path")).alias("download_url"),
        F.col("search_vector").isNotNull().alias("has_embeddings"),
        F.col("client_canonical"),
        F.trim("state").alias("state"),
        F.col("date_created"),
        F.coalesce("needs_date_review", F.lit(False)).alias("needs_date_review"),
    ]
    if full_detail:
        columns += [
            F.col("processing_progress"),
            F.col("updated_at"),
            F.col("processed_at"),
            F.col("keywords"),
            F.col("processing_error"),
            F.coalesce("keywords.mapping_count", F.lit(0)).alias("mapping_count"),
            an.verbatim_terms(mappings).alias("verbatim_terms"),
            mappings.alias("keyword_mappings"),
        ]
    if include_heavy:
        columns += [F.col("extracted_text"), F.col("ai_analysis")]
    return catalog.select(*columns)


def substring_search(catalog: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Completed documents whose name or content contains the text."""
    hit = contains_term(F.col("filename"), text) | contains_term(F.col("search_content"), text)
    return newest_first(catalog.filter((F.col("status") == "COMPLETED") & hit), limit)


def editor_search(
    catalog: DataFrame, text: str = "", doc_id: int | None = None, limit: int = 25
) -> DataFrame:
    """By id, else by file or client name; nothing for empty input."""
    if doc_id:
        hit = F.col("id") == doc_id
    elif text:
        hit = contains_term(F.col("filename"), text) | contains_term(
            F.col("client_canonical"), text
        )
    else:
        hit = F.lit(False)
    return newest_first(catalog.filter(hit).select(*REVIEW_COLUMNS), limit)


def exact_filters(
    catalog: DataFrame,
    client: str | None = None,
    state: str | None = None,
    year: int | None = None,
) -> DataFrame:
    if client:
        catalog = catalog.filter(F.col("client_canonical") == client)
    if state:
        catalog = catalog.filter(F.trim("state") == state)
    if year:
        catalog = catalog.filter(F.year("date_created") == year)
    return catalog


def taxonomy_filter(
    catalog: DataFrame,
    links: DataFrame,
    taxonomy: DataFrame,
    primary_category: str | None = None,
    subcategory: str | None = None,
    bag: bool = False,
) -> DataFrame:
    """Documents with a linked term of the category and subcategory; both must
    hold on the same term.  ``bag=True`` repeats a document per such term."""
    terms = taxonomy
    if primary_category:
        terms = terms.filter(F.col("primary_category") == primary_category)
    if subcategory:
        terms = terms.filter(F.col("subcategory") == subcategory)
    terms = terms.select(F.col("id").alias("taxonomy_term_id"))
    hits = lookup_join(links, terms, "taxonomy_term_id", "inner").select(
        F.col("document_id").alias("id")
    )
    return catalog.join(hits, "id", "inner" if bag else "left_semi")


def _mapping_contains(fields: list[str], term: str) -> Column:
    def test(m):
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(contains_term(m[f], term), F.lit(False))
        return hit

    return F.exists("keywords.keyword_mappings", test)


def canonical_term_filter(catalog: DataFrame, term: str) -> DataFrame:
    """Any mapping whose canonical or verbatim term contains the text."""
    return catalog.filter(_mapping_contains(["mapped_canonical_term", "verbatim_term"], term))


def verbatim_term_search(
    catalog: DataFrame, term: str, matching: DataFrame | None = None, limit: int = 20
) -> DataFrame:
    """Completed documents with such a verbatim term, newest first; ``matching``
    (ids of a full-text match) narrows them further."""
    hits = catalog.filter(
        (F.col("status") == "COMPLETED") & _mapping_contains(["verbatim_term"], term)
    )
    if matching is not None:
        hits = hits.join(matching.select("id").distinct(), "id", "left_semi")
    return newest_first(hits, limit)


def failed_documents(catalog: DataFrame, limit: int = 50) -> DataFrame:
    return (
        catalog.filter(F.col("status") == "FAILED")
        .orderBy(F.col("updated_at").desc_nulls_last(), "id")
        .limit(limit)
    )


def stuck_documents(catalog: DataFrame, as_of, hours: int = 2) -> DataFrame:
    return catalog.filter(
        (F.col("status") == "PROCESSING") & (F.col("updated_at") < before(as_of, hours=hours))
    )


def is_zombie(as_of, threshold: int = fv.ZOMBIE_SECONDS) -> Column:
    """PROCESSING with a stale heartbeat, or without heartbeat and with a stale
    or missing start."""
    cutoff = before(as_of, seconds=threshold)
    beat, start = F.col("processing_heartbeat_at"), F.col("processing_started_at")
    silent = F.when(beat.isNotNull(), beat < cutoff).otherwise(
        start.isNull() | (start < cutoff)
    )
    return (F.col("status") == "PROCESSING") & silent


def zombie_documents(catalog: DataFrame, as_of, threshold: int = fv.ZOMBIE_SECONDS) -> DataFrame:
    return catalog.filter(is_zombie(as_of, threshold))


def incompleteness(catalog: DataFrame) -> DataFrame:
    """Finished documents with one flag per missing part."""
    analysis = an.parse_analysis(F.col("ai_analysis"))
    summary, error = analysis["summary"], analysis["error"]
    text = F.col("extracted_text")
    return catalog.filter(F.col("status").isin(DONE_OR_FAILED)).select(
        "id",
        "filename",
        "status",
        "created_at",
        "processed_at",
        "processing_error",
        (
            F.col("ai_analysis").isNull()
            | summary.isNull()
            | (summary == "")
            | summary.ilike(f"%{fv.UNUSABLE_SUMMARY}%")
            | error.isNotNull()
        ).alias("summary"),
        (text.isNull() | (text == "")).alias("extracted_text"),
        (F.col("keywords").isNull() | error.isNotNull()).alias("keywords"),
        F.col("search_vector").isNull().alias("embeddings"),
    )


INCOMPLETE_PARTS = ["summary", "extracted_text", "keywords", "embeddings"]


def incomplete_documents(catalog: DataFrame, limit: int = 100) -> DataFrame:
    """The newest documents that miss each part, as ``(missing, …)`` rows."""
    flagged = incompleteness(catalog)
    shown = ["id", "filename", "status", "created_at", "processed_at", "processing_error"]
    lists = [
        newest_first(flagged.filter(F.col(part)), limit).select(
            F.lit(part).alias("missing"), *shown
        )
        for part in INCOMPLETE_PARTS
    ]
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


def incomplete_total(listed: DataFrame) -> DataFrame:
    """Distinct documents over all lists."""
    return listed.agg(F.countDistinct("id").alias("total_unique_incomplete"))


def review_queue(catalog: DataFrame, limit: int = 500) -> DataFrame:
    return newest_first(
        catalog.filter(F.col("needs_date_review") | F.col("needs_review")).select(
            *REVIEW_COLUMNS
        ),
        limit,
    )


def embedding_backfill(catalog: DataFrame, version: int = fv.EMBEDDING_VERSION) -> DataFrame:
    """Analysed documents with an older vector, or none."""
    current = F.col("embedding_version")
    return catalog.filter(
        F.col("ai_analysis").isNotNull() & (current.isNull() | (current < version))
    )


def recently_updated_first(df: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.col("updated_at").desc_nulls_last(), "id")
    return ordered if limit is None else ordered.limit(limit)


def feature_backfill(catalog: DataFrame) -> DataFrame:
    return catalog.filter(
        (F.col("status") == "COMPLETED")
        & F.col("client_canonical").isNull()
        & F.col("extracted_text").isNotNull()
    )


def mapping_backfill(catalog: DataFrame) -> DataFrame:
    """No stored mappings although the analysis has some."""
    found = an.parse_analysis(F.col("ai_analysis"))["keyword_mappings"]
    stored = F.col("keywords.keyword_mappings")
    none = F.lit(0)
    return catalog.filter(
        (F.coalesce(F.size(stored), none) <= 0) & (F.coalesce(F.size(found), none) > 0)
    )


def guard_queries(searches: DataFrame) -> DataFrame:
    """Query log with the reason of refusal, or the trimmed accepted text."""
    reason = query_reject_reason(F.col("query"))
    return searches.withColumns(
        {
            "reject_reason": reason,
            "accepted_query": F.when(reason.isNull(), F.trim(F.coalesce("query", F.lit("")))),
        }
    )
