"""Registered queries: selections, views, taxonomy links, facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.functions import analysis as an
from foliary.functions import text as tx
from foliary.operators import filters as f
from foliary.operators import mappings as m
from foliary.plans.derived import AS_OF, Tables
from foliary.plans.registry import query

_T = f"TIMESTAMP '{AS_OF}'"
_DONE = "status='COMPLETED'"
_NEWEST = "ORDER BY catalog.created_at DESC, id"


def _preview() -> str:
    return "concat('/previews/', regexp_replace(filename, '\\.[^.]*$', ''), '_preview.png')"


# mappings stored in the catalog's keywords
_STORED = (
    "(SELECT c.id, c.status, m.pos, m.verbatim_term, m.mapped_primary_category, m.mapped_subcategory, "
    "m.mapped_canonical_term FROM catalog c JOIN doc_mappings m ON m.document_id=c.id WHERE c.mapping_count=3)"
)


# --- selections ------------------------------------------------------------


@query(
    "P01_document_by_id",
    "SELECT id, filename, extracted_text, ai_analysis FROM catalog WHERE id = 17",
)
def document_by_id(t: Tables):
    return f.document_by_id(t.catalog("id", "filename", "extracted_text", "ai_analysis"), 17)


@query(
    "P02_list_documents",
    """SELECT id, filename, status, file_size FROM catalog WHERE status='FAILED' ORDER BY file_size DESC, id LIMIT 20 OFFSET 5""",
)
def list_documents(t: Tables):
    return f.list_documents(
        t.catalog("id", "filename", "status", "file_size"), "FAILED", "file_size", True, 5, 20
    )


_SUMMARY_TEXT = (
    "coalesce(nullif(json_extract_string(ai_analysis,'$.summary'),''), "
    "json_extract_string(ai_analysis,'$.document_analysis.summary'))"
)
_TERMS_LIST = (
    "coalesce((SELECT string_agg(mapped_canonical_term,'|' ORDER BY pos) FROM doc_mappings m "
    "WHERE m.document_id=catalog.id AND catalog.mapping_count=3),'')"
)


@query(
    "P03_summary_view",
    f"""SELECT id, filename, file_size, status, CAST(created_at AS VARCHAR) AS created_at, {_SUMMARY_TEXT} AS summary,
    {_TERMS_LIST} AS canonical_terms, CAST(thumbnail_url AS VARCHAR) AS thumbnail_url, {_preview()} AS preview_url,
    concat('/api/documents/', id, '/download') AS download_url, search_vector IS NOT NULL AS has_embeddings, client_canonical,
    trim(state) AS state, CAST(date_created AS VARCHAR) AS date_created, coalesce(needs_date_review, false) AS needs_date_review FROM catalog""",
)
def summary_view(t: Tables):
    return f.document_view(
        t.catalog(
            "id", "filename", "file_path", "file_size", "status", "created_at", "ai_analysis",
            "keywords", "thumbnail_url", "search_vector", "client_canonical", "state",
            "date_created", "needs_date_review",
        )
    )


@query(
    "P03_full_view",
    f"""SELECT id, filename, {_SUMMARY_TEXT} AS summary, CAST(processing_progress AS BIGINT) AS processing_progress,
    CAST(updated_at AS VARCHAR) AS updated_at, CAST(processed_at AS VARCHAR) AS processed_at, processing_error,
    CAST(coalesce(mapping_count,0) AS BIGINT) AS mapping_count, coalesce((SELECT string_agg(verbatim_term,'|' ORDER BY pos) FROM doc_mappings m
    WHERE m.document_id=catalog.id AND catalog.mapping_count=3),'') AS verbatim_terms, extracted_text, ai_analysis FROM catalog""",
)
def full_view(t: Tables):
    return f.document_view(
        t.catalog(
            "id", "filename", "file_path", "file_size", "status", "created_at", "ai_analysis",
            "keywords", "thumbnail_url", "search_vector", "client_canonical", "state",
            "date_created", "needs_date_review", "processing_progress", "updated_at",
            "processed_at", "processing_error", "extracted_text",
        ),
        full_detail=True,
        include_heavy=True,
    ).select(
        "id", "filename", "summary", "processing_progress", "updated_at", "processed_at",
        "processing_error", "mapping_count", "verbatim_terms", "extracted_text", "ai_analysis",
    )


@query(
    "P04_narrow_read",
    """SELECT id, filename, file_size, status, CAST(created_at AS VARCHAR) AS created_at, ai_analysis, CAST(mapping_count AS BIGINT) AS mapping_count,
    CAST(thumbnail_url AS VARCHAR) AS thumbnail_url, file_path, client_canonical, state, CAST(date_created AS VARCHAR) AS date_created FROM catalog""",
)
def narrow_read(t: Tables):
    df = f.narrow(t.catalog(*f.SEARCH_COLUMNS))
    return df.withColumn("mapping_count", F.col("keywords.mapping_count")).drop("keywords")


@query(
    "P05_substring_search",
    f"""SELECT id, filename, CAST(created_at AS VARCHAR) AS created_at FROM catalog
    WHERE {_DONE} AND (filename ILIKE '%tion%' OR search_content ILIKE '%tion%') {_NEWEST} LIMIT 50""",
)
def substring_search(t: Tables):
    return f.substring_search(
        t.catalog("id", "filename", "status", "created_at", "search_content"), "tion"
    ).select("id", "filename", "created_at")


_REVIEW = (
    "id, filename, needs_date_review, needs_review, CAST(date_created AS VARCHAR) AS date_created, date_confidence, "
    "client_canonical, client_confidence, state, state_confidence, CAST(created_at AS VARCHAR) AS created_at"
)


@query(
    "P06_editor_search",
    f"SELECT {_REVIEW} FROM catalog WHERE filename ILIKE '%000000012%' OR client_canonical ILIKE '%000000012%' {_NEWEST} LIMIT 25",
)
def editor_search(t: Tables):
    return f.editor_search(t.catalog(*f.REVIEW_COLUMNS), "000000012")


@query(
    "P07_exact_filters",
    """SELECT id, filename, client_canonical, state, CAST(date_created AS VARCHAR) AS date_created FROM catalog
    WHERE client_canonical='Customer#000000012' AND trim(state)='TX' AND year(date_created)=2021""",
)
def exact_filters(t: Tables):
    return f.exact_filters(
        t.catalog("id", "filename", "client_canonical", "state", "date_created"),
        "Customer#000000012",
        "TX",
        2021,
    )


@query(
    "P08_taxonomy_filter",
    """SELECT id, filename FROM catalog WHERE id IN (SELECT document_id FROM doc_terms JOIN taxonomy t ON t.id=taxonomy_term_id
    WHERE t.primary_category='ECONOMY' AND t.subcategory='Brand#2')""",
)
def taxonomy_filter(t: Tables):
    return f.taxonomy_filter(
        t.catalog("id", "filename"), t.links(), t.taxonomy, "ECONOMY", "Brand#2"
    )


@query(
    "P08_taxonomy_filter_bag",
    """SELECT c.id, c.filename FROM catalog c JOIN doc_terms l ON l.document_id=c.id JOIN taxonomy t ON t.id=l.taxonomy_term_id
    WHERE t.primary_category='ECONOMY'""",
)
def taxonomy_filter_bag(t: Tables):
    return f.taxonomy_filter(t.catalog("id", "filename"), t.links(), t.taxonomy, "ECONOMY", bag=True)


@query(
    "P09_canonical_term_filter",
    f"""SELECT DISTINCT c.id, c.filename FROM catalog c JOIN {_STORED} m ON m.id=c.id
    WHERE m.mapped_canonical_term ILIKE '%#2 small%' OR m.verbatim_term ILIKE '%#2 small%' OR m.verbatim_term ILIKE '%GIZMO%' OR m.mapped_canonical_term ILIKE '%GIZMO%'""",
)
def canonical_term_filter(t: Tables):
    catalog = t.catalog("id", "filename", "keywords")
    both = f.canonical_term_filter(catalog, "#2 small").unionByName(
        f.canonical_term_filter(catalog, "GIZMO")
    )
    return both.select("id", "filename").distinct()


@query(
    "P10_verbatim_term_search",
    f"""SELECT DISTINCT ON (c.created_at, c.id) c.id, c.filename, CAST(c.created_at AS VARCHAR) AS created_at FROM catalog c JOIN {_STORED} m ON m.id=c.id
    WHERE c.{_DONE} AND m.verbatim_term ILIKE '%small%' ORDER BY c.created_at DESC, c.id LIMIT 20""",
)
def verbatim_term_search(t: Tables):
    catalog = t.catalog("id", "filename", "status", "created_at", "keywords")
    return f.verbatim_term_search(catalog, "small").select("id", "filename", "created_at")


@query(
    "P12_failed_documents",
    """SELECT id, filename, processing_error, CAST(updated_at AS VARCHAR) AS updated_at FROM catalog
    WHERE status='FAILED' ORDER BY catalog.updated_at DESC NULLS LAST, id LIMIT 50""",
)
def failed_documents(t: Tables):
    return f.failed_documents(
        t.catalog("id", "filename", "processing_error", "updated_at", "status")
    ).drop("status")


@query(
    "P13_stuck_documents",
    f"SELECT id, filename, CAST(updated_at AS VARCHAR) AS updated_at FROM catalog WHERE status='PROCESSING' AND catalog.updated_at < {_T} - INTERVAL '2' HOUR",
)
def stuck_documents(t: Tables):
    return f.stuck_documents(t.catalog("id", "filename", "updated_at", "status"), AS_OF).drop("status")


ZOMBIE_SQL = (
    f"status='PROCESSING' AND ((processing_heartbeat_at IS NOT NULL AND processing_heartbeat_at < {_T} - INTERVAL '360' SECOND) "
    f"OR (processing_heartbeat_at IS NULL AND (processing_started_at < {_T} - INTERVAL '360' SECOND OR processing_started_at IS NULL)))"
)


@query("P14_zombies", f"SELECT id, filename FROM catalog WHERE {ZOMBIE_SQL}")
def zombies(t: Tables):
    return f.zombie_documents(
        t.catalog("id", "filename", "status", "processing_heartbeat_at", "processing_started_at"),
        AS_OF,
    ).select("id", "filename")


_JSON_SUMMARY = "json_extract_string(ai_analysis,'$.summary')"
_MISSING = {
    "summary": f"(ai_analysis IS NULL OR {_JSON_SUMMARY} IS NULL OR {_JSON_SUMMARY}='' OR {_JSON_SUMMARY} ILIKE '%no summary available%' OR json_extract_string(ai_analysis,'$.error') IS NOT NULL)",
    "extracted_text": "(extracted_text IS NULL OR extracted_text='')",
    "keywords": "(mapping_count IS NULL OR json_extract_string(ai_analysis,'$.error') IS NOT NULL)",
    "embeddings": "search_vector IS NULL",
}
_LISTS = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{k}' AS missing, id, filename, status, CAST(created_at AS VARCHAR) AS created_at, CAST(processed_at AS VARCHAR) AS processed_at, processing_error "
    f"FROM catalog WHERE status IN ('COMPLETED','FAILED') AND {v} {_NEWEST} LIMIT 100)"
    for k, v in _MISSING.items()
)


def _incomplete(t: Tables):
    return f.incomplete_documents(
        t.catalog(
            "id", "filename", "status", "created_at", "processed_at", "processing_error",
            "ai_analysis", "extracted_text", "keywords", "search_vector",
        )
    )


@query("P15_incomplete_documents", _LISTS)
def incomplete_documents(t: Tables):
    return _incomplete(t)


@query(
    "U01_incomplete_total",
    f"SELECT count(DISTINCT id) AS total_unique_incomplete FROM ({_LISTS})",
)
def incomplete_total(t: Tables):
    return f.incomplete_total(_incomplete(t))


@query(
    "P16_review_queue",
    f"SELECT {_REVIEW} FROM catalog WHERE needs_date_review OR needs_review {_NEWEST} LIMIT 500",
)
def review_queue(t: Tables):
    return f.review_queue(t.catalog(*f.REVIEW_COLUMNS))


_BACKFILL = "ai_analysis IS NOT NULL AND (embedding_version IS NULL OR embedding_version < 3)"


@query("P17_embedding_backfill", f"SELECT id FROM catalog WHERE {_BACKFILL}")
def embedding_backfill(t: Tables):
    return f.embedding_backfill(t.catalog("id", "ai_analysis", "embedding_version")).select("id")


@query(
    "K06_nulls_last",
    f"SELECT id, CAST(updated_at AS VARCHAR) AS updated_at FROM catalog WHERE {_BACKFILL} ORDER BY catalog.updated_at DESC NULLS LAST, id LIMIT 600",
)
def nulls_last(t: Tables):
    rows = f.embedding_backfill(t.catalog("id", "ai_analysis", "embedding_version", "updated_at"))
    return f.recently_updated_first(rows.select("id", "updated_at"), 600)


@query(
    "P18_feature_backfill",
    f"SELECT id FROM catalog WHERE {_DONE} AND client_canonical IS NULL AND extracted_text IS NOT NULL",
)
def feature_backfill(t: Tables):
    return f.feature_backfill(t.catalog("id", "status", "client_canonical", "extracted_text")).select("id")


_HAS_JSON_MAPPINGS = "json_array_length(ai_analysis,'$.keyword_mappings') > 0"


@query(
    "P19_mapping_backfill",
    f"SELECT id FROM catalog WHERE coalesce(mapping_count,0)=0 AND {_HAS_JSON_MAPPINGS}",
)
def mapping_backfill(t: Tables):
    return f.mapping_backfill(t.catalog("id", "keywords", "ai_analysis")).select("id")


_BLOCKED = " OR ".join(
    "contains(upper(query), upper('" + x.replace("'", "''") + "'))" for x in fv.QUERY_BLOCK_LIST
)


@query(
    "P20_query_guard",
    f"""WITH q AS (SELECT doc_id AS id, text AS query FROM documents UNION ALL SELECT event_id, concat('  ', event_type, ' or update ') FROM events)
    SELECT id, CASE WHEN {_BLOCKED} THEN 'invalid characters' WHEN length(query) > 500 THEN 'too long' END AS reject_reason,
    CASE WHEN NOT ({_BLOCKED}) AND length(query) <= 500 THEN trim(query) END AS accepted_query FROM q""",
)
def query_guard(t: Tables):
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("query"))
    logged = t.events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("  "), "event_type", F.lit(" or update ")).alias("query"),
    )
    return f.guard_queries(texts.unionByName(logged)).select("id", "reject_reason", "accepted_query")


# --- taxonomy --------------------------------------------------------------

_PATH = "concat_ws(' > ', primary_category, nullif(subcategory,''), term)"


@query(
    "P21_matching_terms",
    f"SELECT id, primary_category, subcategory, term, {_PATH} AS full_path FROM taxonomy WHERE term ILIKE '%1 small%'",
)
def matching_terms(t: Tables):
    return m.matching_terms(t.taxonomy, "1 SMALL")


@query(
    "P22_terms_of_category",
    "SELECT id, primary_category, subcategory, term FROM taxonomy WHERE primary_category='PROMO'",
)
def terms_of_category(t: Tables):
    return m.terms_of_category(t.taxonomy, "PROMO")


@query(
    "P22_term_hierarchy",
    "SELECT term, primary_category, subcategory FROM taxonomy WHERE term='Brand#2 small ring' ORDER BY primary_category, subcategory LIMIT 1",
)
def term_hierarchy(t: Tables):
    return m.term_hierarchy(t.taxonomy, "Brand#2 small ring")


@query(
    "J03_documents_with_terms",
    """SELECT l.document_id, l.taxonomy_term_id, t.primary_category, t.subcategory, t.term FROM doc_terms l JOIN taxonomy t ON t.id=l.taxonomy_term_id""",
)
def documents_with_terms(t: Tables):
    return m.documents_with_terms(t.links(), t.taxonomy)


@query("J04_link_terms", "SELECT document_id, taxonomy_term_id FROM doc_terms")
def link_terms(t: Tables):
    return t.links()


@query(
    "J04_relink",
    """SELECT document_id, taxonomy_term_id FROM doc_terms WHERE document_id NOT IN (SELECT document_id FROM doc_mappings WHERE verbatim_term='old anvil')
    UNION ALL SELECT DISTINCT x.document_id, t.id FROM doc_mappings x JOIN taxonomy t ON t.term=x.mapped_canonical_term WHERE x.verbatim_term='old anvil'""",
)
def relink(t: Tables):
    changed = t.doc_mappings.filter(F.col("verbatim_term") == "old anvil")
    return m.relink(t.links(), changed, t.taxonomy)


@query(
    "J05_validate_mappings",
    """WITH h AS (SELECT term, primary_category, subcategory, row_number() OVER (PARTITION BY term ORDER BY primary_category, subcategory NULLS FIRST) AS rn FROM taxonomy)
    SELECT x.document_id, CAST(x.pos AS BIGINT) AS pos, x.verbatim_term, x.mapped_canonical_term, h.primary_category AS mapped_primary_category, h.subcategory AS mapped_subcategory
    FROM doc_mappings x JOIN h ON h.term=x.mapped_canonical_term AND h.rn=1""",
)
def validate_mappings(t: Tables):
    return m.validate_mappings(t.doc_mappings, t.taxonomy)


@query(
    "J05_gathered_mappings",
    """SELECT x.document_id, string_agg(x.mapped_canonical_term, '|' ORDER BY x.pos) AS canonical_terms
    FROM doc_mappings x WHERE x.mapped_canonical_term IN (SELECT term FROM taxonomy) GROUP BY 1""",
)
def gathered_mappings(t: Tables):
    gathered = m.gather_mappings(m.validate_mappings(t.doc_mappings, t.taxonomy))
    return gathered.select(
        "document_id", an.canonical_terms(F.col("keyword_mappings")).alias("canonical_terms")
    )


@query(
    "J05_rejected_mappings",
    """SELECT document_id, CAST(pos AS BIGINT) AS pos, verbatim_term, mapped_canonical_term FROM doc_mappings
    WHERE mapped_canonical_term NOT IN (SELECT term FROM taxonomy)""",
)
def rejected_mappings(t: Tables):
    return m.rejected_mappings(t.doc_mappings, t.taxonomy)


_USED = f"(SELECT DISTINCT mapped_canonical_term AS term FROM {_STORED} WHERE {_DONE})"


@query(
    "J09_orphan_terms",
    f"SELECT 'Other' AS primary_category, term FROM {_USED} WHERE term NOT IN (SELECT term FROM taxonomy)",
)
def orphan_terms(t: Tables):
    return m.orphan_terms(m.terms_in_use(t.catalog("status", "keywords")), t.taxonomy)


@query(
    "J12_unnest_mappings",
    f"""SELECT id AS document_id, status, CAST(pos AS BIGINT) AS pos, verbatim_term, mapped_primary_category, mapped_subcategory, mapped_canonical_term FROM {_STORED}""",
)
def unnest_mappings(t: Tables):
    return m.unnest_mappings(t.catalog("id", "status", "keywords"), "status")


@query(
    "A21_category_facet",
    "SELECT t.primary_category AS name, count(*) AS count FROM doc_terms l JOIN taxonomy t ON t.id=l.taxonomy_term_id GROUP BY 1",
)
def category_facet(t: Tables):
    return m.category_facet(t.links(), t.taxonomy)


@query(
    "A21_category_facet_distinct",
    "SELECT t.primary_category AS name, count(DISTINCT l.document_id) AS count FROM doc_terms l JOIN taxonomy t ON t.id=l.taxonomy_term_id GROUP BY 1",
)
def category_facet_distinct(t: Tables):
    return m.category_facet(t.links(), t.taxonomy, distinct=True)


@query(
    "A21_subcategory_facet",
    "SELECT t.subcategory AS name, count(*) AS count FROM doc_terms l JOIN taxonomy t ON t.id=l.taxonomy_term_id WHERE t.subcategory IS NOT NULL GROUP BY 1",
)
def subcategory_facet(t: Tables):
    return m.subcategory_facet(t.links(), t.taxonomy)


@query(
    "A21_canonical_terms",
    f"SELECT mapped_canonical_term AS name, count(*) AS count FROM {_STORED} WHERE {_DONE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def canonical_terms(t: Tables):
    return m.canonical_term_facet(t.catalog("status", "keywords"))


_DOCS = f"(SELECT count(*) FROM catalog WHERE {_DONE} AND mapping_count IS NOT NULL)"


@query(
    "A22_mapping_statistics",
    f"""SELECT count(*) AS total_keyword_mappings, count(DISTINCT verbatim_term) AS unique_verbatim_terms,
    count(DISTINCT mapped_canonical_term) AS unique_canonical_terms, {_DOCS} AS total_documents_with_mappings,
    CAST(count(*) AS DOUBLE) / {_DOCS} AS average_mappings_per_document FROM {_STORED}""",
)
def mapping_statistics(t: Tables):
    return m.mapping_statistics(t.catalog("status", "keywords"))


@query(
    "A22_top_canonical_terms",
    f"SELECT mapped_canonical_term AS term, count(*) AS count FROM {_STORED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_canonical_terms(t: Tables):
    return m.top_canonical_terms(t.catalog("keywords"))


@query(
    "A22_category_distribution",
    f"SELECT mapped_primary_category AS category, count(*) AS count FROM {_STORED} GROUP BY 1",
)
def category_distribution(t: Tables):
    return m.category_distribution(t.catalog("keywords"))


@query(
    "A27_primary_categories",
    "SELECT primary_category AS name, count(*) AS count FROM taxonomy GROUP BY 1",
)
def primary_categories(t: Tables):
    return m.primary_categories(t.taxonomy)


@query(
    "A27_subcategories",
    "SELECT primary_category, subcategory AS name, count(*) AS count FROM taxonomy WHERE subcategory <> '' GROUP BY 1, 2",
)
def subcategories(t: Tables):
    return m.subcategories(t.taxonomy)


@query(
    "A28_taxonomy_statistics",
    """SELECT count(*) AS total_terms, count(DISTINCT primary_category) AS total_categories,
    (SELECT count(*) FROM synonyms) AS total_synonyms FROM taxonomy""",
)
def taxonomy_statistics(t: Tables):
    return m.taxonomy_statistics(t.taxonomy, t.synonyms)


@query(
    "A29_taxonomy_hierarchy",
    """SELECT primary_category, coalesce(subcategory,'General') AS subcategory, string_agg(term,'|' ORDER BY term) AS terms FROM taxonomy GROUP BY 1, 2""",
)
def taxonomy_hierarchy(t: Tables):
    return m.taxonomy_hierarchy(t.taxonomy)


@query(
    "A30_canonical_terms_by_category",
    f"""SELECT primary_category, term FROM taxonomy WHERE term IN (SELECT term FROM {_USED})
    UNION ALL SELECT 'Other', term FROM {_USED} WHERE term NOT IN (SELECT term FROM taxonomy)""",
)
def canonical_terms_by_category(t: Tables):
    return m.canonical_terms_by_category(
        m.terms_in_use(t.catalog("status", "keywords")), t.taxonomy
    )


# --- analysis JSON and keyword accessors -----------------------------------


@query(
    "F25_summary",
    f"SELECT id, {_SUMMARY_TEXT} AS summary, CASE WHEN ai_analysis IS NOT NULL THEN 1::BIGINT END AS schema_version FROM catalog",
)
def summary(t: Tables):
    analysis = an.upgrade_analysis(an.parse_analysis(F.col("ai_analysis")))
    return t.catalog("id", "ai_analysis").select(
        "id",
        an.summary_of(analysis).alias("summary"),
        analysis["schema_version"].alias("schema_version"),
    )


@query(
    "F26_mappings_of_analysis",
    """SELECT id, coalesce(json_extract_string(ai_analysis,'$.keyword_mappings[0].verbatim_term'), '') || coalesce(json_extract_string(ai_analysis,'$.taxonomy_keywords.keyword_mappings[0].verbatim_term'),'') AS verbatim_terms FROM catalog""",
)
def mappings_of_analysis(t: Tables):
    found = an.mappings_of(an.parse_analysis(F.col("ai_analysis")))
    return t.catalog("id", "ai_analysis").select(
        "id", F.coalesce(F.array_join(an.verbatim_terms(found), "|"), F.lit("")).alias("verbatim_terms")
    )


@query(
    "F27_keyword_accessors",
    """SELECT id, CASE WHEN mapping_count IS NOT NULL THEN 'Issue' END AS categories, CASE WHEN mapping_count IS NOT NULL THEN 'mail|print' END AS keywords,
    CASE WHEN mapping_count IS NOT NULL THEN coalesce((SELECT string_agg(verbatim_term,'|' ORDER BY pos) FROM doc_mappings m WHERE m.document_id=catalog.id AND mapping_count=3),'') END AS verbatim_terms
    FROM catalog""",
)
def keyword_accessors(t: Tables):
    return t.catalog("id", "keywords").select(
        "id",
        F.col("keywords.categories").alias("categories"),
        F.col("keywords.keywords").alias("keywords"),
        an.verbatim_terms(F.col("keywords.keyword_mappings")).alias("verbatim_terms"),
    )


@query(
    "F33_json_scalars",
    """SELECT id, json_extract_string(ai_analysis,'$.summary') AS summary, CAST(json_extract_string(ai_analysis,'$.schema_version') AS BIGINT) AS schema_version,
    json_extract_string(ai_analysis,'$.classification.category') AS category,
    coalesce(regexp_matches(json_extract_string(ai_analysis,'$.keyword_mappings[0].mapped_canonical_term'), '(?i)^taxes$'), false) AS has_taxes FROM catalog""",
)
def json_scalars(t: Tables):
    v = F.try_parse_json("ai_analysis")
    terms = an.mappings_of(an.parse_analysis(F.col("ai_analysis")))
    return t.catalog("id", "ai_analysis").select(
        "id",
        F.try_variant_get(v, "$.summary", "string").alias("summary"),
        F.try_variant_get(v, "$.schema_version", "long").alias("schema_version"),
        F.try_variant_get(v, "$.classification.category", "string").alias("category"),
        F.exists(
            F.coalesce(terms, an.no_mappings()),
            lambda x: F.coalesce(x["mapped_canonical_term"].rlike("(?i)^taxes$"), F.lit(False)),
        ).alias("has_taxes"),
    )


@query(
    "U02_search_content",
    """WITH a AS (SELECT *, CASE WHEN json_extract_string(ai_analysis,'$.error') IS NULL THEN json_extract_string(ai_analysis,'$.summary') END AS s FROM catalog),
    p AS (SELECT id, filename AS part FROM a UNION SELECT id, extracted_text FROM a UNION SELECT id, s FROM a
    UNION SELECT id, unnest(['mail','print','Issue']) FROM a WHERE mapping_count IS NOT NULL
    UNION SELECT a.id, m.verbatim_term FROM a JOIN doc_mappings m ON m.document_id=a.id AND a.mapping_count=3)
    SELECT id, string_agg(part,' ' ORDER BY encode(part)) AS search_content FROM p WHERE part <> '' GROUP BY id""",
)
def search_content(t: Tables):
    return t.catalog("id", "filename", "extracted_text", "ai_analysis", "keywords").select(
        "id",
        an.search_content(
            F.col("filename"),
            F.col("extracted_text"),
            an.parse_analysis(F.col("ai_analysis")),
            F.col("keywords"),
        ).alias("search_content"),
    )


@query(
    "U04_keyword_sets",
    """WITH j AS (SELECT id, ai_analysis AS a FROM catalog WHERE ai_analysis IS NOT NULL),
    k AS (SELECT id, unnest([json_extract_string(a,'$.keyword_mappings[0].verbatim_term'), json_extract_string(a,'$.keyword_mappings[0].mapped_canonical_term'),
      json_extract_string(a,'$.taxonomy_keywords.keyword_mappings[0].verbatim_term'), json_extract_string(a,'$.taxonomy_keywords.keyword_mappings[0].mapped_canonical_term'),
      json_extract_string(a,'$.document_analysis.summary'), json_extract_string(a,'$.document_analysis.document_type'), json_extract_string(a,'$.document_analysis.document_tone'),
      json_extract_string(a,'$.entities.client_name'), json_extract_string(a,'$.communication_focus.primary_issue')]) AS w FROM j),
    c AS (SELECT id, unnest([json_extract_string(a,'$.keyword_mappings[0].mapped_primary_category'), json_extract_string(a,'$.classification.category'),
      json_extract_string(a,'$.categories[0]'), json_extract_string(a,'$.categories[1]')]) AS w FROM j)
    SELECT j.id, (SELECT coalesce(string_agg(w,'|' ORDER BY w),'') FROM (SELECT DISTINCT lower(trim(w)) AS w FROM k WHERE k.id=j.id AND w <> '')) AS keywords,
    (SELECT coalesce(string_agg(w,'|' ORDER BY w),'') FROM (SELECT DISTINCT lower(trim(w)) AS w FROM c WHERE c.id=j.id AND w <> '')) AS categories FROM j""",
)
def keyword_sets(t: Tables):
    analysis = an.parse_analysis(F.col("ai_analysis"))
    return (
        t.catalog("id", "ai_analysis")
        .filter(F.col("ai_analysis").isNotNull())
        .select(
            "id",
            an.keyword_set(analysis).alias("keywords"),
            an.category_set(analysis).alias("categories"),
        )
    )


_J = "json_extract_string(ai_analysis,'$."


@query(
    "F24_embedding_text",
    f"""WITH a AS (SELECT *, coalesce(nullif({_J}document_analysis.summary'),''), {_J}summary')) AS s,
    CASE WHEN upper(client_confidence) IN ('HIGH','MEDIUM') AND client_canonical <> '' THEN client_canonical ELSE {_J}entities.client_name') END AS cl,
    CASE WHEN upper(state_confidence) IN ('HIGH','MEDIUM') AND state <> '' THEN state END AS st,
    CASE WHEN {_J}communication_focus.primary_issue') IS NOT NULL THEN 'Schools, Taxes' END AS iss FROM catalog)
    SELECT id, coalesce(nullif(concat_ws(chr(10), CASE WHEN s <> '' THEN concat('SUMMARY: ', s) END, 'ISSUES: '||iss, CASE WHEN {_J}classification.category') <> '' THEN concat('CATEGORY: ', {_J}classification.category')) END,
    CASE WHEN {_J}document_analysis.document_type') <> '' THEN concat('DOCUMENT_TYPE: ', {_J}document_analysis.document_type')) END, CASE WHEN cl <> '' THEN concat('CLIENT: ', cl) END,
    CASE WHEN st <> '' THEN concat('STATE: ', st) END), ''), filename) AS embedding_text,
    CASE WHEN cl <> '' THEN CASE WHEN upper(client_confidence) IN ('HIGH','MEDIUM') AND client_canonical <> '' THEN 'canonical_pipeline' ELSE 'llm_extraction' END END AS client_source
    FROM a WHERE ai_analysis IS NOT NULL""",
)
def embedding_text(t: Tables):
    catalog = t.catalog(
        "id", "filename", "ai_analysis", "client_canonical", "client_confidence", "state",
        "state_confidence",
    ).filter(F.col("ai_analysis").isNotNull())
    parts = an.embedding_parts(
        an.parse_analysis(F.col("ai_analysis")),
        F.col("client_canonical"),
        F.col("client_confidence"),
        F.col("state"),
        F.col("state_confidence"),
    )
    return catalog.withColumn("parts", parts).select(
        "id",
        an.embedding_text(F.col("parts"), F.col("filename")).alias("embedding_text"),
        F.try_element_at(an.embedding_provenance(F.col("parts")), F.lit("CLIENT"))["source"].alias(
            "client_source"
        ),
    )


@query(
    "F34_normalised_analysis",
    f"""SELECT id, {_J}document_analysis.document_type') IS NULL AS built, coalesce({_J}document_analysis.summary'), {_J}summary'), '') AS summary,
    coalesce({_J}document_analysis.document_type'), '') AS document_type FROM catalog WHERE ai_analysis IS NOT NULL AND {_J}error') IS NULL""",
)
def normalised_analysis(t: Tables):
    parsed = t.catalog("id", "ai_analysis").withColumn("a", an.parse_analysis(F.col("ai_analysis")))
    usable = parsed.filter(an.analysis_reject_reason(F.col("a")).isNull())
    fixed = usable.withColumn("n", an.normalise_analysis(F.col("a")))
    return fixed.select(
        "id",
        F.col("a.document_analysis").isNull().alias("built"),
        F.col("n.document_analysis.summary").alias("summary"),
        F.col("n.document_analysis.document_type").alias("document_type"),
    )


@query(
    "F34_rejected_analysis",
    f"""SELECT id, CASE WHEN ai_analysis IS NULL THEN 'no analysis' ELSE concat('model error: ', {_J}error')) END AS reason FROM catalog
    WHERE ai_analysis IS NULL OR {_J}error') IS NOT NULL""",
)
def rejected_analysis(t: Tables):
    reason = an.analysis_reject_reason(an.parse_analysis(F.col("ai_analysis")))
    return t.catalog("id", "ai_analysis").select("id", reason.alias("reason")).filter("reason IS NOT NULL")


@query(
    "S14_recovered_json",
    """SELECT page_id AS id, concat('{"n": ', page_id, '}') AS json, CAST(NULL AS VARCHAR) AS raw_response FROM pages WHERE page_id%4 < 2
    UNION ALL SELECT page_id, NULL, CASE page_id%4 WHEN 2 THEN url ELSE concat('{', url) END FROM pages WHERE page_id%4 >= 2""",
)
def recovered_json(t: Tables):
    n = F.col("page_id")
    body = F.concat(F.lit('{"n": '), n.cast("string"), F.lit("}"))
    response = (
        F.when(n % 4 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone {x}")))
        .when(n % 4 == 1, F.concat(F.lit("Answer: "), body, F.lit(" ok")))
        .when(n % 4 == 2, F.col("url"))
        .otherwise(F.concat(F.lit("{"), "url"))
    )
    return t.pages.select(n.alias("id"), an.recovered_response(response).alias("r")).select(
        "id", "r.json", "r.raw_response"
    )


# --- names, paths, labels --------------------------------------------------


@query(
    "S10_safe_file_name",
    """WITH n AS (SELECT page_id AS id, concat(url, CASE page_id%3 WHEN 0 THEN ':a*b?.pdf' WHEN 1 THEN '/..' ELSE '/x"<y>|z..txt' END) AS name FROM pages)
    SELECT id, replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(name,'^.*/',''),'..','_'),'\\','_'),':','_'),'*','_'),'?','_'),'"','_'),'<','_'),'>','_'),'|','_') AS safe_name FROM n""",
)
def safe_file_name(t: Tables):
    n = F.col("page_id")
    ending = (
        F.when(n % 3 == 0, ":a*b?.pdf").when(n % 3 == 1, "/..").otherwise('/x"<y>|z..txt')
    )
    return t.pages.select(
        n.alias("id"), tx.safe_file_name(F.concat("url", ending)).alias("safe_name")
    )


@query(
    "S11_file_type",
    """SELECT id, CASE WHEN filename LIKE '%.pdf' THEN 'pdf' WHEN filename LIKE '%.txt' THEN 'text' WHEN filename LIKE '%.docx' THEN 'document' ELSE 'image' END AS file_type FROM catalog""",
)
def file_type(t: Tables):
    return t.catalog("id", "filename").select("id", tx.file_type(F.upper("filename")).alias("file_type"))


@query(
    "F29_paths",
    f"SELECT id, {_preview()} AS preview_url, concat('/api/documents/', id, '/download') AS download_url FROM catalog",
)
def paths(t: Tables):
    return t.catalog("id", "file_path").select(
        "id",
        tx.preview_path(F.col("file_path")).alias("preview_url"),
        tx.download_path(F.col("id"), F.col("file_path")).alias("download_url"),
    )


_STOPS = ", ".join(f"'{w}'" for w in fv.QUERY_STOP_WORDS)


@query(
    "F30_query_keywords",
    f"""SELECT doc_id AS id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '' AND w NOT IN ({_STOPS})), '|') AS keywords FROM documents""",
)
def query_keywords(t: Tables):
    return t.documents.select(
        F.col("doc_id").alias("id"), tx.query_keywords(F.col("text")).alias("keywords")
    )


@query(
    "F31_query_label",
    """SELECT event_id AS id, CASE event_type WHEN 'view' THEN '(filter only)' WHEN 'click' THEN 'click' ELSE event_type END AS label FROM events""",
)
def query_label(t: Tables):
    typed = (
        F.when(F.col("event_type") == "view", "  \t ")
        .when(F.col("event_type") == "click", "  click ")
        .otherwise(F.col("event_type"))
    )
    return t.events.select(F.col("event_id").alias("id"), tx.query_label(typed).alias("label"))


@query(
    "F28_progress",
    """SELECT id, CAST(CASE WHEN status='COMPLETED' THEN 100 ELSE least(greatest(processing_progress - 10, 0), 100) END AS BIGINT) AS progress FROM catalog""",
)
def progress(t: Tables):
    from foliary.operators.upkeep import progress_after

    return t.catalog("id", "status", "processing_progress").select(
        "id", progress_after(F.col("status"), F.col("processing_progress") - 10).alias("progress")
    )
