"""Registered queries: state changes, roll-ups, ingest, file edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from foliary.functions import analysis as an
from foliary.operators import pages as pg
from foliary.operators import upkeep as u
from foliary.plans.catalog_queries import ZOMBIE_SQL
from foliary.plans.derived import AS_OF, Tables
from foliary.plans.registry import query
from foliary.sources import files as fl
from foliary.sources import tables as tb

_T = f"TIMESTAMP '{AS_OF}'"

# --- pages -----------------------------------------------------------------

_HEADED = "concat('--- Page ', page_num, ' ---', chr(10), text)"


def _rollup_sql(text_filter: str) -> str:
    return f"""WITH f AS (SELECT * FROM doc_pages WHERE page_num > checkpoint), d AS (SELECT document_id, max(page_num) AS page_count FROM doc_pages GROUP BY 1)
    SELECT x.document_id, x.extracted_text, x.summary, d.page_count, coalesce(y.input_tokens,0) AS input_tokens, coalesce(y.output_tokens,0) AS output_tokens, y.provider, y.keywords FROM
    (SELECT document_id, string_agg({_HEADED}, chr(10)||chr(10) ORDER BY page_num) AS extracted_text, coalesce(string_agg(nullif(summary,''), chr(10) ORDER BY page_num),'') AS summary
      FROM doc_pages WHERE {text_filter} GROUP BY 1) x JOIN d ON d.document_id=x.document_id
    LEFT JOIN (SELECT document_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, arg_min(provider, page_num) FILTER (WHERE provider IS NOT NULL) AS provider,
      string_agg(DISTINCT keyword, '|' ORDER BY keyword) AS keywords FROM f GROUP BY 1) y ON y.document_id=x.document_id"""


@query("A31_page_roll_up", _rollup_sql("true"))
def page_roll_up(t: Tables):
    return pg.roll_up(t.doc_pages)


@query("A31_resumed_only", _rollup_sql("page_num > checkpoint"))
def resumed_only(t: Tables):
    return pg.roll_up(t.doc_pages, resume_only=True, pages_per_part=2)


@query(
    "A31_text_parts",
    f"""SELECT document_id, CAST(floor((page_num-1)/2.0) AS BIGINT) AS part, string_agg({_HEADED}, chr(10)||chr(10) ORDER BY page_num) AS text,
    coalesce(string_agg(nullif(summary,''), chr(10) ORDER BY page_num),'') AS summary FROM doc_pages GROUP BY 1, 2""",
)
def text_parts(t: Tables):
    return pg.text_parts(t.doc_pages, pages_per_part=2)


# --- status ----------------------------------------------------------------

_STATUS_OF = "CASE kind WHEN 'start' THEN 'PROCESSING' WHEN 'heartbeat' THEN 'PROCESSING' WHEN 'complete' THEN 'COMPLETED' ELSE 'FAILED' END"


def _status_events(t: Tables):
    kind = F.col("kind")
    status = (
        F.when(kind.isin("start", "heartbeat"), "PROCESSING")
        .when(kind == "complete", "COMPLETED")
        .otherwise("FAILED")
    )
    return t.status_events.select(
        F.col("document_id").alias("id"),
        status.alias("status"),
        F.floor("value").cast("int").alias("progress"),
        F.when(kind == "fail", F.concat(F.lit("e"), F.col("id").cast("string"))).alias("error"),
        "ts",
    )


@query(
    "M01_status_transitions",
    f"""WITH e AS (SELECT document_id, ts, kind, id AS eid, value, {_STATUS_OF} AS st FROM status_events),
    l AS (SELECT document_id, arg_max(st, ts) AS st,
      arg_max(CASE WHEN st='COMPLETED' THEN 100 ELSE least(greatest(floor(value),0),100) END, ts) FILTER (WHERE st='COMPLETED' OR value IS NOT NULL) AS progress,
      arg_max(concat('e', eid), ts) FILTER (WHERE kind='fail') AS error, max(ts) FILTER (WHERE st='PROCESSING') AS started, max(ts) FILTER (WHERE st='COMPLETED') AS processed
      FROM e GROUP BY document_id)
    SELECT c.id, coalesce(l.st, c.status) AS status, CAST(coalesce(l.progress, c.processing_progress) AS BIGINT) AS processing_progress,
    coalesce(l.error, c.processing_error) AS processing_error,
    CAST(coalesce(l.started, c.processing_started_at) AS VARCHAR) AS processing_started_at,
    CAST(coalesce(l.processed, c.processed_at) AS VARCHAR) AS processed_at
    FROM catalog c LEFT JOIN l ON l.document_id=c.id""",
)
def status_transitions(t: Tables):
    catalog = t.catalog(
        "id", "status", "processing_progress", "processing_error", "processing_started_at",
        "processed_at",
    )
    return u.apply_status(catalog, _status_events(t))


@query(
    "M08_zombie_rescue",
    f"""SELECT id, CASE WHEN z THEN 'QUEUED' ELSE status END AS status, CASE WHEN NOT z THEN CAST(processing_heartbeat_at AS VARCHAR) END AS processing_heartbeat_at,
    CASE WHEN z THEN 'Reset from zombie PROCESSING state at 2024-01-31T00:00:00' ELSE processing_error END AS processing_error,
    CAST(processing_started_at AS VARCHAR) AS processing_started_at FROM (SELECT *, coalesce({ZOMBIE_SQL}, false) AS z FROM catalog)""",
)
def zombie_rescue(t: Tables):
    catalog = t.catalog(
        "id", "status", "processing_heartbeat_at", "processing_error", "processing_started_at"
    )
    return u.rescue_zombies(catalog, AS_OF)


_BUSY = "(SELECT count(*) FROM catalog WHERE status='PROCESSING')"


@query(
    "K04_next_in_queue",
    f"""SELECT id, CAST(created_at AS VARCHAR) AS created_at, place FROM (SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) AS place FROM catalog WHERE status='QUEUED')
    WHERE place <= 1000000 - {_BUSY} AND place <= 1000000""",
)
def next_in_queue(t: Tables):
    # many slots: the whole backlog fits
    return u.next_in_queue(t.catalog("id", "status", "created_at"), slots=1_000_000)


@query(
    "J11_staged_update",
    """SELECT c.id, c.filename, CASE WHEN p.id IS NOT NULL THEN p.raw ELSE c.client END AS client FROM catalog c
    LEFT JOIN (SELECT * FROM payers WHERE true_clean IS NULL OR length(true_clean) > 15) p ON p.id=c.id""",
)
def staged_update(t: Tables):
    staged = t.payers.filter("true_clean IS NULL OR length(true_clean) > 15").select(
        "id", F.col("raw").alias("client")
    )
    return u.update(t.catalog("id", "filename", "client"), staged, ["client"])


@query(
    "J11_updated_count",
    "SELECT count(*) AS updated FROM catalog WHERE id IN (SELECT vec_id + 100 FROM embeddings)",
)
def updated_count(t: Tables):
    staged = t.embeddings.select((F.col("vec_id") + 100).alias("id"))
    return u.updated_count(t.catalog("id"), staged)


# --- content ---------------------------------------------------------------


@query(
    "M02_content_update",
    """WITH n AS (SELECT id, raw, v=0 AS has_text, v<3 AS has_kw FROM (SELECT id, raw, id%9 AS v FROM payers)),
    p AS (SELECT c.id, c.filename AS part FROM catalog c JOIN n ON n.id=c.id WHERE n.has_kw UNION SELECT c.id, CASE WHEN n.has_text THEN n.raw ELSE c.extracted_text END FROM catalog c JOIN n ON n.id=c.id WHERE n.has_kw
      UNION SELECT c.id, CASE WHEN json_extract_string(c.ai_analysis,'$.error') IS NULL THEN json_extract_string(c.ai_analysis,'$.summary') END FROM catalog c JOIN n ON n.id=c.id WHERE n.has_kw
      UNION SELECT n.id, unnest(['fresh','words']) FROM n WHERE has_kw),
    s AS (SELECT id, string_agg(part, ' ' ORDER BY encode(part)) AS sc FROM p WHERE part <> '' GROUP BY id)
    SELECT c.id, CASE WHEN n.has_text THEN n.raw ELSE c.extracted_text END AS extracted_text, coalesce(s.sc, c.search_content) AS search_content,
    CASE WHEN n.has_kw THEN 'fresh|words' WHEN c.mapping_count IS NOT NULL THEN 'mail|print' END AS keywords
    FROM catalog c LEFT JOIN n ON n.id=c.id LEFT JOIN s ON s.id=c.id""",
)
def content_update(t: Tables):
    v = F.col("id") % 9
    content = t.payers.select(
        "id",
        F.when(v == 0, F.col("raw")).alias("extracted_text"),
        F.lit("").alias("ai_analysis"),
        F.when(v < 3, F.array(F.lit("fresh"), F.lit("words"))).alias("new_keywords"),
        F.array().cast("array<string>").alias("new_categories"),
        F.lit(None).cast(an.MAPPINGS_TYPE).alias("new_mappings"),
    )
    catalog = u.with_stamped_keywords(
        t.catalog("id", "filename", "extracted_text", "ai_analysis", "search_content", "keywords")
    )
    return u.update_content(catalog, content, AS_OF).select(
        "id", "extracted_text", "search_content", F.col("keywords.keywords").alias("keywords")
    )


@query(
    "M02_metadata_merge",
    """SELECT c.id, CASE WHEN p.id%3=0 THEN concat('checked=', c.id, '|', CASE WHEN c.id%4<>0 THEN concat('origin=', c.status, '|') ELSE '' END, 'page_count=7')
      WHEN c.id%4<>0 THEN concat('origin=', c.status, '|page_count=', c.id%5) END AS metadata,
    CASE WHEN p.id%3=0 THEN 'new text' ELSE c.extracted_text END AS extracted_text
    FROM catalog c LEFT JOIN payers p ON p.id=c.id""",
)
def metadata_merge(t: Tables):
    """Entries of the update replace those of the same name; others stay."""
    text = F.col("id").cast("string")
    stored = F.create_map(F.lit("origin"), "status", F.lit("page_count"), (F.col("id") % 5).cast("string"))
    catalog = u.with_stamped_keywords(
        t.catalog("id", "status", "filename", "extracted_text", "ai_analysis", "search_content", "keywords")
    ).withColumn("file_metadata", F.when(F.col("id") % 4 != 0, stored))
    fresh = F.create_map(F.lit("page_count"), F.lit("7"), F.lit("checked"), text)
    content = t.payers.select(
        "id",
        F.when(F.col("id") % 3 == 0, "new text").alias("extracted_text"),
        F.lit("").alias("ai_analysis"),
        F.array().cast("array<string>").alias("new_keywords"),
        F.array().cast("array<string>").alias("new_categories"),
        F.lit(None).cast(an.MAPPINGS_TYPE).alias("new_mappings"),
        F.when(F.col("id") % 3 == 0, fresh).alias("new_metadata"),
    )
    entries = F.array_sort(F.map_entries("file_metadata"))
    listed = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return u.update_content(catalog, content, AS_OF).select("id", listed.alias("metadata"), "extracted_text")


@query(
    "M03_reset",
    f"""SELECT c.id, CASE WHEN h THEN 'QUEUED' ELSE status END AS status, CASE WHEN NOT h THEN extracted_text END AS extracted_text, CASE WHEN NOT h THEN ai_analysis END AS ai_analysis,
    CASE WHEN NOT h THEN processing_error END AS processing_error, CASE WHEN NOT h THEN CAST(processed_at AS VARCHAR) END AS processed_at,
    CAST(CASE WHEN h THEN 0 ELSE processing_progress END AS BIGINT) AS processing_progress, CAST(CASE WHEN h THEN {_T} ELSE updated_at END AS VARCHAR) AS updated_at
    FROM (SELECT *, id IN (SELECT doc_id FROM labels WHERE quality=0) AS h FROM catalog) c""",
)
def reset(t: Tables):
    ids = t.labels.filter("quality = 0").select(F.col("doc_id").alias("id"))
    catalog = t.catalog(
        "id", "status", "extracted_text", "ai_analysis", "processing_error", "processed_at",
        "processing_progress", "updated_at",
    )
    return u.reset_documents(catalog, ids, AS_OF)


@query(
    "M03_links_after_reset",
    "SELECT document_id, taxonomy_term_id FROM doc_terms WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE quality=0)",
)
def links_after_reset(t: Tables):
    ids = t.labels.filter("quality = 0").select(F.col("doc_id").alias("id"))
    return u.drop_links(t.links(), ids)


@query(
    "M04_embedding_update",
    """SELECT c.id, CASE WHEN e.vec_id IS NOT NULL THEN 3 ELSE CAST(c.embedding_version AS BIGINT) END AS embedding_version,
    CASE WHEN e.vec_id IS NOT NULL THEN round(CAST(e.embedding[1] AS DOUBLE), 6) ELSE round(CAST(c.search_vector[1] AS DOUBLE), 6) END AS first_value
    FROM catalog c LEFT JOIN embeddings e ON e.vec_id + 50 = c.id""",
)
def embedding_update(t: Tables):
    vectors = t.embeddings.select(
        (F.col("vec_id") + 50).alias("id"),
        F.col("embedding").alias("search_vector"),
        F.lit(3).alias("embedding_version"),
    )
    catalog = t.catalog("id", "embedding_version", "search_vector")
    new = u.update_embeddings(catalog, vectors)
    return new.select(
        "id",
        "embedding_version",
        F.round(F.get("search_vector", F.lit(0)).cast("double"), 6).alias("first_value"),
    )


@query(
    "M05_delete",
    "SELECT id, filename FROM catalog WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic=1)",
)
def delete(t: Tables):
    ids = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return u.delete_documents(t.catalog("id", "filename"), ids)


@query(
    "M05_deletion_report",
    """SELECT e.user_id * 9 AS document_id, c.id IS NOT NULL AS success, CASE WHEN c.id IS NULL THEN 'Document not found' END AS error
    FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN catalog c ON c.id = e.user_id * 9""",
)
def deletion_report(t: Tables):
    ids = t.events.select((F.col("user_id") * 9).alias("id"))
    return u.deletion_report(t.catalog("id"), ids)


# --- features and review ---------------------------------------------------


@query(
    "M06_document_features",
    """SELECT id, CASE WHEN true_frank THEN 'official funds authorized by the House of Representatives' ELSE concat('Friends of ', true_client) END AS paid_for_by_raw, true_frank AS is_frank,
    true_client AS client, CASE WHEN NOT true_frank THEN concat('Friends Of ', true_client) END AS client_clean_v1,
    CASE WHEN true_frank THEN true_client ELSE concat('Friends Of ', true_client) END AS client_canonical,
    CASE WHEN true_frank THEN 'ai_tier2_summary' ELSE 'clean_v1_over_ai_medium' END AS canonical_source, CASE WHEN NOT true_frank THEN 'passthrough' END AS rules_source,
    true_state AS state, CASE WHEN year(true_date) BETWEEN 2019 AND 2026 THEN CAST(true_date AS VARCHAR) END AS date_created, needs_review
    FROM (SELECT *, true_needs_review AS needs_review FROM mailers)""",
)
def document_features(t: Tables):
    from foliary.operators import entities as e

    # franked mail gets a sure name from the summary, other mail a vague one
    summary = F.concat(
        F.when(F.col("true_frank"), "A mailer promoting ").otherwise("Notes on candidate "),
        "true_client",
        F.lit("."),
    )
    mail = t.mailers.select(
        "id",
        "extracted_text",
        F.to_json(F.struct(summary.alias("summary"))).alias("ai_analysis"),
        F.struct(F.lit(None).cast(an.MAPPINGS_TYPE).alias("keyword_mappings")).alias("keywords"),
    )
    made = u.document_features(mail, e.override_table(t.canonical_overrides))
    return made.select(
        "id", "paid_for_by_raw", "is_frank", "client", "client_clean_v1", "client_canonical",
        "feature_extraction.canonical_source", "feature_extraction.rules_source", "state",
        "date_created", "needs_review",
    )


@query("M06_features_written")
def features_written(t: Tables):
    """Features of the given documents written back; no SQL for the rules."""
    from foliary.operators import entities as e

    catalog = t.catalog(
        "id", "extracted_text", "ai_analysis", "keywords", "client_canonical", "client", "state",
        "date_created",
    )
    new = u.write_features(catalog, e.override_table(t.canonical_overrides))
    return new.groupBy("client_canonical", "state", "needs_review").agg(F.count("*").alias("n"))


_CORR = """SELECT doc_id AS id, CASE doc_id%5 WHEN 0 THEN '2021-03-04' WHEN 1 THEN '2031-01-01' WHEN 2 THEN '4 May' WHEN 3 THEN NULL ELSE '2019-12-31' END AS dc,
    CASE doc_id%2 WHEN 0 THEN ' New Client ' END AS cc, CASE doc_id%3 WHEN 0 THEN 'tx' WHEN 1 THEN 'Texas' END AS st FROM labels"""
_JUDGED = f"""SELECT *, CASE WHEN id%5=2 THEN 'invalid date' WHEN id%5=1 THEN 'date out of range' WHEN id%3=1 THEN 'state must have two letters' END AS error FROM ({_CORR})"""


def _corrections(t: Tables):
    n = F.col("doc_id")
    day = (
        F.when(n % 5 == 0, "2021-03-04")
        .when(n % 5 == 1, "2031-01-01")
        .when(n % 5 == 2, "4 May")
        .when(n % 5 == 4, "2019-12-31")
    )
    return t.labels.select(
        n.alias("id"),
        day.alias("date_created"),
        F.when(n % 2 == 0, " New Client ").alias("client_canonical"),
        F.when(n % 3 == 0, "tx").when(n % 3 == 1, "Texas").alias("state"),
    )


@query("M07_judged_corrections", f"SELECT id, error FROM ({_JUDGED})")
def judged_corrections(t: Tables):
    return u.judge_corrections(_corrections(t)).select("id", "error")


@query(
    "M07_resolved_reviews",
    f"""SELECT c.id, CASE WHEN j.id IS NOT NULL THEN j.dc ELSE CAST(c.date_created AS VARCHAR) END AS date_created, CASE WHEN j.cc IS NOT NULL THEN 'New Client' ELSE c.client_canonical END AS client_canonical,
    CASE WHEN j.cc IS NOT NULL THEN 'HIGH' ELSE c.client_confidence END AS client_confidence, CASE WHEN j.st IS NOT NULL THEN 'TX' ELSE c.state END AS state,
    CASE WHEN j.st IS NOT NULL THEN 'HIGH' ELSE c.state_confidence END AS state_confidence, CASE WHEN j.id IS NOT NULL THEN false ELSE c.needs_review END AS needs_review,
    CASE WHEN j.id IS NOT NULL THEN false ELSE c.needs_date_review END AS needs_date_review FROM catalog c LEFT JOIN (SELECT * FROM ({_JUDGED}) WHERE error IS NULL) j ON j.id=c.id""",
)
def resolved_reviews(t: Tables):
    catalog = t.catalog(
        "id", "date_created", "client_canonical", "client_confidence", "state",
        "state_confidence", "needs_review", "needs_date_review",
    )
    return u.resolve_reviews(catalog, u.judge_corrections(_corrections(t)))


@query(
    "M09_override_upsert",
    """WITH i AS (SELECT trim(raw, concat(' ', chr(10))) AS client_clean_v1, concat('X', id) AS client_canonical, id AS ord FROM payers UNION ALL SELECT client_clean_v1, client_canonical, -1 FROM canonical_overrides)
    SELECT client_clean_v1, arg_max(client_canonical, ord) AS client_canonical FROM i WHERE client_clean_v1 <> '' GROUP BY 1""",
)
def override_upsert(t: Tables):
    incoming = t.payers.select(
        F.col("raw").alias("client_clean_v1"),
        F.concat(F.lit(" X"), F.col("id").cast("string")).alias("client_canonical"),
        F.col("id").alias("ord"),
    )
    return u.upsert_overrides(t.canonical_overrides, incoming)


@query(
    "M10_flagged_years",
    "SELECT id, CASE WHEN NOT (year(date_created) BETWEEN 2019 AND 2026) THEN true ELSE needs_date_review END AS needs_date_review FROM (SELECT * REPLACE (CAST(date_created - INTERVAL '2' YEAR AS DATE) AS date_created) FROM catalog)",
)
def flagged_years(t: Tables):
    older = t.catalog("id", "date_created", "needs_date_review").withColumn(
        "date_created", F.add_months("date_created", -24)
    )
    return u.flag_bad_years(older).select("id", "needs_date_review")


@query(
    "M12_mapping_backfill",
    """SELECT id, CASE WHEN json_array_length(ai_analysis,'$.keyword_mappings') > 0 AND coalesce(mapping_count,0)=0 THEN 'Taxes' WHEN mapping_count IS NULL THEN NULL
    ELSE coalesce((SELECT string_agg(verbatim_term,'|' ORDER BY pos) FROM doc_mappings m WHERE m.document_id=catalog.id AND mapping_count=3), '') END AS verbatim_terms FROM catalog""",
)
def mapping_backfill(t: Tables):
    catalog = u.with_stamped_keywords(
        t.catalog("id", "filename", "extracted_text", "ai_analysis", "search_content", "keywords")
    )
    return u.backfill_mappings(catalog, AS_OF).select(
        "id", an.verbatim_terms(F.col("keywords.keyword_mappings")).alias("verbatim_terms")
    )


# --- registration, archives, ingest ----------------------------------------


@query(
    "S08_registered_uploads",
    """SELECT conv_id AS batch_id, turn AS arrival, concat('f', turn, '_.pdf') AS filename, length(text) AS file_size, 'QUEUED' AS status, turn * 30 AS starts_in_seconds FROM conversations""",
)
def registered_uploads(t: Tables):
    return u.register_uploads(_uploads(t))


def _uploads(t: Tables):
    return t.conversations.select(
        F.col("conv_id").alias("batch_id"),
        F.col("turn").alias("arrival"),
        F.concat(F.lit("dir/f"), F.col("turn").cast("string"), F.lit("?.pdf")).alias("name"),
        F.length("text").cast("long").alias("file_size"),
    )


@query(
    "W04_start_delays",
    "SELECT conv_id AS batch_id, turn AS arrival, turn * 30 AS starts_in_seconds FROM conversations",
)
def start_delays(t: Tables):
    return u.register_uploads(_uploads(t)).select("batch_id", "arrival", "starts_in_seconds")


@query(
    "S15_archive_manifest",
    """WITH r AS (SELECT unnest(range(0, 100)) AS pos), f AS (SELECT r.pos, c.id, concat('mail_', c.id%3, '.pdf') AS filename FROM r JOIN catalog c ON c.id = CAST((r.pos*7)%150 AS BIGINT)),
    n AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY pos) - 1 AS n FROM f)
    SELECT pos, id, filename, CASE WHEN n=0 THEN filename ELSE concat(left(filename, length(filename)-4), '_', n, '.pdf') END AS archive_name FROM n""",
)
def archive_manifest(t: Tables):
    named = t.catalog("id").withColumn(
        "filename", F.concat(F.lit("mail_"), (F.col("id") % 3).cast("string"), F.lit(".pdf"))
    )
    return u.archive_manifest(named, [(p * 7) % 150 for p in range(100)])


def _incoming(t: Tables):
    return t.documents.select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"),
        F.sha2("text", 256).alias("content_hash"),
    )


@query(
    "J10_new_files",
    """WITH i AS (SELECT concat('f', doc_id) AS file_id, sha256(text) AS content_hash, source FROM documents)
    SELECT file_id, content_hash FROM i WHERE file_id NOT IN (SELECT concat('f', doc_id) FROM labels) AND content_hash NOT IN (SELECT content_hash FROM i WHERE source IN ('src1','src2'))""",
)
def new_files(t: Tables):
    seen = t.documents.filter(F.col("source").isin("src1", "src2")).select(
        F.lit(None).cast("string").alias("file_id"), F.sha2("text", 256).alias("content_hash")
    )
    by_id = t.labels.select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"),
        F.lit(None).cast("string").alias("content_hash"),
    )
    return u.new_files(_incoming(t), seen.unionByName(by_id)).select("file_id", "content_hash")


@query(
    "T01_first_of_each_content",
    "SELECT sha256(text) AS content_hash, min(concat('f', doc_id)) AS file_id FROM documents GROUP BY 1",
)
def first_of_each_content(t: Tables):
    return u.first_of_each_content(_incoming(t))


# --- file edges ------------------------------------------------------------


def _files(t: Tables):
    """Page sources as files of several kinds."""
    n = F.col("page_id") % 5
    ext = (
        F.when(n == 0, ".txt").when(n == 1, ".pdf").when(n == 2, ".exe").when(n == 3, ".docx").otherwise(".md")
    )
    head = F.when(n == 1, "%PDF-1.7 ").when(n == 3, "PK\u0003\u0004").otherwise("")
    return t.pages.select(
        F.col("page_id").alias("id"),
        F.concat(F.lit("in/p"), F.col("page_id").cast("string"), ext).alias("path"),
        F.encode(F.concat(head, F.regexp_replace("html", "(?i)<script|javascript:|onload=|onerror=", "")), "UTF-8").alias("content"),
    ).withColumn("length", F.length("content").cast("long"))


@query(
    "S09_file_validation",
    """SELECT page_id AS id, CASE page_id%5 WHEN 2 THEN 'text/plain' WHEN 1 THEN 'application/pdf' WHEN 3 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'text/plain' END AS detected_type,
    page_id%5 NOT IN (2,4) AS valid, CASE WHEN page_id%5 IN (2,4) THEN 'file type not allowed' ELSE '' END AS errors FROM pages""",
)
def file_validation(t: Tables):
    files = _files(t)
    report = fl.validation_report(files)
    return report.join(files.select("path", "id"), "path").select("id", "detected_type", "valid", "errors")


@query(
    "S13_plain_text",
    """SELECT page_id AS id, CASE page_id%5 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'unknown' WHEN 3 THEN 'document' ELSE 'text' END AS file_type,
    CASE WHEN page_id%5 IN (0,4) THEN regexp_replace(html, '(?i)<script|javascript:|onload=|onerror=', '', 'g') ELSE '' END AS extracted_text FROM pages""",
)
def plain_text(t: Tables):
    return fl.extract_texts(_files(t)).select("id", "file_type", "extracted_text")


def _word_file(texts: list[str]) -> bytes:
    """A minimal Word file: the texts as paragraphs, then a table of their
    lengths."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def paragraph(x):
        return f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>"

    rows = "".join(
        f"<w:tr><w:tc>{paragraph('Chars')}</w:tc><w:tc>{paragraph('')}</w:tc><w:tc>{paragraph(str(len(x)))}</w:tc></w:tr>"
        for x in texts
    )
    body = "".join(paragraph(x) for x in [*texts, "  "])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(
            "word/document.xml",
            f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl>{rows}</w:tbl></w:body></w:document>',
        )
    return out.getvalue()


@query(
    "S12_word_text",
    """SELECT conv_id AS id, CASE WHEN conv_id%10=9 THEN '' ELSE concat(string_agg(text, chr(10) ORDER BY turn), chr(10), string_agg(concat('Chars | ', length(text)), chr(10) ORDER BY turn)) END AS extracted_text
    FROM (SELECT conv_id, turn, regexp_replace(text, '[\x00-\x09\x0b-\x1f]', '', 'g') AS text FROM conversations) GROUP BY conv_id""",
)
def word_text(t: Tables):
    """Word files made from the conversations, every tenth one damaged."""

    @F.pandas_udf("binary")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _word_file(list(x)))

    clean = F.regexp_replace("text", r"[\x00-\x09\x0b-\x1f]", "")
    talks = (
        t.conversations.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", clean.alias("x")))).alias("turns"))
        .select(F.col("conv_id").alias("id"), F.col("turns.x").alias("texts"))
    )
    whole = talks.select("id", make("texts").alias("content"))
    damaged = F.when(F.col("id") % 10 == 9, F.substring("content", 1, 40)).otherwise(F.col("content"))
    files = whole.select(
        "id", F.concat(F.col("id").cast("string"), F.lit(".docx")).alias("path"), damaged.alias("content")
    )
    return fl.extract_texts(files).select("id", "extracted_text")


@query(
    "S07_new_pdf_files",
    """SELECT concat('in/p', page_id, '.pdf') AS file_id, concat('p', page_id, '.pdf') AS filename, 'QUEUED' AS status FROM pages WHERE page_id%5=1
    AND concat('in/p', page_id, '.pdf') NOT IN (SELECT concat('in/p', doc_id, '.pdf') FROM labels)""",
)
def new_pdf_files(t: Tables):
    files = _files(t).withColumn("modificationTime", F.lit(AS_OF).cast("timestamp"))
    known = t.labels.select(
        F.concat(F.lit("in/p"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_id"),
        F.lit(None).cast("string").alias("content_hash"),
    )
    return u.new_files(fl.ingest_rows(files), known).select("file_id", "filename", "status")


@query("S13_unreadable", "SELECT page_id AS id FROM pages WHERE page_id%5 IN (2,3)")
def unreadable(t: Tables):
    return fl.unreadable(fl.extract_texts(_files(t))).select("id")


@query(
    "S04_completed_analyses",
    "SELECT id, filename, ai_analysis FROM catalog WHERE status='COMPLETED' AND ai_analysis IS NOT NULL",
)
def completed_analyses(t: Tables):
    return tb.completed_analyses(t.catalog("id", "filename", "status", "ai_analysis"))


def _taxonomy_csv(t: Tables):
    return t.part.select(
        F.concat(F.lit(" "), "p_type").alias("primary_category"),
        F.when(F.col("p_brand") == "Brand#1", "  ").otherwise(F.col("p_brand")).alias("subcategory"),
        F.when(F.col("p_size") == 7, "").otherwise(F.concat_ws(" ", "p_brand", "p_name")).alias("term"),
    )


@query(
    "S01_new_taxonomy_terms",
    """SELECT DISTINCT p_type AS primary_category, CASE WHEN p_brand<>'Brand#1' THEN p_brand END AS subcategory, concat(p_brand,' ',p_name) AS term FROM part WHERE p_size <> 7
    AND NOT EXISTS (SELECT 1 FROM taxonomy t WHERE t.primary_category=p_type AND t.term=concat(p_brand,' ',p_name) AND t.subcategory IS NOT DISTINCT FROM CASE WHEN p_brand<>'Brand#1' THEN p_brand END)""",
)
def new_taxonomy_terms(t: Tables):
    return tb.new_taxonomy_terms(_taxonomy_csv(t), t.taxonomy)


@query(
    "S01_load_report",
    """SELECT (SELECT count(*) FROM (SELECT DISTINCT p_type, p_brand, p_name FROM part WHERE p_size <> 7 AND p_name LIKE 'red %')) AS created,
    (SELECT count(*) FROM part WHERE p_size = 7) AS errors""",
)
def load_report(t: Tables):
    raw = _taxonomy_csv(t)
    return tb.taxonomy_load_report(raw, tb.new_taxonomy_terms(raw, t.taxonomy))


@query(
    "S02_typed_predictions",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey%4<>2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_created, CASE WHEN o_orderkey%3=0 THEN NULL ELSE 'HIGH' END AS date_confidence,
    CASE WHEN o_orderkey%2=0 THEN NULL ELSE o_orderpriority END AS client, o_orderkey%3 < 2 AS is_frank, o_orderkey%5 = 0 AS needs_review FROM orders""",
)
def typed_predictions(t: Tables):
    n, day = F.col("o_orderkey"), F.col("o_orderdate")
    written = (
        F.when(n % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(n % 4 == 1, F.date_format(day, "M/d/yyyy"))
        .when(n % 4 == 2, "not a date")
        .otherwise(F.date_format(day, "MMMM d, yyyy"))
    )
    blank = F.lit("").alias
    raw = t.orders.select(
        n.cast("string").alias("id"),
        written.alias("date_created"),
        F.when(n % 3 == 0, " None ").otherwise("HIGH").alias("date_confidence"),
        F.when(n % 2 == 0, "NULL").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("client"),
        F.when(n % 3 == 0, " TRUE").when(n % 3 == 1, "1").otherwise("no").alias("is_frank"),
        F.when(n % 5 == 0, "yes").otherwise("").alias("needs_review"),
        blank("client_confidence"), blank("paid_for_by_raw"), blank("state"), blank("state_confidence"),
    )
    return tb.typed_predictions(raw).select(
        "id", "date_created", "date_confidence", "client", "is_frank", "needs_review"
    )
