"""State changes of the catalog as DataFrame transforms.

Plain files cannot be updated in place, so each operator returns the new state
of the table: a left join with the change set and a per-column choice.  Change
sets have one row per document; :func:`latest` makes them so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.functions import analysis as an
from foliary.functions import dates
from foliary.functions.text import blank_to_null, safe_file_name, strip
from foliary.operators import filters
from foliary.operators.common import lookup_join, moment


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key.  ``max_by`` combines before the shuffle, so
    a key with very many changes is no burden."""
    rest = [c for c in changes.columns if c != key]
    return (
        changes.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
        .select(key, "_last.*")
    )


def update(
    table: DataFrame, changes: DataFrame, columns: list[str], key: str = "id", keep_null: bool = False
) -> DataFrame:
    """Set ``columns`` of the rows whose key is in ``changes``.

    With ``keep_null`` an absent new value leaves the old one in place.
    """
    new = changes.select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    joined = table.join(new, key, "left")

    def choose(c):
        if keep_null:
            return F.coalesce(f"_new_{c}", c)
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))

    present = [c for c in columns if c in table.columns]
    added = [c for c in columns if c not in table.columns]
    return joined.select(
        *[(choose(c).alias(c) if c in present else F.col(c)) for c in table.columns],
        *[F.col(f"_new_{c}").alias(c) for c in added],
    )


def updated_count(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    return table.join(changes.select(key), key, "left_semi").agg(F.count("*").alias("updated"))


# --- status ----------------------------------------------------------------


def progress_after(status: Column, progress: Column) -> Column:
    """Progress clamped to 0..100; 100 once completed."""
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), progress))
    return F.when(status == "COMPLETED", F.lit(100)).otherwise(
        F.when(progress.isNotNull(), clamped)
    )


def apply_status(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """Status transitions, all events of a document in turn: the last status, progress and
    error that an event gives, and the last start and completion.
    ``events``: id, status, progress, error, ts."""
    ts, status = F.col("ts"), F.col("status")
    progress = progress_after(status, F.col("progress"))
    error = blank_to_null(F.col("error"))
    new = events.groupBy("id").agg(
        F.max_by("status", "ts").alias("_status"),
        F.max_by(progress, F.when(progress.isNotNull(), ts)).alias("_progress"),
        F.max_by(error, F.when(error.isNotNull(), ts)).alias("_error"),
        F.max(F.when(status == "PROCESSING", ts)).alias("_started"),
        F.max(F.when(status == "COMPLETED", ts)).alias("_processed"),
    )
    pairs = {
        "status": "_status",
        "processing_progress": "_progress",
        "processing_error": "_error",
        "processing_started_at": "_started",
        "processed_at": "_processed",
    }
    joined = catalog.join(new, "id", "left")
    return joined.select(
        *[
            F.coalesce(pairs[c], c).alias(c) if c in pairs else F.col(c)
            for c in catalog.columns
        ]
    )


def rescue_zombies(catalog: DataFrame, as_of, threshold: int = fv.ZOMBIE_SECONDS) -> DataFrame:
    """Documents silent for too long go back to the queue."""
    zombie = F.coalesce(filters.is_zombie(as_of, threshold), F.lit(False))
    note = F.concat(
        F.lit("Reset from zombie PROCESSING state at "),
        F.date_format(moment(as_of), "yyyy-MM-dd'T'HH:mm:ss"),
    )
    # all three read the old row, so the test is taken once beforehand
    flagged = catalog.withColumn("_zombie", zombie)
    return flagged.withColumns(
        {
            "status": F.when(F.col("_zombie"), "QUEUED").otherwise(F.col("status")),
            "processing_heartbeat_at": F.when(~F.col("_zombie"), F.col("processing_heartbeat_at")),
            "processing_error": F.when(F.col("_zombie"), note).otherwise(F.col("processing_error")),
        }
    ).drop("_zombie")


def next_in_queue(catalog: DataFrame, slots: int = fv.PROCESSING_SLOTS) -> DataFrame:
    """Oldest queued documents for the free slots; none when all are taken."""
    busy = catalog.agg(F.count_if(F.col("status") == "PROCESSING")).scalar()
    first = (
        catalog.filter(F.col("status") == "QUEUED")
        .select("id", "created_at")
        .orderBy("created_at", "id")
        .limit(slots)
    )
    # at most ``slots`` rows are numbered
    place = F.row_number().over(Window.orderBy("created_at", "id"))
    return (
        first.withColumn("place", place)
        .withColumn("free", F.lit(slots) - busy)
        .filter(F.col("place") <= F.col("free"))
        .drop("free")
    )


def mark_pending(catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    return update(catalog, chosen.select("id", F.lit("PENDING").alias("status")), ["status"])


# --- content ---------------------------------------------------------------


def keywords_data(keywords: Column, categories: Column, mappings: Column, as_of) -> Column:
    """The stored keywords struct."""
    none = F.array().cast("ARRAY<STRING>")
    return F.struct(
        F.coalesce(keywords, none).alias("keywords"),
        F.coalesce(categories, none).alias("categories"),
        F.coalesce(mappings, an.no_mappings()).alias("keyword_mappings"),
        F.coalesce(F.size(mappings), F.lit(0)).alias("mapping_count"),
        F.date_format(moment(as_of), "yyyy-MM-dd'T'HH:mm:ss").alias("extraction_timestamp"),
    )


def merged_metadata(old: Column, new: Column) -> Column:
    """Entries of both maps; of a key in both the new value counts.  Nothing
    new leaves the old map, null too, as it is."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return (
        F.when(F.coalesce(F.size(new), F.lit(0)) <= 0, old)
        .when(old.isNull(), new)
        .otherwise(F.map_concat(kept, new))
    )


def update_content(catalog: DataFrame, content: DataFrame, as_of) -> DataFrame:
    """New text, analysis and keywords; only non-empty inputs overwrite, and the
    search content is rebuilt where keywords changed.

    ``content``: id, extracted_text, ai_analysis, new_keywords, new_categories,
    new_mappings; with ``new_metadata`` (a map) its entries are merged into the
    catalog's ``file_metadata``.
    """
    if "new_metadata" in content.columns:
        merged = F.coalesce(F.col("new_metadata"), F.create_map().cast("map<string,string>"))
        with_new = catalog.join(content.select("id", merged.alias("new_metadata")), "id", "left")
        catalog = with_new.withColumn(
            "file_metadata", merged_metadata(F.col("file_metadata"), F.col("new_metadata"))
        ).drop("new_metadata")

    def given(c):
        return F.coalesce(F.size(c), F.lit(0)) > 0

    any_keywords = given("new_keywords") | given("new_categories") | given("new_mappings")
    new = content.select(
        "id",
        F.nullif(F.col("extracted_text"), F.lit("")).alias("_text"),
        F.nullif(F.col("ai_analysis"), F.lit("")).alias("_analysis"),
        F.when(
            any_keywords,
            keywords_data(F.col("new_keywords"), F.col("new_categories"), F.col("new_mappings"), as_of),
        ).alias("_keywords"),
    )
    joined = catalog.join(new, "id", "left").withColumns(
        {
            "extracted_text": F.coalesce("_text", "extracted_text"),
            "ai_analysis": F.coalesce("_analysis", "ai_analysis"),
        }
    )
    rebuilt = an.search_content(
        F.col("filename"),
        F.col("extracted_text"),
        an.parse_analysis(F.col("ai_analysis")),
        F.col("_keywords"),
    )
    return joined.withColumns(
        {
            "search_content": F.when(F.col("_keywords").isNotNull(), rebuilt).otherwise(
                F.col("search_content")
            ),
            "keywords": F.coalesce(F.col("_keywords"), F.col("keywords").cast(_KEYWORDS_TYPE)),
        }
    ).drop("_text", "_analysis", "_keywords")


_KEYWORDS_TYPE = (
    "STRUCT<keywords: ARRAY<STRING>, categories: ARRAY<STRING>, "
    f"keyword_mappings: {an.MAPPINGS_TYPE}, mapping_count: INT, extraction_timestamp: STRING>"
)


def with_stamped_keywords(catalog: DataFrame) -> DataFrame:
    """Keywords in the stored layout, with an empty time stamp where absent."""
    k = F.col("keywords")
    return catalog.withColumn(
        "keywords",
        F.when(
            k.isNotNull(),
            F.struct(
                k["keywords"],
                k["categories"],
                k["keyword_mappings"],
                k["mapping_count"],
                F.lit(None).cast("string").alias("extraction_timestamp"),
            ),
        ),
    )


def reset_documents(catalog: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Clear all derived content of the given documents and queue them."""
    hit = catalog.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    cleared = {
        "extracted_text", "ai_analysis", "keywords", "search_vector", "processing_error",
        "processed_at",
    }
    fixed = {
        "status": F.lit("QUEUED"),
        "processing_progress": F.lit(0),
        "updated_at": moment(as_of),
    }

    def column(c):
        if c in cleared:
            return F.when(F.col("_hit").isNull(), F.col(c)).alias(c)
        if c in fixed:
            return F.when(F.col("_hit"), fixed[c]).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return hit.select(*[column(c) for c in catalog.columns])


def drop_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    return links.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def update_embeddings(catalog: DataFrame, vectors: DataFrame) -> DataFrame:
    """New vectors with model, version and provenance; absent values keep the
    old ones."""
    columns = ["search_vector", "embedding_model", "embedding_version", "embedding_provenance"]
    return update(
        catalog, vectors, [c for c in columns if c in vectors.columns], keep_null=True
    )


def delete_documents(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("id"), "id", "left_anti")


def deletion_report(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Outcome per requested id."""
    known = catalog.select("id", F.lit(True).alias("_found"))
    joined = ids.select("id").distinct().join(known, "id", "left")
    found = F.coalesce("_found", F.lit(False))
    return joined.select(
        F.col("id").alias("document_id"),
        found.alias("success"),
        F.when(~found, "Document not found").alias("error"),
    )


# --- features and review ---------------------------------------------------


def feature_candidates(catalog: DataFrame, force: bool = False) -> DataFrame:
    """Documents with text whose canonical client is not set, or all of them."""
    rows = catalog.filter(F.col("extracted_text") != "")
    return rows if force else rows.filter(F.col("client_canonical").isNull())


def document_features(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Everything the one-document path derives: fields, clean and canonical
    client, checked date, review flag, and where each came from.

    ``docs``: id, extracted_text, ai_analysis, keywords.
    """
    from foliary.functions import names
    from foliary.operators import entities, extraction

    fields = extraction.extract_fields(docs)
    cleaned = fields.withColumn("client_clean_v1", names.clean_client(F.col("paid_for_by_raw")))
    # distinct names first would extract all fields a second time
    canonical = entities.resolve_clients(cleaned, overrides, per_row=True).withColumnsRenamed(
        {"client_canonical": "resolved", "resolution_source": "rules_source"}
    )
    analysis = an.parse_analysis(F.col("ai_analysis"))
    nested = analysis["document_analysis"]
    summary = F.when(nested.isNotNull(), nested["summary"]).otherwise(analysis["summary"])
    mappings = F.coalesce(F.col("keywords.keyword_mappings"), an.no_mappings())
    named = canonical.withColumns(
        {"_summary": F.coalesce(summary, F.lit("")), "_mappings": mappings}
    ).withColumn(
        "_ai", names.name_from_analysis(F.col("_mappings"), F.col("_summary"), attack=False)
    )
    named = named.withColumns(
        {
            "client_from_ai": F.col("_ai.client_from_ai"),
            "ai_confidence": F.col("_ai.ai_confidence"),
            "source_tier": F.col("_ai.source_tier"),
        }
    )
    merged = entities.merge_with_agreement(named)
    checked = merged.withColumn("_d", dates.checked_date(F.col("predicted_date")))
    return checked.select(
        "id",
        "paid_for_by_raw",
        "is_frank",
        F.col("predicted_candidate").alias("client"),
        "client_clean_v1",
        "client_canonical",
        F.col("candidate_confidence").alias("client_confidence"),
        F.col("predicted_state").alias("state"),
        "state_confidence",
        F.col("_d.date_created"),
        "date_confidence",
        F.col("_d.needs_date_review"),
        "needs_review",
        F.struct(
            "canonical_source",
            "rules_source",
            "ai_confidence",
            F.col("source_tier").alias("ai_tier"),
            F.lit(1).alias("extraction_version"),
        ).alias("feature_extraction"),
    )


def write_features(catalog: DataFrame, overrides: DataFrame, force: bool = False) -> DataFrame:
    """Catalog with the features of its candidates filled in."""
    todo = feature_candidates(catalog, force).select(
        "id", "extracted_text", "ai_analysis", "keywords"
    )
    features = document_features(todo, overrides)
    return update(catalog, features, [c for c in features.columns if c != "id"])


def judge_corrections(corrections: DataFrame) -> DataFrame:
    """Reviewer corrections (text columns date_created, client_canonical,
    state) with parsed values and the reason of refusal, if any."""
    raw = F.col("date_created")
    given = F.coalesce(raw, F.lit("")) != ""
    parsed = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")).cast("date")
    state = F.upper(strip(F.col("state")))
    return corrections.select(
        "id",
        F.when(given, parsed).alias("date_created"),
        F.col("client_canonical").isNotNull().alias("has_client"),
        blank_to_null(strip(F.col("client_canonical"))).alias("client_canonical"),
        F.col("state").isNotNull().alias("has_state"),
        blank_to_null(state).alias("state"),
        F.when(given & parsed.isNull(), "invalid date")
        .when(given & ~dates.year_is_valid(parsed), "date out of range")
        .when((state != "") & (F.length(state) != 2), "state must have two letters")
        .alias("error"),
    )


def resolve_reviews(catalog: DataFrame, judged: DataFrame) -> DataFrame:
    """Apply the accepted corrections and clear the review flags."""
    ok = judged.filter(F.col("error").isNull()).select(
        "id",
        F.lit(True).alias("_hit"),
        F.col("date_created").alias("_date"),
        "has_client",
        F.col("client_canonical").alias("_client"),
        "has_state",
        F.col("state").alias("_state"),
    )
    joined = catalog.join(ok, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    client, state = F.coalesce("has_client", F.lit(False)), F.coalesce("has_state", F.lit(False))
    rules = {
        "date_created": (hit, F.col("_date")),
        "client_canonical": (client, F.col("_client")),
        "client_confidence": (client, F.lit("HIGH")),
        "state": (state, F.col("_state")),
        "state_confidence": (state, F.lit("HIGH")),
        "needs_date_review": (hit, F.lit(False)),
        "needs_review": (hit, F.lit(False)),
    }
    return joined.select(
        *[
            F.when(rules[c][0], rules[c][1]).otherwise(F.col(c)).alias(c) if c in rules else F.col(c)
            for c in catalog.columns
        ]
    )


def upsert_overrides(overrides: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overrides keyed by clean name; a later incoming row wins.

    ``incoming``: client_clean_v1, client_canonical, ord.
    """
    rows = incoming.select(
        strip(F.col("client_clean_v1")).alias("client_clean_v1"),
        strip(F.col("client_canonical")).alias("client_canonical"),
        F.col("ord").cast("long").alias("ord"),
    ).filter("client_clean_v1 <> '' AND client_canonical <> ''")
    old = overrides.select(
        "client_clean_v1", "client_canonical", F.lit(-1).cast("long").alias("ord")
    )
    return latest(old.unionByName(rows), "client_clean_v1", "ord").drop("ord")


def flag_bad_years(catalog: DataFrame) -> DataFrame:
    """Flag existing rows whose year is out of range."""
    bad = F.coalesce(~dates.year_is_valid(F.col("date_created")), F.lit(False))
    return catalog.withColumn(
        "needs_date_review", F.when(bad, F.lit(True)).otherwise(F.col("needs_date_review"))
    )


def backfill_mappings(catalog: DataFrame, as_of) -> DataFrame:
    """Copy the mappings of the analysis into the keywords where those have
    none."""
    empty = F.array().cast("ARRAY<STRING>")
    content = filters.mapping_backfill(catalog).select(
        "id",
        F.lit(None).cast("string").alias("extracted_text"),
        F.lit(None).cast("string").alias("ai_analysis"),
        empty.alias("new_keywords"),
        empty.alias("new_categories"),
        an.parse_analysis(F.col("ai_analysis"))["keyword_mappings"].alias("new_mappings"),
    )
    return update_content(catalog, content, as_of)


# --- registration and archives ---------------------------------------------


def register_uploads(files: DataFrame, delay: int = fv.START_DELAY_SECONDS) -> DataFrame:
    """One QUEUED row per named file of an upload; the n-th file of its batch
    starts ``n * delay`` seconds later.

    ``files``: batch_id, arrival, name, file_size.  ``arrival`` is the running
    number of the file inside its batch, as the upload delivers it, so no batch
    has to be ordered as a whole.
    """
    return files.filter(F.coalesce("name", F.lit("")) != "").select(
        "batch_id",
        "arrival",
        safe_file_name(F.col("name")).alias("filename"),
        F.coalesce("file_size", F.lit(0)).alias("file_size"),
        F.lit("QUEUED").alias("status"),
        (F.col("arrival") * delay).alias("starts_in_seconds"),
    )


def archive_manifest(catalog: DataFrame, ids: list[int]) -> DataFrame:
    """``(pos, id, filename, archive_name)`` of the requested documents that
    exist; repeated names become ``stem_n.ext``.  At most 100 ids."""
    if not ids:
        raise ValueError("no document ids given")
    if len(ids) > fv.MAX_ARCHIVE_IDS:
        raise ValueError(f"too many documents (max {fv.MAX_ARCHIVE_IDS})")
    wanted = catalog.sparkSession.createDataFrame(
        list(enumerate(ids)), "pos int, id long"
    )
    # the request is bounded, so is the window below
    found = wanted.join(
        catalog.filter(F.col("id").isin(list(ids))).select("id", "filename"), "id"
    )
    n = F.row_number().over(Window.partitionBy("filename").orderBy("pos")) - 1
    numbered = found.withColumn("n", n)
    name, k = F.col("filename"), F.col("n").cast("string")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    renamed = F.when(
        ext != "", F.concat(stem, F.lit("_"), k, F.lit("."), ext)
    ).otherwise(F.concat(name, F.lit("_"), k))
    return numbered.select(
        "pos",
        "id",
        "filename",
        F.when(F.col("n") == 0, name).otherwise(renamed).alias("archive_name"),
    )


# --- ingest ----------------------------------------------------------------


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose id and whose content are both unknown.  Two anti-joins; an
    OR between the keys would have to compare every pair."""
    by_id = files.join(
        known.select("file_id").filter("file_id IS NOT NULL"), "file_id", "left_anti"
    )
    # one content may make up a large share of the files
    return lookup_join(
        by_id,
        known.select("content_hash").filter("content_hash IS NOT NULL").distinct(),
        "content_hash",
        "left_anti",
    )


def first_of_each_content(files: DataFrame) -> DataFrame:
    """One file per content, the one with the smallest id."""
    rest = [c for c in files.columns if c != "content_hash"]
    return (
        files.groupBy("content_hash")
        .agg(F.min_by(F.struct(*rest), F.col("file_id")).alias("f"))
        .select("content_hash", "f.*")
    )
