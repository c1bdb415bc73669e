"""Registered queries that go through stored indexes; their results equal those of the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import block_postings as bp
from foliary.operators import deep_pages as dp
from foliary.operators import deltas as dl
from foliary.operators import facet_bitmaps as fb
from foliary.operators import filters as f
from foliary.operators import search as s
from foliary.operators import trigrams as tg
from foliary.operators import vector_index as vi
from foliary.plans.catalog_queries import _DONE, _NEWEST, _PATH, _REVIEW, _STORED
from foliary.plans.registry import query
from foliary.plans.search_queries import COLUMNS, _MATCHES, _STOPS, _TOKENS, _WORDS, _hits, _near, _page_sql, _rank, _request, _round, request_vector
from foliary.session import new_folder

# --- vectors ---------------------------------------------------------------


def _index(t, rows=None) -> vi.VectorIndex:
    catalog = rows if rows is not None else t.catalog("id", "search_vector")
    return vi.write_index(catalog, new_folder(t.spark, "vector-index"))


@query("K01_indexed_top_k", f"SELECT id, round(vector_relevance, 6) AS vector_relevance FROM ({_near(1, 400)})")
def indexed_top_k(t):
    """All lists are read, so the answer is exact."""
    index = _index(t)
    return _round(vi.nearest(t.spark, index, request_vector(1), 400, len(index.centroids)), "vector_relevance")


@query("K01_appended_index", f"SELECT id, round(vector_relevance, 6) AS vector_relevance FROM ({_near(3, 100)})")
def appended_index(t):
    """Half of the vectors are indexed first, the others appended; the index is opened again."""
    catalog = t.catalog("id", "search_vector")
    index = _index(t, catalog.where("id % 2 = 0"))
    vi.append_to_index(index, catalog.where("id % 2 <> 0"))
    index = vi.open_index(t.spark, index.path)
    return _round(vi.nearest(t.spark, index, request_vector(3), 100, len(index.centroids)), "vector_relevance")


_COS = (
    "list_cosine_similarity(list_transform(q.search_vector, lambda x: CAST(x AS DOUBLE)), list_transform(c.search_vector, lambda x: CAST(x AS DOUBLE)))"
)
_PER_QUERY = 10
_EXACT = (
    f"SELECT query_id, id, vector_relevance, rank FROM (SELECT q.id AS query_id, c.id, {_COS} AS vector_relevance, "
    f"row_number() OVER (PARTITION BY q.id ORDER BY {_COS} DESC, c.id) AS rank FROM catalog q, catalog c "
    f"WHERE q.id % 100 = 0 AND q.search_vector IS NOT NULL AND c.search_vector IS NOT NULL) WHERE rank <= {_PER_QUERY}"
)


def _queries(catalog):
    asked = catalog.where("id % 100 = 0 AND search_vector IS NOT NULL")
    return asked.select(F.col("id").alias("query_id"), F.col("search_vector").alias("vector"))


@query("K01_nearest_of_many", f"SELECT query_id, id, round(vector_relevance, 6) AS vector_relevance, rank FROM ({_EXACT})")
def nearest_of_many(t):
    catalog = t.catalog("id", "search_vector")
    index = _index(t, catalog)
    found = vi.nearest_of_many(index, _queries(catalog), _PER_QUERY, len(index.centroids)).drop("list")
    return _round(found, "vector_relevance")


@query("K01_index_recall")
def index_recall(t):
    """Recall with as many lists as a sample of the rows says is enough for 0.95; probed lists depend on
    training, so there is no SQL."""
    catalog = t.catalog("id", "search_vector")
    index = _index(t, catalog)
    vectors = catalog.where("search_vector IS NOT NULL").select(F.col("id").alias("query_id"), F.col("search_vector").alias("vector"))
    probes = vi.tuned_probes(index, vectors, _PER_QUERY, 0.95)
    asked = _queries(catalog)
    exact = vi.nearest_of_many(index, asked, _PER_QUERY, len(index.centroids))
    found = vi.nearest_of_many(index, asked, _PER_QUERY, probes)
    return vi.recall(found, exact).withColumn("probes", F.lit(probes)).withColumn("lists", F.lit(len(index.centroids)))


# --- substrings ------------------------------------------------------------


@query(
    "P05_indexed_substring_search",
    f"""SELECT id, filename, CAST(created_at AS VARCHAR) AS created_at FROM catalog
    WHERE {_DONE} AND (filename ILIKE '%tion%' OR search_content ILIKE '%tion%') {_NEWEST} LIMIT 50""",
)
def indexed_substring_search(t):
    catalog = t.catalog("id", "filename", "status", "created_at", "search_content")
    fields = {c: F.col(c) for c in ("filename", "search_content")}
    path = new_folder(t.spark, "trigrams")
    tg.write_trigrams(catalog, fields, path)
    found = tg.containing(catalog, path, fields, "tion").where("status = 'COMPLETED'")
    return f.newest_first(found, 50).select("id", "filename", "created_at")


@query(
    "P06_indexed_editor_search",
    f"SELECT {_REVIEW} FROM catalog WHERE filename ILIKE '%000000012%' OR client_canonical ILIKE '%000000012%' {_NEWEST} LIMIT 25",
)
def indexed_editor_search(t):
    catalog = t.catalog(*f.REVIEW_COLUMNS)
    fields = {c: F.col(c) for c in ("filename", "client_canonical")}
    path = new_folder(t.spark, "trigrams")
    tg.write_trigrams(catalog, fields, path)
    return f.newest_first(tg.containing(catalog, path, fields, "000000012").select(*f.REVIEW_COLUMNS), 25)


def _terms() -> dict:
    names = ("verbatim_term", "mapped_canonical_term")
    return {n: F.col(f"keywords.keyword_mappings.{n}") for n in names}


@query(
    "P09_indexed_term_filter",
    f"SELECT DISTINCT c.id, c.filename FROM catalog c JOIN {_STORED} m ON m.id=c.id WHERE m.mapped_canonical_term ILIKE '%gizmo%' OR m.verbatim_term ILIKE '%gizmo%'",
)
def indexed_term_filter(t):
    catalog = t.catalog("id", "filename", "keywords")
    path = new_folder(t.spark, "trigrams")
    tg.write_trigrams(catalog, _terms(), path)
    return tg.containing(catalog, path, _terms(), "gizmo").select("id", "filename")


@query(
    "P10_indexed_verbatim_term_search",
    f"""SELECT DISTINCT ON (c.created_at, c.id) c.id, c.filename, CAST(c.created_at AS VARCHAR) AS created_at FROM catalog c JOIN {_STORED} m ON m.id=c.id
    WHERE c.{_DONE} AND m.verbatim_term ILIKE '%small%' ORDER BY c.created_at DESC, c.id LIMIT 20""",
)
def indexed_verbatim_term_search(t):
    catalog = t.catalog("id", "filename", "status", "created_at", "keywords")
    path = new_folder(t.spark, "trigrams")
    tg.write_trigrams(catalog, _terms(), path)
    found = tg.containing(catalog, path, {"verbatim_term": _terms()["verbatim_term"]}, "small").where("status = 'COMPLETED'")
    return f.newest_first(found, 20).select("id", "filename", "created_at")


@query(
    "P21_indexed_matching_terms",
    f"SELECT id, primary_category, subcategory, term, {_PATH} AS full_path FROM taxonomy WHERE term ILIKE '%1 s_all%'",
)
def indexed_matching_terms(t):
    """A term with a wildcard: the literal stretches give the trigrams."""
    from foliary.operators import mappings as m

    path, fields = new_folder(t.spark, "trigrams"), {"term": F.col("term")}
    tg.write_trigrams(t.taxonomy, fields, path)
    return m.matching_terms(tg.containing(t.taxonomy, path, fields, "1 S_ALL", wildcards=True), "")


# --- ranked pages ----------------------------------------------------------


def _blocks(t, ids: int):
    """Stored blocks over the unstemmed words of all documents."""
    path = new_folder(t.spark, "block-postings")
    bp.write_blocks(bp.blocks(s.postings(t.catalog("id", "filename", "extracted_text"), stem=False), ids), path)
    return t.spark.read.parquet(path)


@query(
    "R03_top_documents_on_blocks",
    f"WITH {_hits(_WORDS)} SELECT id, round(text_relevance, 6) AS text_relevance FROM ({_rank(_WORDS)}) ORDER BY text_relevance DESC, id LIMIT 20",
)
def top_documents_on_blocks(t):
    return _round(bp.top_documents(_blocks(t, 64), _WORDS, 20), "text_relevance")


@query(
    "R05_hybrid_page_on_blocks",
    f"WITH {_hits(_WORDS)} {_page_sql(_MATCHES, 'relevance DESC, id', 20)}",
)
def hybrid_page_on_blocks(t):
    page = bp.hybrid_page(t.catalog(*COLUMNS), _request(), _blocks(t, 64), ids=64)
    return _round(page.select("id", "relevance", "normalised"), "relevance", "normalised")


# --- deep pages ------------------------------------------------------------


@query(
    "K03_deep_page",
    f"SELECT id, filename, file_size, place FROM (SELECT id, filename, file_size, row_number() OVER (ORDER BY file_size DESC NULLS LAST, id) AS place FROM catalog) WHERE place > 150 AND place <= 165",
)
def deep_page(t):
    return dp.deep_page(t.catalog("id", "filename", "file_size"), "file_size", 11, 15, ranges=8)


@query(
    "K03_page_after_key",
    """SELECT c.id, c.filename, c.file_size FROM catalog c, (SELECT file_size, id FROM catalog ORDER BY file_size DESC NULLS LAST, id LIMIT 1 OFFSET 149) k
    WHERE c.file_size < k.file_size OR (c.file_size = k.file_size AND c.id > k.id) ORDER BY c.file_size DESC, c.id LIMIT 15""",
)
def page_after_key(t):
    """The page behind the last row of the tenth page, whose key the caller holds."""
    catalog = t.catalog("id", "filename", "file_size")
    last = dp.deep_page(catalog, "file_size", 10, 15, ranges=8).orderBy(F.desc("place")).select("file_size", "id").first()
    return dp.page_after(catalog, "file_size", (last["file_size"], last["id"]), 15)


# --- upkeep by changes -----------------------------------------------------

# one document of seven gets other words, a failure and no mappings; one of eleven of the others goes
_CHANGED = (
    "changed AS (SELECT id, filename, CASE WHEN id%7=0 THEN concat('fresh words ', coalesce(extracted_text, '')) ELSE extracted_text END AS extracted_text, "
    "CASE WHEN id%7=0 THEN 'FAILED' ELSE status END AS status FROM catalog WHERE id%7=0 OR id%11<>0)"
)


def _postings_view(df):
    return s.posting_lists(stem=False)


def _links_view(taxonomy):
    def view(df):
        names = df.select(F.col("id").alias("document_id"), F.explode("keywords.keyword_mappings.mapped_canonical_term").alias("term"))
        terms = taxonomy.select("term", F.col("id").alias("taxonomy_term_id"))
        return names.distinct().join(terms, "term").select("document_id", "taxonomy_term_id")

    return view


def _after_changes(t, table_of, view, *columns):
    """A derived table after a first load and one batch of changes."""
    catalog = t.catalog("id", *columns)
    documents = dl.CatalogTable(new_folder(t.spark, "catalog"), 16)
    table = table_of(new_folder(t.spark, "derived"))
    dl.update(t.spark, documents, [(table, view)], 0, catalog)
    other = {
        "extracted_text": F.concat(F.lit("fresh words "), F.coalesce("extracted_text", F.lit(""))) if "extracted_text" in columns else None,
        "status": F.lit("FAILED") if "status" in columns else None,
        "keywords": F.lit(None).cast(catalog.schema["keywords"].dataType) if "keywords" in columns else None,
    }
    upserts = catalog.where("id % 7 = 0").withColumns({n: c for n, c in other.items() if c is not None})
    deleted = catalog.where("id % 11 = 0 AND id % 7 <> 0").select("id")
    for _ in range(2):  # a repeated batch changes nothing
        dl.update(t.spark, documents, [(table, view)], 1, upserts, deleted)
    return table.current(t.spark)


@query(
    "M02_incremental_postings",
    f"WITH {_CHANGED} SELECT id, lexeme, pos FROM ({_TOKENS.replace('FROM catalog', 'FROM changed')}) WHERE lexeme NOT IN ({_STOPS})",
)
def incremental_postings(t):
    def table(path):
        return dl.SignedLists(path, ("lexeme", "pos"), "lexeme", 16)

    return _after_changes(t, table, _postings_view, "filename", "extracted_text").select("id", "lexeme", "pos")


@query(
    "J04_incremental_links",
    f"SELECT DISTINCT m.id AS document_id, t.id AS taxonomy_term_id FROM {_STORED} m JOIN taxonomy t ON t.term=m.mapped_canonical_term WHERE m.id%7<>0 AND m.id%11<>0",
)
def incremental_links(t):
    def table(path):
        return dl.SignedTable(path, ("document_id", "taxonomy_term_id"), "document_id", 16)

    return _after_changes(t, table, _links_view(t.taxonomy), "keywords").select("document_id", "taxonomy_term_id")


@query(
    "A21_incremental_facets",
    f"""SELECT taxonomy_term_id, count(*) AS n FROM (SELECT DISTINCT m.id, t.id AS taxonomy_term_id FROM {_STORED} m JOIN taxonomy t ON t.term=m.mapped_canonical_term
    WHERE m.id%7<>0 AND m.id%11<>0) GROUP BY 1""",
)
def incremental_facets(t):
    def table(path):
        return dl.SignedTable(path, ("taxonomy_term_id",), "taxonomy_term_id", 16)

    links = _links_view(t.taxonomy)
    return _after_changes(t, table, lambda df: links(df).select("taxonomy_term_id"), "keywords")


@query("A08_incremental_status_counts", f"WITH {_CHANGED} SELECT status, count(*) AS n FROM changed GROUP BY 1")
def incremental_status_counts(t):
    def table(path):
        return dl.SignedTable(path, ("status",), "status", 4)

    return _after_changes(t, table, lambda df: df.select("status"), "status")


# --- facets by bitmaps -----------------------------------------------------


@query(
    "A21_bitmap_facets",
    """SELECT t.primary_category, t.subcategory, t.term, count(*) AS count FROM catalog c JOIN doc_terms l ON l.document_id=c.id JOIN taxonomy t ON t.id=l.taxonomy_term_id
    WHERE c.status='COMPLETED' AND year(c.date_created)=2021 GROUP BY ALL""",
)
def bitmap_facets(t):
    """Facets of the filtered documents, without joining links to documents."""
    path = new_folder(t.spark, "bitmaps")
    fb.write_bitmaps(t.links(), path)
    matching = f.exact_filters(t.catalog("id", "status", "client_canonical", "state", "date_created").where("status = 'COMPLETED'"), year=2021)
    counts = fb.facets(t.spark.read.parquet(path), matching)
    named = t.taxonomy.select(F.col("id").alias("taxonomy_term_id"), "primary_category", "subcategory", "term")
    return named.join(counts, "taxonomy_term_id").select("primary_category", "subcategory", "term", "count")


@query(
    "A21_bitmap_facets_of_search",
    f"""WITH {_hits(_WORDS)} SELECT taxonomy_term_id, count(*) AS count FROM ({_MATCHES}) m JOIN doc_terms l ON l.document_id=m.id GROUP BY 1""",
)
def bitmap_facets_of_search(t):
    """Facets of all matches of a hybrid search."""
    path = new_folder(t.spark, "bitmaps")
    fb.write_bitmaps(t.links(), path)
    matches = s.hybrid_search(t.catalog(*COLUMNS), _request()).matches
    return fb.facets(t.spark.read.parquet(path), matches)
