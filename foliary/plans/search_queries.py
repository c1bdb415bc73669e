"""Registered queries: full-text, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import filters as f
from foliary.operators import search as s
from foliary.plans.catalog_queries import _STORED
from foliary.plans.derived import AS_OF, Tables
from foliary.plans.registry import query
from foliary import fixed_values as fv

# request vectors made by a rule; the same rule is written out in the check SQL
def request_vector(seed: int) -> list[float]:
    return [((i * 37 + seed * 11) % 23 - 11) / 11.0 for i in range(64)]


def _vector_sql(seed: int) -> str:
    return "[" + ",".join(f"CAST({x!r} AS DOUBLE)" for x in request_vector(seed)) + "]"


def _cosine(seed: int) -> str:
    v = "list_transform(search_vector, lambda x: CAST(x AS DOUBLE))"
    return f"list_cosine_similarity({v}, {_vector_sql(seed)})"


def _near(seed: int, k: int = 500) -> str:
    return (
        f"SELECT id, {_cosine(seed)} AS vector_relevance FROM catalog WHERE search_vector IS NOT NULL "
        f"ORDER BY 2 DESC, 1 LIMIT {k}"
    )


_STOPS = ", ".join(f"'{w}'" for w in fv.TEXT_STOP_WORDS)
_TOKENS = (
    "SELECT id, unnest(w) AS lexeme, unnest(range(1, len(w)+1)) AS pos FROM (SELECT id, "
    "list_filter(regexp_split_to_array(lower(concat_ws(' ', filename, extracted_text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM catalog)"
)


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _rank(words: list[str], hits: str = "hits") -> str:
    """Cover density by brute force: the end of the cover from each start."""
    ends = ", ".join(
        f"(SELECT min(h.pos) FROM {hits} h WHERE h.id=s.id AND h.lexeme='{w}' AND h.pos >= s.pos)"
        for w in words
    )
    none = " OR ".join(
        f"(SELECT min(h.pos) FROM {hits} h WHERE h.id=s.id AND h.lexeme='{w}' AND h.pos >= s.pos) IS NULL"
        for w in words
    )
    last = f"greatest({ends})" if len(words) > 1 else ends
    return (
        f"SELECT id, x/(x+1) AS text_relevance FROM (SELECT id, sum(CAST(0.1 AS DOUBLE)/(1 + (q-p) - "
        f"((SELECT count(*) FROM {hits} h WHERE h.id=c.id AND h.lexeme IN {_in(words)} AND h.pos BETWEEN p AND q) - 1))) AS x "
        f"FROM (SELECT id, q, max(pos) AS p FROM (SELECT s.id, s.pos, CASE WHEN {none} THEN NULL ELSE {last} END AS q "
        f"FROM {hits} s WHERE s.lexeme IN {_in(words)}) WHERE q IS NOT NULL GROUP BY id, q) c GROUP BY id)"
    )


def _hits(words: list[str]) -> str:
    return f"hits AS MATERIALIZED (SELECT * FROM ({_TOKENS}) WHERE lexeme IN {_in(words)})"


COLUMNS = (
    "id", "filename", "extracted_text", "status", "created_at", "file_size", "search_vector",
    "client_canonical", "state", "date_created",
)


def _catalog(t: Tables, *extra: str):
    return t.catalog(*COLUMNS, *extra)


def _round(df, *names: str):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "R01_postings",
    f"SELECT id, lexeme, pos FROM ({_TOKENS}) WHERE lexeme NOT IN ({_STOPS})",
)
def postings(t: Tables):
    return s.postings(t.catalog("id", "filename", "extracted_text"), stem=False)


@query("R01_stemmed_postings")
def stemmed_postings(t: Tables):
    rows = s.postings(t.catalog("id", "filename", "extracted_text"))
    return rows.groupBy("lexeme").agg(F.count("*").alias("n"), F.countDistinct("id").alias("documents"))


@query(
    "R02_matching_documents",
    f"WITH {_hits(['over', 'tion', 'ing'])} SELECT id FROM hits WHERE lexeme IN ('tion','ing') GROUP BY id HAVING count(DISTINCT lexeme)=2",
)
def matching_documents(t: Tables):
    words = ["tion", "ing"]
    hits = s.hits_in_text(t.catalog("id", "filename", "extracted_text"), words, stem=False)
    return s.matching_documents(hits, words)


@query(
    "R03_cover_rank_one_word",
    f"WITH {_hits(['tion'])} SELECT id, round(0.1*count(*)/(0.1*count(*)+1), 6) AS text_relevance FROM hits GROUP BY id",
)
def cover_rank_one_word(t: Tables):
    hits = s.hits_in_text(t.catalog("id", "filename", "extracted_text"), ["tion"], stem=False)
    return _round(s.cover_rank(hits, ["tion"]), "text_relevance")


@query(
    "R03_cover_rank",
    f"WITH {_hits(['tion', 'ing', 'ed'])} SELECT id, round(text_relevance, 6) AS text_relevance FROM ({_rank(['tion', 'ing', 'ed'])})",
)
def cover_rank(t: Tables):
    words = ["tion", "ing", "ed"]
    hits = s.hits_in_text(t.catalog("id", "filename", "extracted_text"), words, stem=False)
    return _round(s.cover_rank(hits, words), "text_relevance")


@query(
    "R04_cosine",
    f"SELECT id, round({_cosine(1)}, 6) AS vector_relevance FROM catalog WHERE search_vector IS NOT NULL",
)
def cosine(t: Tables):
    scores = s.vector_scores(t.catalog("id", "search_vector"), request_vector(1))
    return _round(scores, "vector_relevance")


@query(
    "K01_vector_top_k",
    f"SELECT id, round(vector_relevance, 6) AS vector_relevance FROM ({_near(1, 400)})",
)
def vector_top_k(t: Tables):
    near = s.vector_top_k(t.catalog("id", "search_vector"), request_vector(1), 400)
    return _round(near, "vector_relevance")


_WORDS = ["tion", "ing"]
_SCORES = (
    f"SELECT coalesce(v.id, x.id) AS id, coalesce(vector_relevance,0)*CAST(0.7 AS DOUBLE) + coalesce(text_relevance,0)*CAST(0.3 AS DOUBLE) AS relevance "
    f"FROM ({_near(2)}) v FULL JOIN ({_rank(_WORDS)}) x ON v.id=x.id"
)


@query(
    "J01_combined_scores",
    f"WITH {_hits(_WORDS)} SELECT id, round(relevance, 6) AS relevance FROM ({_SCORES})",
)
def combined_scores(t: Tables):
    catalog = _catalog(t)
    near = s.vector_top_k(catalog, request_vector(2), 500)
    ranked = s.cover_rank(s.hits_in_text(catalog, _WORDS, stem=False), _WORDS)
    return _round(s.combine_scores(near, ranked), "relevance")


@query(
    "J02_documents_with_scores",
    f"WITH {_hits(_WORDS)} SELECT c.id, c.filename, round(r.relevance, 6) AS relevance FROM catalog c JOIN ({_SCORES}) r ON r.id=c.id WHERE r.relevance > 0",
)
def documents_with_scores(t: Tables):
    catalog = _catalog(t)
    near = s.vector_top_k(catalog, request_vector(2), 500)
    ranked = s.cover_rank(s.hits_in_text(catalog, _WORDS, stem=False), _WORDS)
    scored = s.with_scores(catalog.select("id", "filename"), s.combine_scores(near, ranked))
    return _round(scored, "relevance")


def _request(**more) -> s.SearchRequest:
    return s.SearchRequest(
        query="tion ing", query_vector=request_vector(2), stem=False, **more
    )


_MATCHES = f"SELECT c.*, r.relevance FROM catalog c JOIN ({_SCORES}) r ON r.id=c.id WHERE r.relevance > 0 AND c.status='COMPLETED'"


def _page_sql(matches: str, order: str, limit: int, offset: int = 0) -> str:
    return (
        f"SELECT id, round(relevance,6) AS relevance, round(CASE WHEN max(relevance) OVER () > 0 AND max(relevance) OVER () > min(relevance) OVER () "
        f"THEN (relevance - min(relevance) OVER ())/(max(relevance) OVER () - min(relevance) OVER ()) ELSE relevance END, 6) AS normalised "
        f"FROM (SELECT * FROM ({matches}) ORDER BY {order} LIMIT {limit} OFFSET {offset})"
    )


@query(
    "R05_hybrid_search",
    f"WITH {_hits(_WORDS)} {_page_sql(_MATCHES, 'relevance DESC, id', 20)}",
)
def hybrid_search(t: Tables):
    page = s.hybrid_search(_catalog(t), _request()).page
    return _round(page.select("id", "relevance", "normalised"), "relevance", "normalised")


@query(
    "R05_hybrid_search_filtered",
    f"WITH {_hits(_WORDS)} "
    + _page_sql(
        f"SELECT * FROM ({_MATCHES}) m WHERE trim(state)='OH' AND id IN (SELECT document_id FROM doc_terms JOIN taxonomy t ON t.id=taxonomy_term_id "
        f"WHERE t.primary_category='ECONOMY') AND id IN (SELECT id FROM {_STORED} WHERE verbatim_term ILIKE '%ring%' OR mapped_canonical_term ILIKE '%ring%')",
        "relevance DESC, id",
        10,
        0,
    ),
)
def hybrid_search_filtered(t: Tables):
    request = _request(
        page=1, per_page=10, state="OH", primary_category="ECONOMY", canonical_term="ring"
    )
    page = s.hybrid_search(_catalog(t, "keywords"), request, None, t.links(), t.taxonomy).page
    return _round(page.select("id", "relevance", "normalised"), "relevance", "normalised")


@query("R05_hybrid_search_stemmed")
def hybrid_search_stemmed(t: Tables):
    """Stemmed words; no SQL check because SQL has no stemmer."""
    request = s.SearchRequest(query="nations being", query_vector=request_vector(3))
    page = s.hybrid_search(_catalog(t), request).page
    return page.select("id", "relevance", "normalised", "relevance_text")


@query(
    "R06_filter_only_search",
    """SELECT id, CAST(created_at AS VARCHAR) AS created_at, CAST(0.0 AS DOUBLE) AS relevance, '0.00' AS relevance_text FROM catalog
    WHERE status='COMPLETED' AND trim(state)='TX' AND year(date_created)=2021 ORDER BY catalog.created_at DESC, id LIMIT 20""",
)
def filter_only_search(t: Tables):
    result = s.hybrid_search(_catalog(t), s.SearchRequest(state="TX", year=2021))
    return result.page.select("id", "created_at", "relevance", "relevance_text")


@query(
    "P10_verbatim_term_with_text",
    f"""WITH {_hits(_WORDS)} SELECT id, filename, CAST(created_at AS VARCHAR) AS created_at FROM catalog
    WHERE status='COMPLETED' AND id IN (SELECT id FROM {_STORED} WHERE verbatim_term ILIKE '%gizmo%')
    AND id IN (SELECT id FROM hits GROUP BY id HAVING count(DISTINCT lexeme)=2) ORDER BY catalog.created_at DESC, id LIMIT 20""",
)
def verbatim_term_with_text(t: Tables):
    catalog = t.catalog("id", "filename", "extracted_text", "status", "created_at", "keywords")
    matching = s.matching_documents(s.hits_in_text(catalog, _WORDS, stem=False), _WORDS)
    return f.verbatim_term_search(catalog, "gizmo", matching).select("id", "filename", "created_at")


@query(
    "P11_canonical_term_search",
    f"""SELECT id, CAST(created_at AS VARCHAR) AS created_at FROM catalog WHERE status='COMPLETED'
    AND id IN (SELECT id FROM {_STORED} WHERE mapped_canonical_term ILIKE '%small bolt%' OR verbatim_term ILIKE '%small bolt%')
    ORDER BY catalog.created_at DESC, id LIMIT 20""",
)
def canonical_term_search(t: Tables):
    catalog = t.catalog("id", "filename", "status", "created_at", "keywords", "extracted_text")
    request = s.SearchRequest(canonical_term="small bolt")
    return s.hybrid_search(catalog, request).page.select("id", "created_at")


_BATCH = {"a": (["tion", "ing"], 1), "b": (["ed"], 2), "c": (["ation"], 3)}


def _batch_sql() -> str:
    words = sorted({w for ws, _ in _BATCH.values() for w in ws})
    parts = []
    for name, (ws, seed) in _BATCH.items():
        vector = len(" ".join(ws)) >= 4
        near = f"SELECT * FROM ({_near(seed)})" if vector else "SELECT CAST(NULL AS BIGINT) AS id, CAST(0 AS DOUBLE) AS vector_relevance WHERE false"
        parts.append(
            f"SELECT '{name}' AS query_id, coalesce(v.id, x.id) AS id, coalesce(vector_relevance,0)*CAST(0.7 AS DOUBLE) + coalesce(text_relevance,0)*CAST(0.3 AS DOUBLE) AS relevance "
            f"FROM ({near}) v FULL JOIN ({_rank(ws)}) x ON v.id=x.id"
        )
    return (
        f"WITH {_hits(words)} SELECT query_id, rank, id, round(relevance, 6) AS relevance FROM (SELECT q.*, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, q.id) AS rank "
        f"FROM ({' UNION ALL '.join(parts)}) q JOIN catalog c ON c.id=q.id WHERE c.status='COMPLETED' AND relevance > 0) WHERE rank <= 20"
    )


@query("R07_batch_search", _batch_sql())
def batch_search(t: Tables):
    requests = {
        n: s.SearchRequest(query=" ".join(ws), query_vector=request_vector(seed), stem=False)
        for n, (ws, seed) in _BATCH.items()
    }
    return _round(s.batch_search(_catalog(t), requests), "relevance")


@query(
    "W01_total_beside_page",
    """SELECT id, count(*) OVER () AS total FROM catalog WHERE status='COMPLETED' AND trim(state)='CA' ORDER BY catalog.created_at DESC, id LIMIT 20""",
)
def total_beside_page(t: Tables):
    result = s.hybrid_search(_catalog(t), s.SearchRequest(state="CA"))
    return s.with_total(result.page.select("id"), result.matches)


@query(
    "W03_normalised_page",
    f"WITH {_hits(_WORDS)} {_page_sql(_MATCHES, 'relevance DESC, id', 15, 15)}",
)
def normalised_page(t: Tables):
    page = s.hybrid_search(_catalog(t), _request(page=2, per_page=15)).page
    return _round(page.select("id", "relevance", "normalised"), "relevance", "normalised")


@query(
    "K02_sort_by_column",
    f"WITH {_hits(_WORDS)} SELECT id, file_size, round(relevance,6) AS relevance FROM ({_MATCHES}) ORDER BY file_size ASC, id LIMIT 20",
)
def sort_by_column(t: Tables):
    page = s.hybrid_search(_catalog(t), _request(sort_by="file_size", descending=False)).page
    return _round(page.select("id", "file_size", "relevance"), "relevance")


@query(
    "K03_page_numbers",
    f"""SELECT CAST(2 AS BIGINT) AS page, CAST(15 AS BIGINT) AS per_page, total, CAST(ceil(total/15.0) AS BIGINT) AS pages, true AS has_prev,
    2 < ceil(total/15.0) AS has_next, CAST(1 AS BIGINT) AS prev_page, CASE WHEN 2 < ceil(total/15.0) THEN CAST(3 AS BIGINT) END AS next_page
    FROM (SELECT count(*) AS total FROM catalog WHERE status='COMPLETED' AND trim(state)='CA')""",
)
def page_numbers(t: Tables):
    request = s.SearchRequest(state="CA", page=2, per_page=15)
    return s.hybrid_search(_catalog(t), request).pagination()


@query(
    "M11_logged_queries",
    """SELECT id, CASE WHEN trim(q) = '' THEN '(filter only)' ELSE trim(q) END AS query, filter_client, filter_state,
    CAST(filter_date_year AS BIGINT) AS filter_date_year, CAST(result_count AS BIGINT) AS result_count, CAST(ts AS VARCHAR) AS timestamp
    FROM (SELECT *, CASE WHEN id%4=0 THEN '   ' WHEN id%4=1 THEN concat(' ',query) ELSE query END AS q, timestamp AS ts FROM search_queries)
    WHERE trim(q) <> '' OR filter_client IS NOT NULL OR filter_state IS NOT NULL OR filter_date_year IS NOT NULL""",
)
def logged_queries(t: Tables):
    n = F.col("id") % 4
    typed = (
        F.when(n == 0, "   ").when(n == 1, F.concat(F.lit(" "), "query")).otherwise(F.col("query"))
    )
    return s.log_entries(t.search_queries.withColumn("query", typed), AS_OF)
