"""Full-text and vector search, hybrid ranking, pages.

Two ways lead to the word hits of a query: scanning the catalog text, or
reading a stored postings table (one row per document, lexeme and position),
which is written sorted by lexeme so that the lexeme filter prunes files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.functions.lexemes import lexeme_positions, may_contain, query_lexemes
from foliary.functions.text import query_label
from foliary.functions.vectors import cosine_similarity
from foliary.operators import filters

# --- postings --------------------------------------------------------------


def searchable_text() -> Column:
    return F.concat_ws(" ", "filename", "extracted_text")


def posting_lists(stem: bool = True) -> Column:
    """``array<struct<lexeme, pos>>`` of a document, over file name and text."""
    return lexeme_positions(searchable_text(), stem)


def postings(catalog: DataFrame, stem: bool = True) -> DataFrame:
    """``(id, lexeme, pos)`` over file name and text."""
    return catalog.select("id", F.explode(posting_lists(stem)).alias("p")).select("id", "p.lexeme", "p.pos")


def write_postings(index: DataFrame, path: str, files: int | None = None) -> None:
    """Store postings range-partitioned and sorted by lexeme: a query reads only
    the row groups whose lexeme range holds its words.  The document id is part
    of the range key, so a very common lexeme spans many files."""
    keys = ["lexeme", "id"]
    ranged = index.repartitionByRange(files, *keys) if files else index.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys, "pos").write.mode("overwrite").parquet(path)


def hits_in_text(catalog: DataFrame, lexemes: Sequence[str], stem: bool = True) -> DataFrame:
    """Word hits found by scanning the text.  Positions are matched inside the
    row; only the hits are exploded."""
    wanted = list(lexemes)
    likely = catalog.filter(may_contain(searchable_text(), wanted, stem))
    found = lexeme_positions(searchable_text(), stem, wanted)
    return likely.select("id", F.explode(found).alias("p")).select("id", "p.lexeme", "p.pos")


def hits_in_postings(index: DataFrame, lexemes: Sequence[str]) -> DataFrame:
    return index.filter(F.col("lexeme").isin(list(lexemes)))


# --- text ranking ----------------------------------------------------------


def matching_documents(hits: DataFrame, lexemes: Sequence[str]) -> DataFrame:
    """Documents that hold every lexeme of the query."""
    return (
        hits.groupBy("id")
        .agg(*[F.max(F.when(F.col("lexeme") == x, 1).otherwise(0)).alias(f"_{i}") for i, x in enumerate(lexemes)])
        .filter(" AND ".join(f"_{i} = 1" for i in range(len(lexemes))))
        .select("id")
    )


def word_slots(hits: DataFrame, queries: dict[str, list[str]]) -> DataFrame:
    """Hits beside the queries that hold their lexeme: ``(query_id, id, pos,
    slot, words)``, ``slot`` being the place of the lexeme in its query.  The
    queries come from the caller and travel as one literal map."""
    by_lexeme: dict[str, list[dict]] = {}
    for name, lexemes in queries.items():
        for slot, lexeme in enumerate(lexemes):
            entry = {"query_id": name, "slot": slot, "words": len(lexemes)}
            by_lexeme.setdefault(lexeme, []).append(entry)
    table = F.from_json(
        F.lit(json.dumps(by_lexeme)),
        "map<string, array<struct<query_id: string, slot: int, words: int>>>",
    )
    return hits.select("id", "pos", F.inline(F.try_element_at(table, F.col("lexeme"))))


def cover_ranks(slots: DataFrame, widest: int, weight: float = fv.COVER_WEIGHT) -> DataFrame:
    """``(query_id, id, text_relevance)`` by cover density for the documents
    with all lexemes of a query of at most ``widest`` words.

    A cover is a shortest run of positions that holds every lexeme.  It adds
    ``weight / (1 + foreign words inside)``; the sum ``x`` becomes
    ``x / (x + 1)``.  For each hit the nearest following hit of every lexeme is
    carried by a window; the farthest of them ends the cover.
    """
    keys = ["query_id", "id"]

    def squashed(total):
        return (total / (total + 1)).alias("text_relevance")

    if widest == 1:
        return slots.groupBy(*keys).agg(squashed(F.count("*") * F.lit(weight)))
    forward = Window.partitionBy(*keys).orderBy("pos", "slot")
    # from the last hit back to here: a running value, where a frame that ends
    # with the partition would be read again for each row
    onward = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("pos"), F.desc("slot"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    here = F.struct("pos", "ord")
    following = [f"_n{i}" for i in range(widest)]
    ends = slots.withColumn("ord", F.row_number().over(forward)).withColumns(
        {
            name: F.last(F.when(F.col("slot") == i, here), ignorenulls=True).over(onward)
            for i, name in enumerate(following)
        }
    )
    found = sum((F.col(n).isNotNull().cast("int") for n in following), F.lit(0))
    # of all starts with the same end only the last one is shortest
    covers = (
        ends.filter(found == F.col("words"))
        .groupBy(*keys, F.greatest(*following).alias("last"))
        .agg(F.max(here).alias("first"))
    )
    span = F.col("last.pos") - F.col("first.pos")
    inside = F.col("last.ord") - F.col("first.ord")
    return covers.groupBy(*keys).agg(squashed(F.sum(F.lit(weight) / (1 + span - inside))))


def cover_rank(hits: DataFrame, lexemes: Sequence[str], weight: float = fv.COVER_WEIGHT) -> DataFrame:
    """``(id, text_relevance)`` of one query; see :func:`cover_ranks`."""
    slots = word_slots(hits, {"": list(lexemes)})
    return cover_ranks(slots, len(lexemes), weight).drop("query_id")


# --- vector ranking --------------------------------------------------------


def vector_candidates(per_page: int) -> int:
    return max(fv.MIN_VECTOR_CANDIDATES, fv.CANDIDATES_PER_PAGE_ROW * per_page)


def vector_scores(catalog: DataFrame, query_vector: Sequence[float]) -> DataFrame:
    """Cosine similarity of every document that has a vector."""
    return catalog.filter(F.col("search_vector").isNotNull()).select(
        "id", cosine_similarity(F.col("search_vector"), query_vector).alias("vector_relevance")
    )


def vector_top_k(catalog: DataFrame, query_vector: Sequence[float], k: int) -> DataFrame:
    """The ``k`` nearest documents; each task keeps only its own best ``k``."""
    return (
        vector_scores(catalog, query_vector)
        .orderBy(F.col("vector_relevance").desc(), "id")
        .limit(k)
    )


def vector_top_k_batch(
    catalog: DataFrame, queries: dict[str, Sequence[float]], k: int
) -> DataFrame:
    """``(query_id, id, vector_relevance)``: the ``k`` nearest documents of each
    of a set of request vectors, in one scan.

    The request vectors come from the caller and travel with the task; every
    task multiplies its Arrow batches with them and hands on at most ``k`` rows
    per query, so the final ranking sees a bounded number of rows per task.
    """
    names = list(queries)
    matrix = np.array([queries[n] for n in names], dtype=np.float64)
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in names]
        for pdf in batches:
            if pdf.empty:
                continue
            vectors = np.vstack(pdf["search_vector"].to_numpy()).astype(np.float64)
            lengths = np.linalg.norm(vectors, axis=1)
            ids = pdf["id"].to_numpy(dtype=np.int64)
            usable = lengths > 0
            scores = (vectors[usable] / lengths[usable, None]) @ matrix.T
            ids = ids[usable]
            for j in range(len(names)):
                all_scores = np.concatenate([kept[j][0], scores[:, j]])
                all_ids = np.concatenate([kept[j][1], ids])
                order = np.lexsort((all_ids, -all_scores))[:k]
                kept[j] = (all_scores[order], all_ids[order])
        for name, (s, i) in zip(names, kept):
            if len(i):
                yield pd.DataFrame({"query_id": name, "id": i, "vector_relevance": s})

    partial = (
        catalog.filter(F.col("search_vector").isNotNull())
        .select("id", "search_vector")
        .mapInPandas(best, "query_id string, id long, vector_relevance double")
    )
    rank = Window.partitionBy("query_id").orderBy(F.col("vector_relevance").desc(), "id")
    return partial.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


# --- hybrid search ---------------------------------------------------------


def combine_scores(vector: DataFrame | None, text: DataFrame) -> DataFrame:
    """``(id, relevance)``: weighted sum over the union of both hit lists."""
    if vector is None:
        return text.select("id", (F.col("text_relevance") * fv.TEXT_WEIGHT).alias("relevance"))
    zero = F.lit(0.0)
    return vector.join(text, "id", "full_outer").select(
        "id",
        (
            F.coalesce("vector_relevance", zero) * fv.VECTOR_WEIGHT
            + F.coalesce("text_relevance", zero) * fv.TEXT_WEIGHT
        ).alias("relevance"),
    )


def with_scores(catalog: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents with a positive relevance."""
    return catalog.join(scores.filter(F.col("relevance") > 0), "id")


@dataclass
class SearchRequest:
    """Arguments of one search."""

    query: str = ""
    query_vector: Sequence[float] | None = None
    page: int = 1
    per_page: int = 20
    primary_category: str | None = None
    subcategory: str | None = None
    canonical_term: str | None = None
    client: str | None = None
    state: str | None = None
    year: int | None = None
    sort_by: str = "relevance"
    descending: bool = True
    stem: bool = True


@dataclass
class SearchResult:
    """Lazy frames of one search."""

    matches: DataFrame  # every match with its relevance
    page: DataFrame  # the requested page, normalised
    total: DataFrame  # one row: total
    request: SearchRequest = field(repr=False)

    def pagination(self) -> DataFrame:
        return page_numbers(self.total, self.request.page, self.request.per_page)


def page_numbers(total: DataFrame, page: int, per_page: int) -> DataFrame:
    """Page count and neighbours from the true total."""
    n = F.col("total")
    pages = F.ceil(n / per_page).cast("long") if per_page > 0 else F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    return total.select(
        F.lit(page).cast("long").alias("page"),
        F.lit(per_page).cast("long").alias("per_page"),
        n,
        pages.alias("pages"),
        F.lit(page > 1).alias("has_prev"),
        (F.lit(page) < pages).alias("has_next"),
        (F.lit(page - 1).cast("long") if page > 1 else none).alias("prev_page"),
        F.when(F.lit(page) < pages, F.lit(page + 1).cast("long")).alias("next_page"),
    )


def sort_key(columns: Sequence[str], sort_by: str, descending: bool, ranked: bool) -> Column:
    """Relevance, always falling, where there is a query; else the chosen
    column, ``created_at`` for an unknown one."""
    if sort_by == "relevance" and ranked:
        return F.col("relevance").desc()
    name = sort_by if sort_by != "relevance" and sort_by in columns else "created_at"
    return F.col(name).desc() if descending else F.col(name).asc()


def page_of(df: DataFrame, order: Column, page: int, per_page: int) -> DataFrame:
    return df.orderBy(order, "id").offset((page - 1) * per_page).limit(per_page)


def normalise_page(page: DataFrame) -> DataFrame:
    """Min-max normalise relevance inside one page (at most ``per_page`` rows);
    unchanged where all are equal or none is positive."""
    whole = Window.partitionBy()
    low, high = F.min("relevance").over(whole), F.max("relevance").over(whole)
    spread = page.withColumns({"_low": low, "_high": high})
    normal = F.when(
        (F.col("_high") > 0) & (F.col("_high") > F.col("_low")),
        (F.col("relevance") - F.col("_low")) / (F.col("_high") - F.col("_low")),
    ).otherwise(F.col("relevance"))
    return (
        spread.withColumn("normalised", normal)
        .withColumn("relevance_text", F.format_string("%.2f", "normalised"))
        .drop("_low", "_high")
    )


def total_of(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("total"))


def with_total(page: DataFrame, matches: DataFrame) -> DataFrame:
    """Total number of matches beside each row of a page."""
    return page.withColumn("total", total_of(matches).scalar())


def apply_filters(
    catalog: DataFrame,
    request: SearchRequest,
    links: DataFrame | None = None,
    taxonomy: DataFrame | None = None,
) -> DataFrame:
    """Completed documents under the request's filters."""
    df = catalog.filter(F.col("status") == "COMPLETED")
    df = filters.exact_filters(df, request.client, request.state, request.year)
    if request.canonical_term:
        df = filters.canonical_term_filter(df, request.canonical_term)
    if request.primary_category or request.subcategory:
        df = filters.taxonomy_filter(
            df, links, taxonomy, request.primary_category, request.subcategory
        )
    return df


def hybrid_search(
    catalog: DataFrame,
    request: SearchRequest,
    index: DataFrame | None = None,
    links: DataFrame | None = None,
    taxonomy: DataFrame | None = None,
) -> SearchResult:
    """Vector and full-text search with filters, sorting and paging.

    The candidate limit of the vector part comes before the filters.  ``index``
    is a stored postings table; without it the text is scanned.
    """
    text = request.query.strip()
    scores = None
    if text:
        lexemes = query_lexemes(text, request.stem)
        vector = None
        if request.query_vector is not None and len(text) >= fv.VECTOR_QUERY_MIN_CHARS:
            vector = vector_top_k(catalog, request.query_vector, vector_candidates(request.per_page))
        if not lexemes:
            ranked = catalog.select("id", F.lit(0.0).alias("text_relevance")).limit(0)
        else:
            hits = (
                hits_in_text(catalog, lexemes, request.stem)
                if index is None
                else hits_in_postings(index, lexemes)
            )
            ranked = cover_rank(hits, lexemes)
        scores = combine_scores(vector, ranked)
    shown = [c for c in filters.SEARCH_COLUMNS if c in catalog.columns]
    matches = apply_filters(catalog, request, links, taxonomy).select(*shown)
    if scores is None:
        matches = matches.withColumn("relevance", F.lit(0.0))
    else:
        matches = with_scores(matches, scores)
    order = sort_key(matches.columns, request.sort_by, request.descending, scores is not None)
    page = page_of(matches, order, request.page, request.per_page)
    return SearchResult(matches, normalise_page(page), total_of(matches), request)


def batch_search(
    catalog: DataFrame,
    requests: dict[str, SearchRequest],
    index: DataFrame | None = None,
    top: int = 20,
) -> DataFrame:
    """Many searches in one job: ``(query_id, rank, id, relevance)``.

    One scan scores all request vectors and one scan (or index read) finds the
    words of all queries; ranking runs per query.
    """
    texts = {n: r.query.strip() for n, r in requests.items() if r.query.strip()}
    stem = all(r.stem for r in requests.values())
    lexemes = {n: query_lexemes(t, stem) for n, t in texts.items()}
    lexemes = {n: v for n, v in lexemes.items() if v}
    vectors = {
        n: requests[n].query_vector
        for n, t in texts.items()
        if requests[n].query_vector is not None and len(t) >= fv.VECTOR_QUERY_MIN_CHARS
    }
    if not lexemes:
        raise ValueError("no query holds a searchable word")
    wanted = sorted({x for v in lexemes.values() for x in v})
    hits = hits_in_text(catalog, wanted, stem) if index is None else hits_in_postings(index, wanted)
    slots = word_slots(hits, lexemes)
    text_scores = cover_ranks(slots, max(len(v) for v in lexemes.values()))
    zero = F.lit(0.0)
    vector_part = F.lit(0.0)
    scores = text_scores
    if vectors:
        near = vector_top_k_batch(catalog, vectors, vector_candidates(top)).drop("rank")
        scores = near.join(text_scores, ["query_id", "id"], "full_outer")
        vector_part = F.coalesce("vector_relevance", zero) * fv.VECTOR_WEIGHT
    scores = scores.select(
        "query_id",
        "id",
        (vector_part + F.coalesce("text_relevance", zero) * fv.TEXT_WEIGHT).alias("relevance"),
    ).filter(F.col("relevance") > 0)
    done = catalog.filter(F.col("status") == "COMPLETED").select("id")
    rank = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "id")
    return (
        scores.join(done, "id")
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "id", "relevance")
    )


# --- query log -------------------------------------------------------------


def log_entries(requests: DataFrame, as_of) -> DataFrame:
    """Log rows of the searches that have a text or any filter."""
    from foliary.operators.common import moment

    filtered = (
        F.col("filter_client").isNotNull()
        | F.col("filter_state").isNotNull()
        | F.col("filter_date_year").isNotNull()
    )
    has_text = F.trim(F.coalesce("query", F.lit(""))) != ""
    return requests.filter(has_text | filtered).withColumns(
        {
            "query": query_label(F.coalesce("query", F.lit(""))),
            "timestamp": F.coalesce(F.col("timestamp").cast("timestamp"), moment(as_of)),
        }
    )
