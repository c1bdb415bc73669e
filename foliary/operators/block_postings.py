"""Ranked retrieval that leaves out blocks which cannot reach the page.

Postings are stored as one row per lexeme and block of ``BLOCK_IDS`` document ids, sorted by both: the documents of the
block with their positions, and beside them, as a column of its own, the largest number of hits in one document.
A query reads these numbers first.  They bound what any document of a block can score:

* a shortest cover begins at a hit, and of the covers that contain a given hit no two begin with the same lexeme
  (else the longer one would not be shortest); so a document with ``h`` hits of its rarest of ``n`` lexemes has at most
  ``n * h`` covers, and never more covers than hits;
* a cover adds at most the cover weight.

The most promising ``FIRST_BLOCKS`` blocks are scored; the last score of the page they give is a threshold, and of
the other blocks only those are read whose bound reaches it.  The page equals that of the full
evaluation.  A total needs every match and is not part of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.functions.lexemes import query_lexemes
from foliary.operators import search as s

BLOCK_IDS = 4096
FIRST_BLOCKS = 16
DIGITS = 10  # scores that agree so far are equal


def block_of(id_col: str | Column = "id", ids: int = BLOCK_IDS) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.floor(c / F.lit(ids)).cast("long")


def blocks(postings: DataFrame, ids: int = BLOCK_IDS) -> DataFrame:
    """``lexeme, block, max_hits, documents`` of postings (``id, lexeme, pos``).

    Postings are dealt once, by ranges of lexeme and block: both groupings, and ``write_blocks``, take the rows from there."""
    placed = postings.withColumn("block", block_of(ids=ids)).repartitionByRange("lexeme", "block")
    documents = placed.groupBy("lexeme", "block", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    entry = F.struct("id", "positions")
    return documents.groupBy("lexeme", "block").agg(
        F.max(F.size("positions")).cast("long").alias("max_hits"), F.sort_array(F.collect_list(entry)).alias("documents")
    )


def write_blocks(rows: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """Store blocks sorted by lexeme and block, so that a frequent lexeme spans many files; ``mode="append"`` adds those of
    further documents.  Rows of ``blocks`` lie in such ranges already; with ``files`` they are dealt anew."""
    keys = ["lexeme", "block"]
    ranged = rows.repartitionByRange(files, *keys) if files else rows
    ranged.sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def bounded_blocks(index: DataFrame, lexemes: Sequence[str], weight: float = fv.COVER_WEIGHT) -> DataFrame:
    """``block, bound``: the blocks with every lexeme, and the most a document of theirs can score."""
    n = len(lexemes)
    headers = index.where(F.col("lexeme").isin(list(lexemes))).groupBy("block", "lexeme").agg(F.max("max_hits").alias("hits"))
    both = headers.groupBy("block").agg(F.min("hits").alias("least"), F.sum("hits").alias("all"), F.count("*").alias("n"))
    x = F.least(F.col("least") * n, F.col("all")) * F.lit(weight) if n > 1 else F.col("least") * F.lit(weight)
    return both.where(F.col("n") == n).select("block", (x / (x + 1)).alias("bound"))


def hits_in_blocks(index: DataFrame, lexemes: Sequence[str], chosen: DataFrame | list[int]) -> DataFrame:
    """``id, lexeme, pos`` of the chosen blocks."""
    rows = index.where(F.col("lexeme").isin(list(lexemes)))
    if isinstance(chosen, list):
        rows = rows.where(F.col("block").isin(chosen) if chosen else F.lit(False))
    else:
        rows = rows.join(chosen.select("block"), "block", "left_semi")
    each = rows.select("lexeme", F.explode("documents").alias("d"))
    return each.select(F.col("d.id").alias("id"), "lexeme", F.explode("d.positions").alias("pos"))


def promising(index: DataFrame, lexemes: Sequence[str], first_blocks: int = FIRST_BLOCKS) -> list[int]:
    """The first blocks to read (``first_blocks`` numbers come to the driver)."""
    best = bounded_blocks(index, lexemes).orderBy(F.desc("bound"), "block").limit(first_blocks)
    return [row["block"] for row in best.collect()]


def remaining(index: DataFrame, lexemes: Sequence[str], first: list[int], threshold: float | None, share: float = 1.0) -> DataFrame:
    """The other blocks whose bound, times ``share``, reaches the threshold (all of them without one)."""
    rest = bounded_blocks(index, lexemes).where(~F.col("block").isin(first) if first else F.lit(True))
    return rest if threshold is None else rest.where(F.col("bound") * share >= threshold - 10.0**-DIGITS)


def _falling(column: str) -> Column:
    """Equal scores may differ in their last bits, by the order in which covers were added up."""
    return F.round(column, DIGITS).desc()


def _kth(scores: DataFrame, column: str, k: int) -> float | None:
    """The k-th best value, None if there are fewer."""
    found = scores.orderBy(F.desc(column)).limit(k).agg(F.min(column).alias("least"), F.count("*").alias("n")).first()
    return found["least"] if found["n"] == k else None


def top_documents(index: DataFrame, lexemes: Sequence[str], k: int, allowed: DataFrame | None = None, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """``id, text_relevance`` of the first ``k`` documents with all lexemes, of those in ``allowed`` (``id``) if given."""

    def scored(chosen) -> DataFrame:
        ranked = s.cover_rank(hits_in_blocks(index, lexemes, chosen), lexemes)
        return ranked if allowed is None else ranked.join(allowed.select("id"), "id", "left_semi")

    first = promising(index, lexemes, first_blocks)
    ranked = scored(first)
    rest = remaining(index, lexemes, first, _kth(ranked, "text_relevance", k))
    return ranked.unionByName(scored(rest)).orderBy(_falling("text_relevance"), "id").limit(k)


def hybrid_page(
    catalog: DataFrame,
    request: s.SearchRequest,
    index: DataFrame,
    links: DataFrame | None = None,
    taxonomy: DataFrame | None = None,
    first_blocks: int = FIRST_BLOCKS,
    ids: int = BLOCK_IDS,
) -> DataFrame:
    """The requested page of a search by relevance, as ``hybrid_search`` gives it.

    Documents among the vector candidates are scored in full: their hits are read from their blocks.  All
    others have a text score only, for which the bounds hold.
    """
    text = request.query.strip()
    lexemes = query_lexemes(text, request.stem) if text else []
    if not lexemes or request.sort_by != "relevance":
        raise ValueError("pages by relevance of a query with a searchable word")
    matching = s.apply_filters(catalog, request, links, taxonomy)
    allowed = matching.select("id")
    wanted = request.page * request.per_page
    if request.query_vector is not None and len(text) >= fv.VECTOR_QUERY_MIN_CHARS:
        near = s.vector_top_k(catalog, request.query_vector, s.vector_candidates(request.per_page))
    else:
        near = catalog.select("id", F.lit(0.0).alias("vector_relevance")).limit(0)
    near_blocks = near.select(block_of(ids=ids).alias("block")).distinct()
    near_hits = hits_in_blocks(index, lexemes, near_blocks).join(near.select("id"), "id", "left_semi")
    near_text = near.select("id").join(s.cover_rank(near_hits, lexemes), "id")
    near_scores = s.combine_scores(near, near_text).join(allowed, "id", "left_semi")

    def text_only(chosen) -> DataFrame:
        ranked = s.cover_rank(hits_in_blocks(index, lexemes, chosen), lexemes).join(near.select("id"), "id", "left_anti")
        return s.combine_scores(None, ranked).join(allowed, "id", "left_semi")

    first = promising(index, lexemes, first_blocks)
    scores = near_scores.unionByName(text_only(first))
    rest = remaining(index, lexemes, first, _kth(scores.where("relevance > 0"), "relevance", wanted), fv.TEXT_WEIGHT)
    every = scores.unionByName(text_only(rest)).where("relevance > 0")
    best = every.orderBy(_falling("relevance"), "id").limit(wanted)
    shown = [c for c in s.filters.SEARCH_COLUMNS if c in catalog.columns]
    page = s.page_of(s.with_scores(matching.select(*shown), best), _falling("relevance"), request.page, request.per_page)
    return s.normalise_page(page)
