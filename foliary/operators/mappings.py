"""Keyword mappings, taxonomy links, facets and taxonomy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions.text import blank_to_null, contains_term
from foliary.operators.common import frequency, lookup_join, top_k


def unnest_mappings(catalog: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """One row per mapping, with its position, beside chosen columns."""
    gen = F.posexplode_outer if outer else F.posexplode
    return catalog.select(
        F.col("id").alias("document_id"), *keep, gen("keywords.keyword_mappings").alias("pos", "m")
    ).select("document_id", *keep, "pos", "m.*")


# --- links to the taxonomy -------------------------------------------------


def link_terms(mappings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(document_id, taxonomy_term_id)`` for every taxonomy term that carries
    the name of a canonical term of the document."""
    ids = taxonomy.select(F.col("term").alias("name"), F.col("id").alias("taxonomy_term_id"))
    pairs = mappings.select(
        "document_id", F.col("mapped_canonical_term").alias("name")
    ).distinct()
    return lookup_join(pairs, ids, "name", "inner").select("document_id", "taxonomy_term_id")


def relink(links: DataFrame, mappings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Replace the links of all documents that occur in ``mappings``."""
    touched = mappings.select("document_id").distinct()
    kept = links.join(touched, "document_id", "left_anti")
    return kept.unionByName(link_terms(mappings, taxonomy))


def _first_of_each_term(taxonomy: DataFrame) -> DataFrame:
    """One hierarchy per term name, the alphabetically first."""
    place = F.struct("primary_category", "subcategory")
    return (
        taxonomy.groupBy("term")
        .agg(F.min(place).alias("place"))
        .select(
            "term",
            F.col("place.primary_category").alias("primary_category"),
            F.col("place.subcategory").alias("subcategory"),
        )
    )


def validate_mappings(mappings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Mappings whose canonical term exists, category and subcategory taken
    from the taxonomy."""
    known = _first_of_each_term(taxonomy).withColumnRenamed("term", "mapped_canonical_term")
    rows = mappings.select("document_id", "pos", "verbatim_term", "mapped_canonical_term")
    return lookup_join(rows, known, "mapped_canonical_term", "inner").select(
        "document_id",
        "pos",
        "verbatim_term",
        "mapped_canonical_term",
        F.col("primary_category").alias("mapped_primary_category"),
        F.col("subcategory").alias("mapped_subcategory"),
    )


def rejected_mappings(mappings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Mappings without canonical term or with an unknown one."""
    known = taxonomy.select(F.col("term").alias("mapped_canonical_term")).distinct()
    rows = mappings.select("document_id", "pos", "verbatim_term", "mapped_canonical_term")
    return lookup_join(rows, known, "mapped_canonical_term", "left_anti").select(
        "document_id", "pos", "verbatim_term", "mapped_canonical_term"
    )


def gather_mappings(mappings: DataFrame) -> DataFrame:
    """Back to one array per document, in position order."""
    fields = [
        "pos",
        "verbatim_term",
        "mapped_primary_category",
        "mapped_subcategory",
        "mapped_canonical_term",
    ]
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    return mappings.groupBy("document_id").agg(
        F.transform(ordered, lambda m: m.dropFields("pos")).alias("keyword_mappings")
    )


# --- facets ----------------------------------------------------------------


def documents_with_terms(links: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Document, link and term side by side."""
    terms = taxonomy.select(
        F.col("id").alias("taxonomy_term_id"), "primary_category", "subcategory", "term"
    )
    return lookup_join(links, terms, "taxonomy_term_id", "inner")


def _facet(links: DataFrame, taxonomy: DataFrame, field: str, distinct: bool) -> DataFrame:
    terms = taxonomy.select(F.col("id").alias("taxonomy_term_id"), F.col(field).alias("name"))
    if distinct:
        pairs = lookup_join(links, terms, "taxonomy_term_id", "inner")
        pairs = pairs.select("document_id", "name").distinct()
        return frequency(pairs, "name", "name")
    # count per term first: the join then sees one row per term
    per_term = links.groupBy("taxonomy_term_id").agg(F.count("*").alias("n"))
    return (
        per_term.join(terms, "taxonomy_term_id")
        .filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.sum("n").alias("count"))
    )


def category_facet(links: DataFrame, taxonomy: DataFrame, distinct: bool = False) -> DataFrame:
    """Links (or distinct documents) per primary category, any status."""
    return _facet(links, taxonomy, "primary_category", distinct)


def subcategory_facet(links: DataFrame, taxonomy: DataFrame, distinct: bool = False) -> DataFrame:
    return _facet(links, taxonomy, "subcategory", distinct)


def canonical_term_facet(catalog: DataFrame, limit: int = 20) -> DataFrame:
    """Most mapped canonical terms of completed documents."""
    done = catalog.filter(F.col("status") == "COMPLETED")
    terms = done.select(
        F.explode(
            F.transform("keywords.keyword_mappings", lambda m: m["mapped_canonical_term"])
        ).alias("name")
    )
    return top_k(frequency(terms, "name", "name"), limit, "count", "name")


def term_counts(catalog: DataFrame) -> DataFrame:
    """Mappings reduced to distinct combinations with counts: the small table
    all mapping statistics are read from."""
    return (
        catalog.select(F.explode("keywords.keyword_mappings").alias("m"))
        .groupBy("m.verbatim_term", "m.mapped_canonical_term", "m.mapped_primary_category")
        .agg(F.count("*").alias("n"))
    )


def mapping_statistics(catalog: DataFrame) -> DataFrame:
    """One row of totals.  Mappings of all documents are set against the
    completed documents that have keywords."""
    documents = catalog.agg(
        F.count_if((F.col("status") == "COMPLETED") & F.col("keywords").isNotNull())
    ).scalar()
    return (
        term_counts(catalog)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_keyword_mappings"),
            F.countDistinct("verbatim_term").alias("unique_verbatim_terms"),
            F.countDistinct("mapped_canonical_term").alias("unique_canonical_terms"),
        )
        .withColumn("total_documents_with_mappings", documents)
        .withColumn(
            "average_mappings_per_document",
            F.when(
                F.col("total_documents_with_mappings") > 0,
                F.col("total_keyword_mappings") / F.col("total_documents_with_mappings"),
            ).otherwise(0.0),
        )
    )


def top_canonical_terms(catalog: DataFrame, limit: int = 10) -> DataFrame:
    counted = (
        term_counts(catalog)
        .filter(F.col("mapped_canonical_term").isNotNull())
        .groupBy(F.col("mapped_canonical_term").alias("term"))
        .agg(F.sum("n").alias("count"))
    )
    return top_k(counted, limit, "count", "term")


def category_distribution(catalog: DataFrame) -> DataFrame:
    return (
        term_counts(catalog)
        .filter(F.col("mapped_primary_category").isNotNull())
        .groupBy(F.col("mapped_primary_category").alias("category"))
        .agg(F.sum("n").alias("count"))
    )


# --- taxonomy --------------------------------------------------------------


def matching_terms(taxonomy: DataFrame, text: str) -> DataFrame:
    """Terms that contain a text, with their full path."""
    return taxonomy.filter(contains_term(F.col("term"), text)).select(
        "id", "primary_category", "subcategory", "term", full_path().alias("full_path")
    )


def full_path() -> Column:
    return F.concat_ws(
        " > ", "primary_category", blank_to_null(F.col("subcategory")), "term"
    )


def terms_of_category(taxonomy: DataFrame, category: str) -> DataFrame:
    return taxonomy.filter(F.col("primary_category") == category).select(
        "id", "primary_category", "subcategory", "term"
    )


def term_hierarchy(taxonomy: DataFrame, term: str) -> DataFrame:
    """Hierarchy of one term name, the alphabetically first."""
    return _first_of_each_term(taxonomy.filter(F.col("term") == term))


def primary_categories(taxonomy: DataFrame) -> DataFrame:
    return frequency(taxonomy, "primary_category", "name")


def subcategories(taxonomy: DataFrame, category: str | None = None) -> DataFrame:
    """Subcategories with term counts, of one or of every category."""
    rows = taxonomy.filter(F.col("subcategory") != "")
    if category is not None:
        rows = rows.filter(F.col("primary_category") == category)
    return rows.groupBy("primary_category", F.col("subcategory").alias("name")).agg(
        F.count("*").alias("count")
    )


def taxonomy_statistics(taxonomy: DataFrame, synonyms: DataFrame) -> DataFrame:
    return taxonomy.agg(
        F.count("*").alias("total_terms"),
        F.countDistinct("primary_category").alias("total_categories"),
    ).withColumn("total_synonyms", synonyms.agg(F.count("*")).scalar())


def taxonomy_hierarchy(taxonomy: DataFrame) -> DataFrame:
    """One row per category and subcategory ("General" for none) with its
    sorted terms."""
    return (
        taxonomy.select(
            "primary_category",
            F.coalesce(blank_to_null(F.col("subcategory")), F.lit("General")).alias("subcategory"),
            "term",
        )
        .groupBy("primary_category", "subcategory")
        .agg(F.array_sort(F.collect_list("term")).alias("terms"))
    )


def terms_in_use(catalog: DataFrame) -> DataFrame:
    """Distinct canonical terms of completed documents."""
    return (
        catalog.filter(F.col("status") == "COMPLETED")
        .select(F.explode("keywords.keyword_mappings.mapped_canonical_term").alias("term"))
        .filter(F.col("term").isNotNull())
        .distinct()
    )


def orphan_terms(used: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Used terms the taxonomy does not know, under "Other"."""
    return used.join(taxonomy.select("term").distinct(), "term", "left_anti").select(
        F.lit("Other").alias("primary_category"), "term"
    )


def canonical_terms_by_category(used: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Used terms with their categories, orphans under "Other"; the whole
    taxonomy where no term is in use."""
    listed = taxonomy.select("primary_category", "term")
    known = listed.join(used, "term", "left_semi").select("primary_category", "term")
    whole = listed.filter(~used.exists())
    return known.unionByName(orphan_terms(used, taxonomy)).unionByName(whole)
