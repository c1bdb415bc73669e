"""Reading the analysis JSON of a document.

The JSON comes in several shapes (flat, nested sections, older versions).  It
is parsed once into one wide struct; all other expressions read that struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.functions.text import blank_to_null, strip

MAPPING_TYPE = (
    "STRUCT<verbatim_term: STRING, mapped_primary_category: STRING, "
    "mapped_subcategory: STRING, mapped_canonical_term: STRING>"
)
MAPPINGS_TYPE = f"ARRAY<{MAPPING_TYPE}>"
_SECTION = (
    "STRUCT<summary: STRING, document_type: STRING, campaign_type: STRING, "
    "document_tone: STRING, election_year: STRING>"
)
ANALYSIS_TYPE = (
    "STRUCT<schema_version: INT, prompt_version: INT, summary: STRING, "
    "page_count: INT, analysis_type: STRING, error: STRING, raw_response: STRING, "
    "document_type: STRING, campaign_type: STRING, document_tone: STRING, "
    "title: STRING, content_analysis: STRING, "
    f"keyword_mappings: {MAPPINGS_TYPE}, document_analysis: {_SECTION}, "
    f"metadata: STRUCT<document_analysis: {_SECTION}>, "
    "classification: STRUCT<category: STRING, subcategory: STRING>, "
    "entities: STRUCT<client_name: STRING, opponent_name: STRING>, "
    "extracted_text: STRUCT<main_message: STRING, call_to_action: STRING>, "
    "design_elements: STRUCT<target_audience: STRING, campaign_name: STRING>, "
    "communication_focus: STRUCT<primary_issue: STRING, messaging_strategy: STRING>, "
    f"taxonomy_keywords: STRUCT<keyword_mappings: {MAPPINGS_TYPE}>, "
    "keywords: ARRAY<STRING>, key_topics: ARRAY<STRING>, categories: ARRAY<STRING>>"
)


def parse_analysis(json_text: Column) -> Column:
    """Typed analysis.  Fields of an unexpected type become null instead of
    failing the row; text that is not JSON gives a struct of nulls."""
    return F.from_json(json_text, ANALYSIS_TYPE, {"mode": "PERMISSIVE"})


def is_json(json_text: Column) -> Column:
    return F.try_parse_json(json_text).isNotNull()


def recover_json(response: Column) -> Column:
    """JSON text inside a model response: fenced block, else outermost braces.
    Null where neither parses."""
    fenced = blank_to_null(F.regexp_extract(response, r"(?s)```json\s*(.*?)\s*```", 1))
    braces = blank_to_null(F.regexp_extract(response, r"(?s)(\{.*\})", 1))
    candidate = F.coalesce(fenced, braces)
    return F.when(is_json(candidate), candidate)


def recovered_response(response: Column) -> Column:
    """``struct(json, raw_response)``; exactly one of the two is set."""
    found = recover_json(response)
    return F.struct(
        found.alias("json"),
        F.when(found.isNull(), response).alias("raw_response"),
    )


def summary_of(analysis: Column) -> Column:
    """Summary whatever the schema version: top level, else nested."""
    return F.coalesce(
        blank_to_null(analysis["summary"]), analysis["document_analysis"]["summary"]
    )


def upgrade_analysis(analysis: Column) -> Column:
    """Lift the nested summary of unversioned objects and stamp version 1."""
    old = F.coalesce(analysis["schema_version"], F.lit(0)) < 1
    lifted = F.when(old, summary_of(analysis)).otherwise(analysis["summary"])
    version = F.when(old, F.lit(1)).otherwise(analysis["schema_version"])
    return analysis.withField("summary", lifted).withField("schema_version", version)


def no_mappings() -> Column:
    return F.array().cast(MAPPINGS_TYPE)


def mappings_of(analysis: Column) -> Column:
    """Top-level mappings followed by those of the taxonomy section."""
    return F.concat(
        F.coalesce(analysis["keyword_mappings"], no_mappings()),
        F.coalesce(analysis["taxonomy_keywords"]["keyword_mappings"], no_mappings()),
    )


def _term_set(values: Column) -> Column:
    cleaned = F.transform(
        F.filter(values, lambda v: v.isNotNull() & (v != "")), lambda v: F.lower(strip(v))
    )
    return F.array_sort(F.array_distinct(cleaned))


def keyword_set(analysis: Column) -> Column:
    """Distinct lower-cased keywords from all places that may hold them."""
    mappings = mappings_of(analysis)
    doc = analysis["document_analysis"]
    singles = F.array(
        doc["summary"],
        doc["document_type"],
        doc["campaign_type"],
        doc["document_tone"],
        analysis["classification"]["subcategory"],
        analysis["entities"]["client_name"],
        analysis["entities"]["opponent_name"],
        analysis["communication_focus"]["primary_issue"],
    )
    none = F.array().cast("ARRAY<STRING>")
    return _term_set(
        F.concat(
            F.transform(mappings, lambda m: m["verbatim_term"]),
            F.transform(mappings, lambda m: m["mapped_canonical_term"]),
            singles,
            F.coalesce(analysis["keywords"], analysis["key_topics"], none),
        )
    )


def category_set(analysis: Column) -> Column:
    """Distinct lower-cased categories from all places that may hold them."""
    none = F.array().cast("ARRAY<STRING>")
    return _term_set(
        F.concat(
            F.transform(mappings_of(analysis), lambda m: m["mapped_primary_category"]),
            F.array(
                analysis["classification"]["category"],
                analysis["communication_focus"]["messaging_strategy"],
            ),
            F.coalesce(analysis["categories"], none),
        )
    )


def analysis_reject_reason(analysis: Column) -> Column:
    """Why an analysis is unusable, null when it is fine."""
    return (
        F.when(analysis["error"].isNotNull(), F.concat(F.lit("model error: "), analysis["error"]))
        .when(analysis["raw_response"].isNotNull(), "unparseable response")
        .when(analysis.isNull(), "no analysis")
    )


def normalise_analysis(analysis: Column, modular: bool = False) -> Column:
    """Fill ``document_analysis``.

    Page path: only when absent, from the top-level keys, with empty defaults.
    Modular path: always rebuilt from the metadata section, with the defaults
    that mark missing values.
    """
    doc = analysis["document_analysis"]
    if modular:
        source = analysis["metadata"]["document_analysis"]
        defaults = {
            "summary": "No summary available",
            "document_type": "unknown",
            "campaign_type": "unknown",
            "document_tone": "neutral",
        }
        build = analysis["metadata"].isNotNull() & analysis["classification"].isNotNull()
    else:
        source = analysis
        defaults = dict.fromkeys(
            ["summary", "document_type", "campaign_type", "document_tone"], ""
        )
        build = doc.isNull()
    built = F.struct(
        *[F.coalesce(source[k], F.lit(v)).alias(k) for k, v in defaults.items()],
        F.lit(None).cast("string").alias("election_year"),
    )
    return analysis.withField("document_analysis", F.when(build, built).otherwise(doc))


# --- keyword accessors -----------------------------------------------------


def terms_of(mappings: Column, field: str) -> Column:
    """Non-empty values of one mapping field, in order."""
    return F.filter(
        F.transform(mappings, lambda m: m[field]), lambda t: t.isNotNull() & (t != "")
    )


def verbatim_terms(mappings: Column) -> Column:
    return terms_of(mappings, "verbatim_term")


def canonical_terms(mappings: Column) -> Column:
    return terms_of(mappings, "mapped_canonical_term")


def search_content(filename: Column, text: Column, analysis: Column, keywords: Column) -> Column:
    """Distinct sorted union of all searchable parts, joined by blanks."""
    none = F.array().cast("ARRAY<STRING>")
    mappings = F.coalesce(keywords["keyword_mappings"], no_mappings())
    parts = F.concat(
        F.array(
            filename,
            text,
            analysis["summary"],
            analysis["content_analysis"],
            analysis["title"],
        ),
        F.coalesce(keywords["keywords"], none),
        F.coalesce(keywords["categories"], none),
        F.transform(mappings, lambda m: m["verbatim_term"]),
    )
    kept = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


# --- text to embed ---------------------------------------------------------


def embedding_parts(
    analysis: Column,
    client: Column,
    client_confidence: Column,
    state: Column,
    state_confidence: Column,
) -> Column:
    """Ordered ``array<struct<label, value, source, confidence>>`` of the fields
    that enter the embedding text.  Client and state count only at trusted
    confidence."""

    def trusted(value, confidence):
        return F.coalesce(
            (value != "") & F.upper(confidence).isin(fv.TRUSTED_CONFIDENCE), F.lit(False)
        )

    doc = analysis["document_analysis"]
    entities = analysis["entities"]
    issue = blank_to_null(analysis["communication_focus"]["primary_issue"])
    terms = F.array_distinct(canonical_terms(F.coalesce(analysis["keyword_mappings"], no_mappings())))
    issues = F.when(issue.isNull() | F.array_contains(terms, issue), terms).otherwise(
        F.concat(F.array(issue), terms)
    )
    client_ok = trusted(client, client_confidence)
    state_ok = trusted(state, state_confidence)

    def part(label, value, source, confidence=None):
        return F.struct(
            F.lit(label).alias("label"),
            blank_to_null(value).alias("value"),
            (F.lit(source) if isinstance(source, str) else source).alias("source"),
            (F.lit(None) if confidence is None else confidence)
            .cast("string")
            .alias("confidence"),
        )

    read, listed = "llm_extraction", "llm_controlled_vocab"
    parts = F.array(
        part("SUMMARY", F.coalesce(blank_to_null(doc["summary"]), analysis["summary"]), read),
        part("MAIN_MESSAGE", analysis["extracted_text"]["main_message"], read),
        part("CALL_TO_ACTION", analysis["extracted_text"]["call_to_action"], read),
        part("ISSUES", F.array_join(issues, ", "), "taxonomy_mapping"),
        part("CATEGORY", analysis["classification"]["category"], listed),
        part("SUBCATEGORY", analysis["classification"]["subcategory"], listed),
        part("DOCUMENT_TYPE", doc["document_type"], listed),
        part("CAMPAIGN_TYPE", doc["campaign_type"], listed),
        part("TONE", doc["document_tone"], listed),
        part("TARGET_AUDIENCE", analysis["design_elements"]["target_audience"], read),
        part(
            "CLIENT",
            F.when(client_ok, client).otherwise(entities["client_name"]),
            F.when(client_ok, "canonical_pipeline").otherwise(read),
            F.when(client_ok, client_confidence),
        ),
        part("OPPONENT", entities["opponent_name"], read),
        part("CAMPAIGN", analysis["design_elements"]["campaign_name"], read),
        part(
            "STATE",
            F.when(state_ok, state),
            "canonical_pipeline",
            F.when(state_ok, state_confidence),
        ),
        part("ELECTION_YEAR", doc["election_year"], listed),
    )
    return F.filter(parts, lambda p: p["value"].isNotNull())


def embedding_text(parts: Column, filename: Column) -> Column:
    """Labelled lines; the file name when there is no usable field."""
    lines = F.transform(parts, lambda p: F.concat(p["label"], F.lit(": "), p["value"]))
    return F.when(F.size(parts) > 0, F.array_join(lines, "\n")).otherwise(filename)


def embedding_provenance(parts: Column) -> Column:
    """``map<label, struct<value, source, confidence>>``."""
    return F.map_from_entries(
        F.transform(
            parts,
            lambda p: F.struct(
                p["label"], F.struct(p["value"], p["source"], p["confidence"])
            ),
        )
    )
