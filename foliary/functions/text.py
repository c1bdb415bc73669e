"""General text expressions: trimming, title case, OCR clean-up, file names."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary import fixed_values as fv


def text_list(values) -> Column:
    """Literal array of strings (none of them with a bar)."""
    return F.split(F.lit("|".join(values)), r"\|")


def bind(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once however often ``use`` mentions it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return bind(c, lambda x: F.when(x != "", x))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def squeeze(c: Column) -> Column:
    """One blank for each run of white space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def words(c: Column) -> Column:
    """Split on white space; no empty entries."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def contains_term(c: Column, term: str, wildcards: bool = False) -> Column:
    """Case-insensitive substring test.  ``%`` and ``_`` in the term are taken
    literally unless ``wildcards`` is set."""
    if not wildcards:
        term = term.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return c.ilike(f"%{term}%")


def title_case(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest:
    ``o'brien`` -> ``O'Brien``, ``97th`` -> ``97Th``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(
                F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2)))
            ),
        ),
        "",
    )


def repair_compound_names(c: Column) -> Column:
    """``Mcdonald`` -> ``McDonald``: upper-case the letter after Mc, Mac, O'."""
    cut = F.regexp_replace(c, fv.COMPOUND_PREFIX, "$1\u0001$2")
    pieces = F.split(cut, "\u0001")
    fixed = F.transform(
        pieces,
        lambda p, i: F.when(i == 0, p).otherwise(
            F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
        ),
    )
    return F.array_join(fixed, "")


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def clean_ocr_text(c: Column) -> Column:
    """Decode entities, drop emphasis and heading marks, squeeze blanks."""
    # only texts with an ampersand need the trip to Python
    c = F.when(c.contains("&"), unescape_html(c)).otherwise(c)
    for pattern in (
        r"(?s)\*\*(.+?)\*\*",
        r"(?s)__(.+?)__",
        r"(?s)\*(.+?)\*",
        r"(?sU)(?<!\w)_(.+?)_(?!\w)",
    ):
        c = F.regexp_replace(c, pattern, "$1")
    c = F.regexp_replace(c, r"(?mU)^#{1,6}\s+", "")
    c = F.regexp_replace(c, "[ \\t\u00a0]{2,}", " ")
    return strip(c)


# --- file names ------------------------------------------------------------


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    """Lower-cased extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(base_name(c), r"(?s)[^.].*?(\.[^.]+)$", 1))


def safe_file_name(c: Column) -> Column:
    """Base name with forbidden tokens replaced; null where nothing is left."""
    c = base_name(c)
    for token in fv.FORBIDDEN_NAME_TOKENS:
        c = F.replace(c, F.lit(token), F.lit("_"))
    return F.when(strip(c) != "", c)


def file_type(name: Column) -> Column:
    ext = extension(name)
    kind = F.lit("unknown")
    for label, extensions in fv.FILE_TYPES.items():
        kind = F.when(ext.isin(extensions), label).otherwise(kind)
    return kind


def preview_path(file_path: Column) -> Column:
    stem = F.regexp_replace(base_name(file_path), r"(?<=.)\.[^.]*$", "")
    return F.when(
        file_path != "", F.concat(F.lit("/previews/"), stem, F.lit("_preview.png"))
    )


def download_path(doc_id: Column, file_path: Column) -> Column:
    return F.when(
        doc_id.isNotNull() & (file_path != ""),
        F.concat(F.lit("/api/documents/"), doc_id.cast("string"), F.lit("/download")),
    )


# --- query text ------------------------------------------------------------


def query_keywords(query: Column) -> Column:
    """Lower-cased words without stop words; order and repeats are kept."""
    return F.filter(words(F.lower(query)), lambda w: ~w.isin(fv.QUERY_STOP_WORDS))


def query_label(query: Column) -> Column:
    """Text stored in the query log."""
    return F.coalesce(blank_to_null(strip(query)), F.lit(fv.FILTER_ONLY_LABEL))


def query_reject_reason(query: Column) -> Column:
    """Why a query is refused, null when it is accepted."""
    upper = F.upper(query)
    blocked = F.lit(False)
    for token in fv.QUERY_BLOCK_LIST:
        blocked = blocked | upper.contains(token.upper())
    return F.when(blocked, "invalid characters").when(
        F.length(query) > fv.MAX_QUERY_CHARS, "too long"
    )
