"""Document date: find the printed time stamps, score each by its context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary import fixed_values as fv

_STAMP = "(?iU)" + fv.DATE_STAMP


def date_candidates(text: Column) -> Column:
    """All time stamps in the text, in order."""
    return F.regexp_extract_all(text, F.lit(_STAMP), 0)


def text_between_candidates(text: Column) -> Column:
    """The pieces of text around the stamps; piece ``i`` precedes stamp ``i``,
    so positions follow from the lengths of pieces and stamps."""
    return F.split(text, _STAMP, -1)


def _score(text: Column, start: Column, stamp: Column) -> Column:
    """Score of a stamp that begins ``start`` characters into the text."""
    width = F.least(start, F.lit(fv.DATE_CONTEXT_CHARS))
    before = F.substr(text, start - width + 1, width)
    # characters from the end of the preceding context
    tail = F.right(before, F.lit(fv.DATE_CITATION_CHARS))
    date_part = F.regexp_extract(stamp, r"^(\S+)", 1)
    occurrences = (F.length(text) - F.length(F.replace(text, date_part, F.lit("")))) / F.length(
        date_part
    )

    def points(condition, value):
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    return (
        points(before.rlike(r"(?i)\.indd"), 3)
        + points(stamp.rlike(r"\d{1,2}:\d{2}"), 2)
        + points(stamp.rlike(r"(?i)[AP]M"), 1)
        + points(occurrences > 1, 1)
        + points(before.rlike("(?iU)" + fv.DATE_CONNECTOR), -2)
        + points(tail.rlike("(?iU)" + fv.DATE_CITATION), -2)
    )


def scored_candidates(text: Column, stamps: Column, pieces: Column) -> Column:
    """``array<struct<score, position, stamp>>`` in order of appearance."""
    nothing = F.array().cast("ARRAY<STRUCT<score: INT, position: INT, stamp: STRING>>")
    start = F.struct(F.lit(0).alias("offset"), nothing.alias("found"))

    def step(acc, pair):
        position = acc["offset"] + F.length(pair["piece"])
        found = F.struct(
            _score(text, position, pair["stamp"]).alias("score"),
            position.alias("position"),
            pair["stamp"].alias("stamp"),
        )
        return F.struct(
            (position + F.length(pair["stamp"])).alias("offset"),
            F.concat(acc["found"], F.array(found)).alias("found"),
        )

    pairs = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(stamps)),
        stamps,
        lambda p, s: F.struct(p.alias("piece"), s.alias("stamp")),
    )
    return F.aggregate(pairs, start, step, lambda acc: acc["found"])


def best_candidate(scored: Column) -> Column:
    """Highest score; the earliest one on ties."""
    ranked = F.transform(
        scored,
        lambda c: F.struct(
            c["score"].alias("score"), (-c["position"]).alias("earliness"), c["stamp"].alias("stamp")
        ),
    )
    return F.array_max(ranked)


def parse_stamp_date(stamp: Column) -> Column:
    """Date of a stamp: month first, day first where the first number cannot be
    a month; two-digit years fall in the usual window around today."""
    a = F.regexp_extract(stamp, r"^(\d+)/(\d+)/(\d+)", 1).cast("int")
    b = F.regexp_extract(stamp, r"^(\d+)/(\d+)/(\d+)", 2).cast("int")
    year_text = F.regexp_extract(stamp, r"^(\d+)/(\d+)/(\d+)", 3)
    year = F.when(
        F.length(year_text) <= 2,
        # 00-75 -> 20xx, 76-99 -> 19xx
        F.when(year_text.cast("int") <= 75, year_text.cast("int") + 2000).otherwise(
            year_text.cast("int") + 1900
        ),
    ).otherwise(year_text.cast("int"))
    swapped = a > 12
    month = F.when(swapped, b).otherwise(a)
    day = F.when(swapped, a).otherwise(b)
    clock_ok = stamp.rlike(
        r"\s(?:(?:0?\d|1[0-2]):[0-5]\d(?::[0-5]\d)?\s*(?i:[AP]M)"
        r"|(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?)$"
    )
    return F.when(
        clock_ok,
        F.try_to_timestamp(
            F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")
        ).cast("date"),
    )


def document_date(best: Column) -> Column:
    """``struct(date, confidence)`` from the best candidate."""
    score = best["score"]
    parsed = parse_stamp_date(best["stamp"])
    date = F.when(score > 0, parsed)
    confidence = (
        F.when(best.isNull(), F.lit(None))
        .when((score <= 0) | parsed.isNull(), "LOW")
        .when(score >= 3, "HIGH")
        .otherwise("MEDIUM")
    )
    return F.struct(date.alias("date"), confidence.alias("confidence"))


def year_is_valid(date: Column) -> Column:
    return F.year(date).between(*fv.VALID_YEARS)


def checked_date(date: Column) -> Column:
    """``struct(date, needs_date_review)``: out-of-range dates are dropped and
    flagged."""
    bad = F.coalesce(~year_is_valid(date), F.lit(False))
    return F.struct(
        F.when(~bad, date).alias("date_created"), bad.alias("needs_date_review")
    )
