"""Payer line and candidate name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.functions.text import (
    bind,
    blank_to_null,
    first_match,
    squeeze,
    strip,
    text_list,
    title_case,
    word_count,
    words,
)


def remove(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Delete a pattern, then trim."""
    flags = "(?iU)" if ignore_case else "(?U)"
    return strip(F.regexp_replace(c, flags + pattern, ""))


def raw_payer(text: Column) -> Column:
    """What follows the first "paid for by", to the end of that line."""
    return blank_to_null(strip(F.regexp_extract(text, "(?iUd)" + fv.PAYER_LINE, 1)))


def is_franked(raw: Column) -> Column:
    """Official mail: one of the indicator phrases occurs."""
    found = F.lit(False)
    for phrase in fv.FRANK_PHRASES:
        found = found | F.lower(raw).contains(phrase)
    return F.coalesce(found, F.lit(False))


def without_person_tail(c: Column) -> Column:
    """Drop a trailing treasurer or agent."""
    for pattern, ignore_case in fv.PAYER_TAILS:
        c = remove(c, pattern, ignore_case)
    return c


def payer_name(raw: Column) -> Column:
    """Committee name from a payer line that is not franked."""
    for pattern, ignore_case in fv.PAYER_LINE_NOISE:
        raw = remove(raw, pattern, ignore_case)
    return without_person_tail(raw)


def committee_to_person(committee: Column) -> Column:
    """Bare candidate name inside a committee name; null for organisations."""
    name = remove(remove(strip(committee), fv.COMMITTEE_LEAD), fv.COMMITTEE_TAIL)

    def without_place(n):
        return bind(
            remove(n, fv.COMMITTEE_PLACE),
            lambda p: F.when(word_count(p) >= 2, p).otherwise(n),
        )

    name = remove(remove(bind(name, without_place), fv.COMMITTEE_PARTY), fv.COMMITTEE_YEAR)
    return bind(
        name,
        lambda n: F.when(
            ~n.rlike("(?iU)" + fv.ORGANISATION_WORDS) & (word_count(n) >= 2), n
        ),
    )


def named(name: Column, confidence: Column | str) -> Column:
    """``struct(name, confidence)``, null without a name."""
    if isinstance(confidence, str):
        confidence = F.lit(confidence)
    return bind(
        name,
        lambda n: F.when(n.isNotNull(), F.struct(n.alias("name"), confidence.alias("confidence"))),
    )


def voted_name(text: Column) -> Column:
    """Name in "Vote X" or "Elect X"."""
    return F.coalesce(
        *[title_case(strip(first_match(text, "(?U)" + p))) for p in fv.VOTE_FOR_NAME]
    )


def name_for_office(text: Column) -> Column:
    return strip(first_match(text, "(?U)" + fv.NAME_FOR_OFFICE))


def name_in_domain(text: Column) -> Column:
    return first_match(text, fv.NAME_IN_DOMAIN)


def capitals_phrases(text: Column) -> Column:
    """Phrases of two or three capitalised words that may be a name."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit("(?U)" + fv.CAPITALS_PHRASE), 1), squeeze
    )
    generic = text_list(fv.GENERIC_CAPITALS)
    return F.filter(
        found,
        lambda p: ~F.arrays_overlap(F.split(p, " "), generic)
        & ~p.rlike("(?iU)" + fv.ORGANISATION_WORDS),
    )


def frequent_phrase(text: Column, phrases: Column) -> Column:
    """``struct(name, confidence)`` of the phrase that occurs most often, with a
    bonus for an early start; null when that phrase holds a slogan word."""
    slogans = text_list(fv.SLOGAN_WORDS)

    def rank(phrase, i):
        count = F.size(F.filter(phrases, lambda q: q == phrase))
        position = F.instr(text, phrase) - 1
        return F.struct(
            (count + F.when(position < fv.EARLY_PHRASE_CHARS, 1).otherwise(0)).alias("score"),
            (-position).alias("earliness"),
            (-i).alias("order"),
            phrase.alias("phrase"),
            count.alias("count"),
        )

    def judged(best):
        confidence = F.when(best["count"] >= 2, "HIGH").otherwise("MEDIUM")
        return F.when(
            ~F.arrays_overlap(F.split(best["phrase"], " "), slogans),
            F.struct(title_case(best["phrase"]).alias("name"), confidence.alias("confidence")),
        )

    return bind(F.array_max(F.transform(F.array_distinct(phrases), rank)), judged)


def client_decision(
    text: Column, payer: Column, franked: Column, person: Column, body: Column
) -> Column:
    """``struct(client, confidence)`` from the payer name, the person inside it
    and the name found in the body."""
    first_name = F.lower(F.get(words(person), F.lit(0)))
    person_confidence = F.when(
        F.lower(text).contains(first_name), "HIGH"
    ).otherwise("MEDIUM")

    def pick(name, confidence):
        if isinstance(confidence, str):
            confidence = F.lit(confidence)
        return F.struct(name.alias("client"), confidence.alias("confidence"))

    return (
        F.when(franked, pick(body["name"], "LOW"))
        .when(person.isNotNull(), pick(person, person_confidence))
        .when(payer.isNotNull() & (word_count(payer) <= 4), pick(payer, "MEDIUM"))
        .when(body.isNotNull(), pick(body["name"], body["confidence"]))
        .when(payer.isNotNull(), pick(payer, "LOW"))
        .otherwise(
            F.struct(
                F.lit(None).cast("string").alias("client"),
                F.lit(None).cast("string").alias("confidence"),
            )
        )
    )
