"""Client names: clean-up, canonical rules, names found by the model, merging."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary import fixed_values as fv
from foliary.functions.payer import remove
from foliary.functions.text import (
    bind,
    blank_to_null,
    first_match,
    repair_compound_names,
    squeeze,
    strip,
    text_list,
    title_case,
    word_count,
    words,
)

_STATES = "|".join(sorted(fv.STATE_ABBREVIATIONS, key=len, reverse=True))


# --- clean-up --------------------------------------------------------------


def clean_client(raw: Column) -> Column:
    """Canonical spelling of a raw client; null for failed extractions."""
    s = squeeze(strip(raw))
    s = F.regexp_replace(s, r"(?U)[^\p{L}\p{N}_\s&.,'\-()/#@]", "")
    s = strip(squeeze(s))
    s = remove(s, r"[,\.\-:\s]+$")
    s = remove(s, r"^the\s+")
    garbage = "(?iU)" + "|".join(f"(?:{p})" for p in fv.GARBAGE_PATTERNS)
    return bind(
        title_case(s),
        lambda c: F.when(
            (word_count(c) >= fv.MIN_CLIENT_TOKENS)
            & ~F.upper(c).isin(fv.GARBAGE_NAMES)
            & ~raw.rlike(garbage),
            c,
        ),
    )


def comparison_form(name: Column) -> Column:
    """Lower case, no leading "the", no punctuation, single blanks."""
    n = strip(F.lower(name))
    n = F.regexp_replace(n, r"(?U)^the\s+", "")
    n = F.regexp_replace(n, r"(?U)[^\p{L}\p{N}_\s]", "")
    return strip(squeeze(n))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words; 0 when either side has none."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    shared = F.size(F.array_intersect(x, y))
    total = F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), shared / total).otherwise(F.lit(0.0))


# --- canonical rules -------------------------------------------------------


def _party_of(state: Column) -> Column:
    return F.concat(title_case(state), F.lit(" Republican Party"))


def party_rule(name: Column) -> Column:
    """"<State> Republican Party" for its usual spellings, else null."""
    forms = [
        rf"^(?:(?:the\s+)?Republican\s+Party\s+Of\s+)?({_STATES})\s+Republican\s+Party$",
        rf"^Republican\s+Party\s+Of\s+({_STATES})$",
        rf"^({_STATES})n\s+Republican\s+Party$",
        rf"^({_STATES})\s+G\.?O\.?P\.?$",
        rf"^(?:The\s+)?({_STATES})\s+Republican$",
    ]
    state = F.coalesce(*[first_match(name, "(?iU)" + f) for f in forms])
    code = F.upper(first_match(name, r"(?iU)^Republican\s+Party\s+Of\s+([A-Z]{2})$"))
    by_code = F.str_to_map(
        F.lit(",".join(f"{a}:{n}" for n, a in fv.STATE_ABBREVIATIONS.items()))
    )
    return F.coalesce(_party_of(state), _party_of(F.try_element_at(by_code, code)))


def party_rule_at_merge(name: Column) -> Column:
    """The party rule of the merge step.  It drops a final "n" of the state
    before looking it up, so states ending in "n" are not recognised."""
    forms = [
        rf"^(?:(?:the\s+)?Republican\s+Party\s+Of\s+)?({_STATES})\s+Republican\s+Party$",
        rf"^Republican\s+Party\s+Of\s+({_STATES})$",
        rf"^({_STATES})n?\s+Republican\s+Party$",
        rf"^({_STATES})\s+G\.?O\.?P\.?$",
        rf"^(?:The\s+)?({_STATES})\s+Republican$",
    ]
    state = F.coalesce(*[first_match(name, "(?iU)" + f) for f in forms])
    state = title_case(F.regexp_replace(strip(state), "(?i)n$", ""))
    known = [n.title() for n in fv.STATE_ABBREVIATIONS]
    return bind(
        state, lambda s: F.when(s.isin(known), F.concat(s, F.lit(" Republican Party")))
    )


def _if_changed(new: Column, old: Column) -> Column:
    return bind(new, lambda n: F.when((n != "") & (F.lower(n) != F.lower(old)), n))


def office_rule(name: Column) -> Column:
    """Name without its office or campaign ending, null when there is none."""
    return _if_changed(remove(remove(name, fv.NAME_OFFICE_TAIL), fv.NAME_CAMPAIGN_TAIL), name)


def committee_rule(name: Column) -> Column:
    """Committee without a trailing person, null when there is none."""
    return _if_changed(remove(name, fv.COMMITTEE_PERSON_TAIL), name)


def canonical_rules(name: Column) -> Column:
    return F.coalesce(party_rule(name), office_rule(name), committee_rule(name))


def resolved(name: Column, override: Column) -> Column:
    """``struct(client_canonical, resolution_source)``: override, then rules,
    then the name itself."""
    present = name != ""

    def labelled(rule):
        return F.struct(
            F.when(present, F.coalesce(override, rule, name)).alias("client_canonical"),
            F.when(~present | name.isNull(), F.lit(None))
            .when(override.isNotNull(), "manual")
            .when(rule.isNotNull(), "rule")
            .otherwise("passthrough")
            .alias("resolution_source"),
        )

    return bind(F.when(override.isNull(), canonical_rules(name)), labelled)


# --- names from the analysis -----------------------------------------------


def clean_found_name(raw: Column) -> Column:
    """Strip quotes, title and office, stop at a connector word, title case."""
    name = strip(squeeze(raw))
    name = remove(name, r"['\"]+$")
    name = remove(name, fv.TITLE_PREFIX)
    name = remove(name, fv.SUMMARY_OFFICE_TAIL)

    def until_connector(tokens):
        stops = F.transform(
            tokens, lambda w, i: F.when(F.lower(w).isin(fv.NAME_END_WORDS), i)
        )
        cut = F.coalesce(F.array_min(stops), F.size(tokens))
        return F.array_join(F.slice(tokens, F.lit(1), cut), " ")

    name = bind(words(name), until_connector)
    return title_case(remove(name, r"[,\.\-:]+$"))


def name_from_mappings(mappings: Column) -> Column:
    """Most frequent exact candidate name that is not also an opponent's; the
    first seen wins ties."""

    def picked(keep):
        kept = F.filter(
            mappings,
            lambda m: (m["mapped_primary_category"] == fv.MAPPING_CATEGORY)
            & keep(m)
            & (word_count(strip(m["verbatim_term"])) >= 2),
        )
        return F.transform(kept, lambda m: clean_found_name(strip(m["verbatim_term"])))

    opponents = F.transform(
        picked(lambda m: m["mapped_subcategory"] == fv.MAPPING_OPPONENT), F.lower
    )
    exact = picked(
        lambda m: (m["mapped_subcategory"] == fv.MAPPING_CANDIDATE)
        & (m["mapped_canonical_term"] == fv.MAPPING_NAME_TERM)
    )
    candidates = bind(
        opponents,
        lambda o: F.filter(exact, lambda c: ~F.array_contains(o, F.lower(c))),
    )

    def most_frequent(found):
        return F.array_max(
            F.transform(
                F.array_distinct(found),
                lambda c, i: F.struct(
                    F.size(F.filter(found, lambda d: d == c)).alias("count"),
                    (-i).alias("order"),
                    c.alias("name"),
                ),
            )
        )["name"]

    return bind(candidates, most_frequent)


def _first_usable(summary: Column, patterns, tier: str, rejected: list[str]) -> Column:
    """Name of the first pattern that gives at least two words and none of the
    rejected ones."""
    matches = F.array(
        *[
            F.struct(
                first_match(summary, "(?iU)" + pattern).alias("text"),
                F.lit(confidence).alias("confidence"),
            )
            for pattern, confidence in patterns
        ]
    )
    cleaned = F.transform(
        F.filter(matches, lambda m: m["text"].isNotNull()),
        lambda m: F.struct(
            clean_found_name(m["text"]).alias("client_from_ai"),
            m["confidence"].alias("ai_confidence"),
            F.lit(tier).alias("source_tier"),
        ),
    )

    def usable(name):
        ok = word_count(name) >= 2
        if rejected:
            bad = text_list(rejected)
            ok = ok & ~F.arrays_overlap(words(F.lower(name)), bad)
        return ok

    return F.get(F.filter(cleaned, lambda c: usable(c["client_from_ai"])), F.lit(0))


def name_from_analysis(
    mappings: Column, summary: Column, broken: Column | None = None, attack: bool = True
) -> Column:
    """``struct(client_from_ai, ai_confidence, source_tier)``.

    ``attack=False`` leaves out the third tier, as the one-document path does.
    """
    nothing = F.lit(None).cast("string")
    last = F.lit("no_match") if broken is None else F.when(broken, "parse_error").otherwise("no_match")

    def found(name, confidence, tier):
        return F.struct(
            name.alias("client_from_ai"),
            confidence.alias("ai_confidence"),
            tier.alias("source_tier"),
        )

    exact = bind(
        # a name that cleans to nothing is no name
        F.nullif(name_from_mappings(mappings), F.lit("")),
        lambda n: F.when(n.isNotNull(), found(n, F.lit("HIGH"), F.lit("tier1_keyword"))),
    )
    tiers = [
        exact,
        _first_usable(summary, fv.SUMMARY_PATTERNS, "tier2_summary", fv.SUMMARY_REJECT_WORDS),
    ]
    if attack:
        patterns = [(p, "MEDIUM") for p in fv.ATTACK_PATTERNS]
        tiers.append(_first_usable(summary, patterns, "tier3_attack", []))
    return F.coalesce(*tiers, found(nothing, nothing, last))


# --- merging ---------------------------------------------------------------


def clean_ai_name(raw: Column) -> Column:
    """Name found by the model under the spelling rules of clean names."""
    name = remove(squeeze(raw), r"^the\s+")
    for pattern in (fv.TITLE_PREFIX, fv.MERGE_OFFICE_TAIL, r"[,\.\-:]+$"):
        name = remove(name, pattern)
    name = repair_compound_names(title_case(name))
    return bind(
        name,
        lambda n: F.coalesce(
            party_rule_at_merge(n),
            F.when((F.length(n) >= 3) & ~F.lower(n).isin(fv.AI_NAME_STOP_WORDS), n),
        ),
    )


def clean_fallback_name(name: Column) -> Column:
    """Party rule, else compound-name repair, for already cleaned names."""
    bare = remove(name, r"^the\s+")
    return F.coalesce(party_rule_at_merge(bare), repair_compound_names(bare))


@F.pandas_udf(T.DoubleType())
def string_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by longest matching blocks, ignoring case."""
    return pd.Series(
        [
            SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0
            for x, y in zip(a, b)
        ],
        dtype="float64",
    )


def merged(clean: Column, ai: Column, confidence: Column, tier: Column, agree: Column | None = None) -> Column:
    """``struct(client_canonical, canonical_source)``.  ``agree`` is the string
    ratio of both names where the agreement boost applies."""
    clean, ai = blank_to_null(clean), blank_to_null(ai)
    has_clean, has_ai = clean.isNotNull(), ai.isNotNull()
    label = F.concat(F.lit("ai_"), F.coalesce(tier, F.lit("")))

    def pick(name, source):
        return F.struct(name.alias("client_canonical"), source.alias("canonical_source"))

    ladder = F
    if agree is not None:
        ladder = F.when(
            has_clean & has_ai & (agree > fv.AGREEMENT_RATIO),
            pick(clean, F.lit("agreement_boost")),
        )
    return (
        ladder.when(has_ai & (confidence == "HIGH"), pick(ai, label))
        .when(
            has_ai & (confidence == "MEDIUM") & ~has_clean,
            pick(ai, F.concat(label, F.lit("_medium"))),
        )
        .when(
            has_clean & has_ai & (confidence == "MEDIUM"),
            pick(clean, F.lit("clean_v1_over_ai_medium")),
        )
        .when(has_clean, pick(clean, F.lit("clean_v1_fallback")))
        .when(has_ai, pick(ai, F.concat(label, F.lit("_last_resort"))))
        .otherwise(pick(F.lit(None).cast("string"), F.lit("null")))
    )
