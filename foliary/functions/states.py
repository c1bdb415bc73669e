"""State of a document, in five tiers of falling certainty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.functions.text import bind, first_match, text_list

_NAMES = "|".join(sorted(fv.STATE_ABBREVIATIONS, key=len, reverse=True))
_SPELLED = rf"(?iU)\b({_NAMES})\b"
_FOR_STATE = rf"(?iU)\bfor\s+({_NAMES})\b"
_STATE_OFFICE = rf"(?iU)\b({_NAMES})\s+(?:{fv.RACE_OFFICES})\b"


def _grouped_by_initial() -> str:
    """The lower-cased names as one alternation per first letter, so that most
    words of a text fail after one comparison."""
    by_initial: dict[str, list[str]] = {}
    for name in sorted(fv.STATE_ABBREVIATIONS, key=len, reverse=True):
        by_initial.setdefault(name[0].lower(), []).append(name[1:].lower())
    groups = "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(by_initial.items()))
    word = r"[\p{L}\p{N}_]"
    return rf"(?<!{word})(?=[{''.join(sorted(by_initial))}])({groups})(?!{word})"


_SPELLED_LOWER = _grouped_by_initial()
_ANY_MARKER = "|".join(f"(?:{p})" for p, _ in fv.STATE_MARKERS)


def _abbreviation_map() -> Column:
    pairs = ",".join(f"{n.lower()}:{a}" for n, a in fv.STATE_ABBREVIATIONS.items())
    return F.str_to_map(F.lit(pairs))


def _state_rows() -> Column:
    """Literal ``array<struct<name, abbreviation, place>>`` in list order."""
    return F.zip_with(
        text_list(n.lower() for n in fv.STATE_ABBREVIATIONS),
        F.transform(
            text_list(fv.STATE_ABBREVIATIONS.values()),
            lambda a, i: F.struct(a.alias("abbreviation"), (-i).alias("place")),
        ),
        lambda n, a: F.struct(
            n.alias("name"), a["abbreviation"].alias("abbreviation"), a["place"].alias("place")
        ),
    )


def state_of_name(name: Column) -> Column:
    """Abbreviation of a state name in any case."""
    return F.try_element_at(_abbreviation_map(), F.lower(name))


def payer_block(text: Column) -> Column:
    """The address block: from "paid for by" to the first blank line when that
    is at a plausible distance, else a fixed length; the whole text when there
    is no payer line."""
    floor, limit = fv.ADDRESS_BLOCK["floor"], fv.ADDRESS_BLOCK["limit"]

    def cut(after):
        to_blank = F.length(F.get(F.split(after, r"(?U)\n\s*\n", 2), F.lit(0)))
        near = (to_blank < F.length(after)) & (to_blank > floor) & (to_blank < limit)
        return F.substr(after, F.lit(1), F.when(near, to_blank).otherwise(limit))

    return F.coalesce(bind(first_match(text, r"(?isU)(paid\s+for\s+by.*)"), cut), text)


def _with_contained_names(names: Column) -> Column:
    """"West Virginia" also counts as a mention of "Virginia"."""
    return bind(
        names,
        lambda found: F.concat(
            found,
            F.transform(
                F.filter(found, lambda n: n == "west virginia"), lambda n: F.lit("virginia")
            ),
        ),
    )


def spelled_states(text: Column) -> Column:
    """Every spelled-out state name in the text, lower-cased."""
    return _with_contained_names(
        F.regexp_extract_all(F.lower(text), F.lit(_SPELLED_LOWER), 1)
    )


def race_states(text: Column) -> Column:
    """State names in "for X" or "X senate"."""
    offices = F.transform(F.regexp_extract_all(text, F.lit(_STATE_OFFICE), 1), F.lower)
    return F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(_FOR_STATE), 1), F.lower),
        _with_contained_names(offices),
    )


def first_listed_state(names: Column) -> Column:
    """The mentioned state that comes first in the list of states."""
    hits = F.filter(_state_rows(), lambda s: F.array_contains(names, s["name"]))
    return F.get(hits, F.lit(0))["abbreviation"]


def most_frequent_state(names: Column, at_least: int = 2) -> Column:
    """Most mentioned state, list order on ties; null below ``at_least``."""
    counted = F.transform(
        _state_rows(),
        lambda s: F.struct(
            F.size(F.filter(names, lambda n: n == s["name"])).alias("mentions"),
            s["place"].alias("place"),
            s["abbreviation"].alias("abbreviation"),
        ),
    )
    best = bind(
        F.array_max(counted),
        lambda b: F.when(b["mentions"] >= at_least, b["abbreviation"]),
    )
    return F.when(F.size(names) >= at_least, best)


def marked_state(text: Column) -> Column:
    """State implied by a marker, the first marker of the list that occurs."""
    state = F.lit(None).cast("string")
    for pattern, abbreviation in reversed(fv.STATE_MARKERS):
        state = F.when(text.rlike("(?U)" + pattern), abbreviation).otherwise(state)
    # one scan tells whether any marker occurs
    return F.when(text.rlike("(?U)" + _ANY_MARKER), state)


def zip_state(block: Column) -> Column:
    """State code in front of a ZIP code."""
    return first_match(block, r"(?U),\s*([A-Z]{2})\s+\d{5}")


def state_in_block(block: Column) -> Column:
    """First state name spelled out in the address block."""
    return state_of_name(first_match(block, _SPELLED))
