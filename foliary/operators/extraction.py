"""Document fields from text: date, payer, client, state, review score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.functions import dates, payer, states


def extract_dates(docs: DataFrame) -> DataFrame:
    """Adds ``predicted_date`` and ``date_confidence``.

    The work is laid out in steps so that each expensive expression (all stamps,
    the text around them, the scores) is computed once per row.
    """
    text = F.col("extracted_text")
    found = docs.withColumn("_stamps", dates.date_candidates(text))
    # the surrounding pieces are cut only where there is a stamp at all
    pieces = F.when(F.size("_stamps") > 0, dates.text_between_candidates(text))
    scored = found.withColumn("_pieces", pieces).withColumn(
        "_scored",
        F.when(
            F.size("_stamps") > 0,
            dates.scored_candidates(text, F.col("_stamps"), F.col("_pieces")),
        ),
    )
    best = scored.withColumn("_best", dates.best_candidate(F.col("_scored")))
    return (
        best.withColumn("_date", dates.document_date(F.col("_best")))
        .withColumns({"predicted_date": F.col("_date.date"), "date_confidence": F.col("_date.confidence")})
        .drop("_stamps", "_pieces", "_scored", "_best", "_date")
    )


def date_candidates(docs: DataFrame) -> DataFrame:
    """One row per stamp: ``(id, position, stamp, score)``."""
    text = F.col("extracted_text")
    found = docs.withColumn("_stamps", dates.date_candidates(text)).filter(F.size("_stamps") > 0)
    scored = dates.scored_candidates(
        text, F.col("_stamps"), dates.text_between_candidates(text)
    )
    return found.select("id", F.inline(scored)).select("id", "position", "stamp", "score")


def extract_payers(docs: DataFrame) -> DataFrame:
    """Adds ``paid_for_by_raw`` and ``is_frank``."""
    return (
        docs.withColumn("_raw", payer.raw_payer(F.col("extracted_text")))
        .withColumn("is_frank", payer.is_franked(F.col("_raw")))
        .withColumn(
            "paid_for_by_raw",
            F.when(F.col("is_frank"), F.col("_raw")).otherwise(payer.payer_name(F.col("_raw"))),
        )
        .withColumn("paid_for_by_raw", F.nullif(F.col("paid_for_by_raw"), F.lit("")))
        .drop("_raw")
    )


def extract_clients(docs: DataFrame) -> DataFrame:
    """Adds the payer columns, ``predicted_candidate`` and its confidence."""
    text, raw = F.col("extracted_text"), F.col("paid_for_by_raw")
    with_payer = extract_payers(docs).withColumn(
        "_person", F.when(~F.col("is_frank"), payer.committee_to_person(raw))
    )
    # the body is searched only where the payer line does not settle the client
    settled = F.col("_person").isNotNull() | (
        ~F.col("is_frank") & raw.isNotNull() & (payer.word_count(raw) <= 4)
    )
    open_case = with_payer.withColumn("_open", ~F.coalesce(settled, F.lit(False)))
    decided = find_names(open_case, F.col("_open")).withColumn(
        "_client",
        payer.client_decision(text, raw, F.col("is_frank"), F.col("_person"), F.col("body_name")),
    )
    return decided.withColumns(
        {
            "predicted_candidate": F.col("_client.client"),
            "candidate_confidence": F.col("_client.confidence"),
        }
    ).drop("_person", "_open", "body_name", "_client")


def find_names(docs: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds ``body_name`` (``struct<name, confidence>``) from the document body,
    best signal first: "Vote X", a repeated phrase in capitals, "X for Office",
    a web address.  A step runs only for rows no earlier step has settled."""
    text = F.col("extracted_text")
    wanted = F.lit(True) if wanted is None else wanted
    steps = {
        "_voted": F.when(wanted, payer.named(payer.voted_name(text), "HIGH")),
        "_phrases": F.when(wanted & F.col("_voted").isNull(), payer.capitals_phrases(text)),
        "_frequent": F.when(
            F.size("_phrases") > 0, payer.frequent_phrase(text, F.col("_phrases"))
        ),
    }
    for name, step in steps.items():
        docs = docs.withColumn(name, step)
    rest = wanted & F.col("_voted").isNull() & F.col("_frequent").isNull()
    last = F.coalesce(
        payer.named(payer.name_for_office(text), "MEDIUM"),
        payer.named(payer.name_in_domain(text), "LOW"),
    )
    return docs.withColumn(
        "body_name", F.coalesce("_voted", "_frequent", F.when(rest, last))
    ).drop("_voted", "_phrases", "_frequent")


def extract_states(docs: DataFrame) -> DataFrame:
    """Adds ``predicted_state`` and ``state_confidence``, in tiers: marker or
    ZIP code, name in the address block or race context, most frequent name.
    A tier runs only for rows the tiers before it leave open."""
    text = F.col("extracted_text")
    high = F.coalesce("_marked", "_zip")
    named = F.size("_names") > 0
    steps = {
        "_marked": states.marked_state(text),
        "_block": F.when(F.col("_marked").isNull(), states.payer_block(text)),
        "_zip": states.zip_state(F.col("_block")),
        "_names": F.when(high.isNull(), states.spelled_states(text)),
        "_placed": F.when(named, states.state_in_block(F.col("_block"))),
        "_race": F.when(
            named & F.col("_placed").isNull(),
            states.first_listed_state(states.race_states(text)),
        ),
        "_often": F.when(
            named & F.coalesce("_placed", "_race").isNull(),
            states.most_frequent_state(F.col("_names")),
        ),
    }
    for name, step in steps.items():
        docs = docs.withColumn(name, step)
    medium = F.coalesce("_placed", "_race")
    confidence = (
        F.when(high.isNotNull(), "HIGH")
        .when(medium.isNotNull(), "MEDIUM")
        .when(F.col("_often").isNotNull(), "LOW")
    )
    return docs.withColumns(
        {
            "predicted_state": F.coalesce(high, medium, F.col("_often")),
            "state_confidence": confidence,
        }
    ).drop(*steps)


def review_score() -> Column:
    """Points of the three confidences."""
    columns = {"date": "date_confidence", "client": "candidate_confidence", "state": "state_confidence"}
    score = F.lit(0)
    for field, points in fv.REVIEW_POINTS.items():
        c = F.col(columns[field])
        own = F.lit(0)
        for level, value in points.items():
            own = F.when(c == level, value).otherwise(own)
        score = score + own
    return score


def needs_review() -> Column:
    """Client or state missing, or too few points."""
    missing = (F.coalesce("predicted_candidate", F.lit("")) == "") | (
        F.coalesce("predicted_state", F.lit("")) == ""
    )
    return missing | (review_score() < fv.REVIEW_THRESHOLD)


def extract_fields(docs: DataFrame) -> DataFrame:
    """All fields of all documents; one narrow pass without any shuffle."""
    filled = docs.withColumn("extracted_text", F.coalesce("extracted_text", F.lit("")))
    fields = extract_states(extract_clients(extract_dates(filled)))
    return fields.withColumn("needs_review", needs_review())
