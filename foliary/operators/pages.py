"""Pages of a document rolled up to the document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES_PER_PART = 500


def text_parts(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """``(document_id, part, text, summaries)``: page texts under page headers,
    in order, in parts of a bounded number of pages.  No task ever gathers more
    than ``pages_per_part`` pages, however long a document is."""
    part = F.floor((F.col("page_num") - 1) / pages_per_part).cast("int")
    body = F.concat(
        F.lit("--- Page "), F.col("page_num").cast("string"), F.lit(" ---\n"), F.col("text")
    )
    rows = pages.select(
        "document_id",
        part.alias("part"),
        F.struct("page_num", body.alias("body"), "summary").alias("page"),
    )
    ordered = F.array_sort(F.collect_list("page"))
    return (
        rows.groupBy("document_id", "part")
        .agg(ordered.alias("pages"))
        .select(
            "document_id",
            "part",
            F.array_join(F.transform("pages", lambda p: p["body"]), "\n\n").alias("text"),
            F.array_join(
                F.transform(
                    F.filter("pages", lambda p: p["summary"] != ""), lambda p: p["summary"]
                ),
                "\n",
            ).alias("summary"),
        )
    )


def page_totals(pages: DataFrame) -> DataFrame:
    """Token sums, last page and first provider of each document; combines
    before the shuffle."""
    return pages.groupBy("document_id").agg(
        F.max("page_num").alias("page_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.min_by("provider", F.when(F.col("provider").isNotNull(), F.col("page_num"))).alias(
            "provider"
        ),
    )


def page_keywords(pages: DataFrame, column: str = "keyword") -> DataFrame:
    """Distinct keywords of each document, one row each."""
    return pages.select("document_id", column).filter(F.col(column) != "").distinct()


def resumed(pages: DataFrame) -> DataFrame:
    """Pages after the checkpoint of their document."""
    return pages.filter(F.col("page_num") > F.coalesce("checkpoint", F.lit(0)))


def roll_up(
    pages: DataFrame, resume_only: bool = False, pages_per_part: int = PAGES_PER_PART
) -> DataFrame:
    """One row per document: text, summary, keywords, counts.

    Only pages after the checkpoint are counted as processed; their text is
    added to that of the earlier pages, or stands alone with ``resume_only``.
    The text is joined from bounded parts; where a document is too long for one
    value, use :func:`text_parts`.
    """
    fresh = resumed(pages)
    texts = text_parts(fresh if resume_only else pages, pages_per_part)

    def joined(name, gap):
        parts = F.array_sort(F.collect_list(F.struct("part", name)))
        return F.array_join(
            F.transform(
                F.filter(parts, lambda p: p[name] != ""), lambda p: p[name]
            ),
            gap,
        ).alias(name)

    whole = texts.groupBy("document_id").agg(joined("text", "\n\n"), joined("summary", "\n"))
    keywords = (
        page_keywords(fresh)
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))
    )
    return (
        whole.join(page_totals(fresh).drop("page_count"), "document_id", "left")
        .join(pages.groupBy("document_id").agg(F.max("page_num").alias("page_count")), "document_id")
        .join(keywords, "document_id", "left")
        .withColumns(
            {
                "input_tokens": F.coalesce("input_tokens", F.lit(0)),
                "output_tokens": F.coalesce("output_tokens", F.lit(0)),
                "extracted_text": F.col("text"),
            }
        )
        .drop("text")
    )
