"""CSV and table edges: taxonomy, predictions, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.text import blank_to_null, strip

TAXONOMY_COLUMNS = ["primary_category", "subcategory", "term"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, every column as text, quotes doubled, values over
    several lines allowed."""
    return spark.read.csv(
        path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"'
    )


# --- taxonomy --------------------------------------------------------------


def clean_taxonomy_rows(raw: DataFrame) -> DataFrame:
    """Trimmed rows, empty subcategory as null, ``valid`` flag."""
    trimmed = raw.select(*[strip(F.coalesce(c, F.lit(""))).alias(c) for c in TAXONOMY_COLUMNS])
    valid = (F.col("primary_category") != "") & (F.col("term") != "")
    return trimmed.withColumn("subcategory", blank_to_null(F.col("subcategory"))).withColumn(
        "valid", valid
    )


def new_taxonomy_terms(raw: DataFrame, existing: DataFrame) -> DataFrame:
    """Valid triples the taxonomy does not have yet, each once."""
    fresh = clean_taxonomy_rows(raw).filter("valid").drop("valid").dropDuplicates()
    known = existing.select(*TAXONOMY_COLUMNS).alias("k")
    fresh = fresh.alias("f")
    same = (
        (F.col("f.term") == F.col("k.term"))
        & (F.col("f.primary_category") == F.col("k.primary_category"))
        & F.col("f.subcategory").eqNullSafe(F.col("k.subcategory"))
    )
    return fresh.join(known, same, "left_anti")


def taxonomy_load_report(raw: DataFrame, created: DataFrame) -> DataFrame:
    """Created and rejected row counts."""
    errors = clean_taxonomy_rows(raw).agg(F.count_if(~F.col("valid"))).scalar()
    return created.agg(F.count("*").alias("created")).withColumn("errors", errors)


# --- predictions -----------------------------------------------------------


def text_or_null(c: Column) -> Column:
    c = strip(c)
    return F.when(~c.isin("", "None", "NULL"), c)


def text_to_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("true", "1", "yes"), F.lit(False))


def text_to_date(c: Column) -> Column:
    """Date in one of the usual notations, else null."""
    c = text_or_null(c)
    patterns = ["yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy"]
    tried = [F.try_to_timestamp(c, F.lit(p)) for p in patterns]
    return F.coalesce(*tried, F.try_to_timestamp(c)).cast("date")


def typed_predictions(raw: DataFrame) -> DataFrame:
    """Typed rows of a prediction CSV."""
    text = [
        "date_confidence", "client", "client_confidence", "paid_for_by_raw", "state",
        "state_confidence",
    ]
    return raw.select(
        F.col("id").cast("long").alias("id"),
        text_to_date(F.col("date_created")).alias("date_created"),
        *[text_or_null(F.col(c)).alias(c) for c in text],
        text_to_boolean(F.col("is_frank")).alias("is_frank"),
        text_to_boolean(F.col("needs_review")).alias("needs_review"),
    )


def prediction_columns(fields: DataFrame) -> DataFrame:
    """Columns of a production export."""
    return fields.select(
        "id",
        "filename",
        F.col("predicted_date").alias("date_created"),
        "date_confidence",
        F.col("predicted_candidate").alias("client"),
        F.col("candidate_confidence").alias("client_confidence"),
        "paid_for_by_raw",
        "is_frank",
        F.col("predicted_state").alias("state"),
        "state_confidence",
        "needs_review",
    )


def validation_columns(fields: DataFrame) -> DataFrame:
    """Columns of a validation export, with empty columns for manual scoring."""
    scoring = [
        "actual_date", "actual_candidate", "actual_state", "date_correct",
        "candidate_correct", "state_correct", "notes",
    ]
    return fields.select(
        "id", "filename", "predicted_date", "date_confidence", "predicted_candidate",
        "candidate_confidence", "paid_for_by_raw", "is_frank", "predicted_state",
        "state_confidence", *[F.lit("").alias(c) for c in scoring],
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True)


def completed_analyses(catalog: DataFrame) -> DataFrame:
    """Completed documents with an analysis, three columns."""
    return catalog.filter(
        (F.col("status") == "COMPLETED") & F.col("ai_analysis").isNotNull()
    ).select("id", "filename", "ai_analysis")
