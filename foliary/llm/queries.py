"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from foliary.llm import (
    alignment,
    byte_bpe,
    exact_duplicates,
    licences,
    mixing,
    near_duplicates,
    packing,
    periodic_runs,
    perplexity,
    sharding,
    token_counts,
    toxicity,
    url_rules,
)
from foliary.session import prepare

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judged(table(spark, folder, "pages"), rules)


def op2_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scanned(table(spark, folder, "documents"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    names = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, public_tokenizers.path(RANKS)
    ids = byte_bpe.encoded(table(spark, folder, "documents"), *names)
    both = byte_bpe.with_decoded(ids, names[0], names[2])
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(byte_bpe.ids_as_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return token_counts.counted(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.classes(table(spark, folder, "documents"))


def op6_packed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return packing.packed(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.judged(table(spark, folder, "documents"), folded=False)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.scored(documents, toxicity.fitted(documents, labels))


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    made = mixing.mixture(mixing.sizes_of(table(spark, folder, "documents")))
    return made.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates.groups(table(spark, folder, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    names = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, public_tokenizers.path(PIECES)
    return alignment.summaries(table(spark, folder, "documents"), *names)


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.summaries(table(spark, folder, "documents"), change=periodic_runs.planted)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(prepare(spark), folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_license_scans,
        op3_byte_bpe,
        op4_token_counts,
        op5_near_duplicates,
        op6_packed_tokens,
        op7_quality_rules,
        op8_toxicity,
        op9_source_mix,
        op10_exact_duplicates,
        op11_cross_tokenizer_alignment,
        op12_sharding,
        op13_periodic_runs,
        pipeline,
    )
}

CHECKS: dict[str, str] = {
    "op1_url_filters": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT *, host = 'net' OR suffix(host, '.net') AS in_net, host = 'example.net' OR suffix(host, '.example.net') AS in_example_net,
    host = 'example.com' OR suffix(host, '.example.com') AS in_example_com, host = 'org' OR suffix(host, '.org') AS in_org FROM parts),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN in_example_net AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN in_example_com AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN in_org AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN in_net AND starts_with(path, '/') THEN 'net/' END AS rule FROM fits)
SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op10_exact_duplicates": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id)""",
}
