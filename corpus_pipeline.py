"""From raw documents to token ids: five stages, each written and read again.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns
a frame.  All but the last return the columns of ``documents``; a document that the mix takes twice is two
rows from then on.

* toxicity: rows whose score reaches 0.7 go; the classifier learns from ``labels``.
* exact dedup: of texts equal but for white space, one stays.
* near dedup: of each class of near copies (five-word shingles, similarity of 0.8 or more), one stays.
* source mix: rows are dropped, kept or doubled so that sources meet their targets.
* byte-level BPE: ``doc_id, source, ids, n_tokens, round_trip``; ``round_trip`` says whether the decoded
  bytes are the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import byte_bpe, exact_duplicates, mixing, near_duplicates, toxicity
from foliary.session import new_folder, prepare

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_duplicates.without_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates.without_near_copies(docs)


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mixed(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    names = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, public_tokenizers.path(RANKS)
    return byte_bpe.token_rows(docs, *names, keep=("source",))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", source_mix_stage),
    ("byte-level BPE encoding and decoding", byte_bpe_stage),
]

# Signatures, language models and merges of tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
