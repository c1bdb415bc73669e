"""Exact duplicates by two passes over a Bloom filter.

Texts are equal when they are identical after deleting the white space
``[\\x20\\x09-\\x0D]``.  The first pass adds the hash of each text to a filter of
two-bit counters (bit arrays *once* and *twice*); a hash that occurs twice has all
its positions in *twice*, so the second pass can tell which rows may have a copy.
Only those rows shuffle.  All others pass straight through as their own group.

The filter has ``bits_per_row`` positions for each row, rounded to a power of two and
at most ``2**max_filter_bits``: that bounds what travels to the executors (2**27
positions are 16 MB).  A filter that has become too small only lets more rows
shuffle; the result is the same.

Defined cases: a null text counts as empty, and all empty texts are one group.  Of equal
texts the row with the most code points in its original text stays, then the
smallest id (null last); of rows that repeat these as well, one.  Further columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import bloom
from foliary.llm.common import WHITE_SPACE, byte_texts, stored, whole_rows


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(None, WHITE_SPACE)).digest()


def code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def hashed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, sha`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, shas = [], []
            for text in byte_texts(batch.column(1)):
                chars.append(code_points(text))
                shas.append(digest(text))
            yield pa.record_batch(
                [batch.column(0), pa.array(chars, pa.int64()), pa.array(shas, pa.binary())],
                ["doc_id", "n_chars", "sha"],
            )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_chars long, sha binary")


def possible_rows(df: DataFrame, bits_per_row: int, max_filter_bits: int) -> DataFrame:
    """Both passes over ``df`` (stored, with a column ``sha``)."""
    size = bloom.filter_size(df.count(), bits_per_row, max_filter_bits)
    return bloom.with_test(df, "sha", bloom.filled(df.select("sha"), size, 2), size)


def winners(rows: DataFrame) -> DataFrame:
    """Of each ``sha`` the row that stays, and how many there are."""
    order = F.struct(
        (-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("tag").alias("d")
    )
    return (
        rows.groupBy("sha")
        .agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
        .select("sha", F.col("first.c").alias("keep_id"), F.col("first.d").alias("keep_tag"), "group_size")
    )


def groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    max_filter_bits: int = 27,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = stored(
        hashed(df, id_col, text_col).withColumn("tag", F.monotonically_increasing_id()), "text-hashes"
    )
    flagged = possible_rows(rows, bits_per_row, max_filter_bits)
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = flagged.where("not possible").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    possible = flagged.where("possible").drop("possible")
    found = possible.join(winners(possible), "sha").select(
        "doc_id", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), sha
    )
    return alone.unionByName(found)


def without_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    max_filter_bits: int = 27,
) -> DataFrame:
    """``df`` with one row of each group, all columns as they were.

    Rows that may have a copy are stored once with a tag and joined with the winners
    of their groups; no other text shuffles.
    """
    names = df.columns
    whole, text_at = whole_rows(df, id_col, text_col)
    hashes = stored(hashed(df, id_col, text_col), "text-hashes")
    size = bloom.filter_size(hashes.count(), bits_per_row, max_filter_bits)
    bits = df.sparkSession.sparkContext.broadcast(bloom.filled(hashes.select("sha"), size, 2))

    # rows are hashed and looked up in one step: a second one would be a second Python process for each task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, shas = [], []
            for text in byte_texts(batch.column(0).field(text_at)):
                chars.append(code_points(text))
                shas.append(digest(text))
            sha = pa.array(shas, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(chars, pa.int64()), sha, bloom.tested(sha, bits.value, size)],
                names=["row", "doc_id", "n_chars", "sha", "possible"],
            )

    schema = whole.select(
        "row",
        "doc_id",
        F.lit(0).cast("long").alias("n_chars"),
        F.lit(b"").cast("binary").alias("sha"),
        F.lit(True).alias("possible"),
    ).schema
    flagged = whole.mapInArrow(run, schema)
    possible = stored(
        flagged.where("possible").drop("possible").withColumn("tag", F.monotonically_increasing_id()),
        "possible-copies",
    )
    best = winners(possible.select("sha", "n_chars", "doc_id", "tag")).select(
        F.col("keep_tag").alias("tag"), F.lit(True).alias("stays")
    )
    found = possible.join(best, "tag", "left_semi")
    out = flagged.where("not possible").select("row").unionByName(found.select("row"))
    return out.select(*[F.col("row")[n].alias(n) for n in names])


