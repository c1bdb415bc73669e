"""Facets of any filtered result by bitmaps.

The documents of each term are stored as bitmaps: one row per term and range of 32,768 document numbers, with the
number of set bits. A result is turned into bitmaps of the same ranges; the facet of a term is the number of bits both
have, added up over the ranges, so links are never joined to documents, and what a facet reads does not
depend on the size of the result.  A pair of bitmaps shares ``a + b - (a or b)`` bits.

Document numbers should be dense (catalog ids are): a range that holds one document still takes one bitmap, which compresses
to a few bytes on disk but not in memory.  A term's ranges are many rows, so a frequent term is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bitmaps(rows: DataFrame, number: str, *keys: str) -> DataFrame:
    """``keys, range, bits`` of the document numbers; a repeated number is one bit."""
    placed = rows.where(F.col(number).isNotNull())
    return placed.groupBy(*keys, F.bitmap_bucket_number(number).alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def term_bitmaps(links: DataFrame, term: str = "taxonomy_term_id", document: str = "document_id") -> DataFrame:
    return _bitmaps(links, document, term).withColumn("n", F.bitmap_count("bits"))


def write_bitmaps(links: DataFrame, path: str, term: str = "taxonomy_term_id", document: str = "document_id") -> None:
    """Store the bitmaps sorted by range, so that a narrow result reads the row groups of its ranges."""
    found = term_bitmaps(links, term, document)
    found.repartitionByRange("range", term).sortWithinPartitions("range", term).write.parquet(path)


def facets(bitmaps: DataFrame, matching: DataFrame, term: str = "taxonomy_term_id", id_col: str = "id") -> DataFrame:
    """``term, count`` of the documents in ``matching``; terms without one are left out."""
    wanted = _bitmaps(matching, id_col).select("range", F.col("bits").alias("asked"))
    both = bitmaps.join(wanted.withColumn("asked_n", F.bitmap_count("asked")), "range")
    # the two bitmaps of a term and range are united where they lie: one group is one pair
    pairs = both.select(term, "range", "n", "asked_n", F.explode(F.array("bits", "asked")).alias("one"))
    united = pairs.groupBy(term, "range").agg(
        (F.first("n") + F.first("asked_n") - F.bitmap_count(F.bitmap_or_agg("one"))).alias("shared")
    )
    return united.groupBy(term).agg(F.sum("shared").cast("long").alias("count")).where(F.col("count") > 0)
