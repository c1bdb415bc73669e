"""Pages far from the beginning of an ordered table.

``deep_page`` counts instead of sorting what lies before the page: the narrow sort keys are dealt into
ranges, the counts of the ranges are added up, and only the ranges the page lies in are sorted; their keys then fetch
the rows.  ``page_after`` goes on from the last row of a page by its key: rows behind it are filtered, and
each task hands on one page at most.  Both use the order ``(column, id)``; nulls come last, whichever the direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.session import new_folder

ROWS_PER_RANGE = 100_000


def sort_columns(column: str, descending: bool, id_col: str = "id") -> list[Column]:
    key = F.col(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(id_col).asc()]


def range_counts(df: DataFrame, column: str, descending: bool, id_col: str = "id", ranges: int | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The sort keys with the number of their range, stored, and the rows of each range in order.

    The ranges are stored because another run may cut them elsewhere."""
    keys = df.select(F.col(column).alias("key"), F.col(id_col).alias("id"))
    order = sort_columns("key", descending)
    wanted = ranges or 1 + df.count() // ROWS_PER_RANGE
    dealt = keys.repartitionByRange(wanted, *order).withColumn("range", F.spark_partition_id())
    path = new_folder(df.sparkSession, "page-keys")
    dealt.write.partitionBy("range").parquet(path)
    stored = df.sparkSession.read.schema(f"{dealt.schema.simpleString()[7:-1].replace(':', ' ')}").parquet(path)
    counts = stored.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect()
    return stored, [(row["range"], row["n"]) for row in counts]


def ranges_of_page(counts: list[tuple[int, int]], first: int, last: int) -> tuple[list[int], int]:
    """Ranges that hold places ``first`` to ``last`` (from 0, last excluded), and the rows before them."""
    before, skipped, found = 0, 0, []
    for number, n in counts:
        if before < last and before + n > first:
            if not found:
                skipped = before
            found.append(number)
        before += n
    return found, skipped


def deep_page(
    df: DataFrame, column: str, page: int, per_page: int, descending: bool = True, id_col: str = "id", ranges: int | None = None
) -> DataFrame:
    """Rows of a page (from 1) with their ``place`` in the whole order (from 1)."""
    first = (page - 1) * per_page
    stored, counts = range_counts(df, column, descending, id_col, ranges)
    numbers, skipped = ranges_of_page(counts, first, first + per_page)
    # a range is a few files; its rows are counted in one task
    place = F.row_number().over(Window.partitionBy("range").orderBy(*sort_columns("key", descending)))
    earlier, offset = F.lit(skipped), skipped
    sizes = dict(counts)
    for number in numbers:
        earlier = F.when(F.col("range") == number, F.lit(offset)).otherwise(earlier)
        offset += sizes[number]
    within = stored.where(F.col("range").isin(numbers) if numbers else F.lit(False)).withColumn("place", place + earlier)
    wanted = within.where((F.col("place") > first) & (F.col("place") <= first + per_page)).select(F.col("id").alias(id_col), "place")
    return df.join(wanted.withColumn("place", F.col("place").cast("long")), id_col).orderBy("place")


def page_after(df: DataFrame, column: str, after: tuple | None, per_page: int, descending: bool = True, id_col: str = "id") -> DataFrame:
    """The page behind the row with key ``after`` (value of the column, id); the first page for None."""
    rows = df
    if after is not None:
        value, last_id = after
        key, later = F.col(column), F.col(id_col) > F.lit(last_id)
        if value is None:
            rows = rows.where(key.isNull() & later)
        else:
            at = F.lit(value).cast(df.schema[column].dataType)
            beyond = key < at if descending else key > at
            rows = rows.where(key.isNull() | beyond | ((key == at) & later))
    return rows.orderBy(*sort_columns(column, descending, id_col)).limit(per_page)
