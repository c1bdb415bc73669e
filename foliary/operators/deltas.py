"""Upkeep of derived tables by signed changes.

A derived table (postings, links, counts per term, status or year) is a sum over documents: what a set of
changed documents adds and takes away follows from their rows before and after the change. ``signed_rows`` computes
it; rows on both sides cancel out, so an unchanged word of a changed document costs nothing.

``SignedTable`` stores them: plain Parquet with a folder for each batch and, below it, for each bucket of a key.  A batch
writes its own rows only, and writing it again replaces its folder, so a repeated batch changes nothing.
Reading adds the signs up; a read of some keys opens only their buckets.  ``compacted`` writes the sums as a single batch of
a new table, when there are many.

``SignedLists`` is the same for a table of very many rows per document, such as postings: it stores a list for each
document, bucket and batch.  Documents are shuffled, not their rows, and reading adds up again only the documents that
a later batch touched.

``CatalogTable`` keeps documents in the same way: a batch has the new rows and the deleted ids, the latest batch of
an id counts, and the rows before a change are looked up in the buckets of the changed ids only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

View = Callable[[DataFrame], DataFrame]

# ids of changed documents that are sent to all executors at most; of more, the lists are shuffled to join them
MOST_IDS = 1_000_000


def signed_rows(before: DataFrame, after: DataFrame, view: View) -> DataFrame:
    """Rows of ``view`` with ``sign``: how many more there are after the change; none where it makes no difference.

    ``view`` maps documents to rows, each document for itself (joins with tables that do not change are allowed)."""
    both = view(before).withColumn("sign", F.lit(-1)).unionByName(view(after).withColumn("sign", F.lit(1)))
    return netted(both, [c for c in both.columns if c != "sign"])


def netted(rows: DataFrame, keys: Sequence[str], sign: str = "sign") -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(sign).cast("long").alias("sign")).where(F.col("sign") != 0)


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """Signed rows as changes of the counts per key."""
    return netted(rows, keys)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _buckets_of(spark: SparkSession, values: Sequence, buckets: int, kind: str) -> list[int]:
    """Buckets of a few values from the caller."""
    rows = spark.createDataFrame([(v,) for v in values], f"key {kind}")
    return [r[0] for r in rows.select(_bucket(F.col("key"), buckets)).distinct().collect()]


@dataclass(frozen=True)
class SignedTable:
    """A derived table: its folder, the columns of a row, and the column that chooses the bucket."""

    path: str
    keys: tuple[str, ...]
    bucket_key: str
    buckets: int = 64

    def write_change(self, before: DataFrame, after: DataFrame, view: View, batch: int) -> None:
        """Store what follows from documents before and after a change."""
        self.write_batch(signed_rows(before, after, view), batch)

    def write_batch(self, rows: DataFrame, batch: int) -> None:
        """Store the signed rows (with ``sign``) of a batch, in place of those it had."""
        placed = rows.select(*self.keys, "sign", _bucket(F.col(self.bucket_key), self.buckets).alias("bucket"))
        sorted_rows = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.keys)
        sorted_rows.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def stored(self, spark: SparkSession, values: Sequence | None = None) -> DataFrame:
        """Signed rows of all batches; with ``values`` of the bucket key only those, from their buckets."""
        rows = spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        if values is not None:
            kind = rows.schema[self.bucket_key].dataType.simpleString()
            chosen = _buckets_of(spark, values, self.buckets, kind)
            rows = rows.where(F.col("bucket").isin(chosen) & F.col(self.bucket_key).isin(list(values)))
        return rows

    def current(self, spark: SparkSession, values: Sequence | None = None) -> DataFrame:
        """``keys, n``: the rows as they are now, and how many times each is there."""
        return netted(self.stored(spark, values), self.keys).withColumnRenamed("sign", "n")

    def compacted(self, spark: SparkSession, path: str) -> "SignedTable":
        """The same rows as one batch of a table elsewhere; batches written meanwhile are not in it."""
        table = SignedTable(path, self.keys, self.bucket_key, self.buckets)
        table.write_batch(self.current(spark).withColumnRenamed("n", "sign"), 0)
        return table


def _netted_lists(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Lists by ``id`` and ``bucket`` from ``id, rows``: equal rows of a list are added up, and it is split by the bucket of its rows."""
    lists = batch.column("rows")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    rows = pa.Table.from_struct_array(lists.flatten())
    rows = rows.append_column("list", pa.array(np.repeat(np.arange(len(lists)), lengths)))
    keys = [c for c in rows.column_names if c != "sign"]
    # without threads the rows stay in the order in which they come
    added = rows.group_by(keys, use_threads=False).aggregate([("sign", "sum")])
    added = added.filter(pc.not_equal(added["sign_sum"], 0))
    added = added.take(pc.sort_indices(added.select(["list", "bucket"]), [("list", "ascending"), ("bucket", "ascending")]))
    of, bucket = added["list"].to_numpy(), added["bucket"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])][: len(of)])
    names = [c for c in keys if c not in ("list", "bucket")]
    offsets = pa.array(np.r_[starts, len(of)], pa.int32())
    columns = [pa.ListArray.from_arrays(offsets, added[c].combine_chunks()) for c in (*names, "sign_sum")]
    places = [batch.column("id").take(pa.array(of[starts])), pa.array(bucket[starts], pa.int32())]
    return pa.RecordBatch.from_arrays(places + columns, names=["id", "bucket", *names, "sign"])


@dataclass(frozen=True)
class SignedLists:
    """A derived table of rows of documents: its folder, the columns of a row beside ``id``, and the one that chooses the bucket.

    Its view maps documents to a column, the list of the rows (structs of ``keys``) of each.  What is stored has an array for
    each of the ``keys`` and for ``sign``: it is shuffled and compressed better than structs are."""

    path: str
    keys: tuple[str, ...]
    bucket_key: str
    buckets: int = 64

    def _lists(self, lists: DataFrame) -> DataFrame:
        """Lists to store from ``id, rows`` (structs of ``keys`` and ``sign``), netted; rows of one id are in one partition."""
        joined = lists.groupBy("id").agg(F.flatten(F.collect_list("rows")).alias("rows"))
        places = F.transform("rows", lambda r: r.withField("bucket", _bucket(r[self.bucket_key], self.buckets)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from map(_netted_lists, batches)

        fields = [f"{f.name} array<{f.dataType.simpleString()}>" for f in lists.schema["rows"].dataType.elementType]
        kind = lists.schema["id"].dataType.simpleString()
        return joined.select("id", places.alias("rows")).mapInArrow(run, ", ".join([f"id {kind}, bucket int", *fields]))

    def _write(self, lists: DataFrame, batch: int) -> None:
        lists.write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batch={batch}")

    def write_change(self, before: DataFrame, after: DataFrame, view: Callable[[DataFrame], Column], batch: int) -> None:
        """Store what follows from documents before and after a change, in place of what the batch had."""
        sides = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
        # documents meet by id, then their rows are made
        placed = sides.repartition("id")
        signed = F.transform(view(placed), lambda r: F.struct(*[r[k].alias(k) for k in self.keys], F.col("sign").cast("long").alias("sign")))
        self._write(self._lists(placed.select("id", signed.alias("rows"))), batch)

    def _stored_lists(self, spark: SparkSession, values: Sequence | None = None) -> DataFrame:
        lists = spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        if values is None:
            return lists
        kind = lists.schema[self.bucket_key].dataType.elementType.simpleString()
        return lists.where(F.col("bucket").isin(_buckets_of(spark, values, self.buckets, kind)))

    def _current_lists(self, spark: SparkSession, values: Sequence | None = None) -> DataFrame:
        """Netted lists; those of a document that only the first batch has are netted already."""
        lists = self._stored_lists(spark, values)
        columns = ["id", "bucket", *self.keys, "sign"]
        first = lists.agg(F.min("batch")).first()[0]
        if first is None:
            return lists.select(*columns)
        again = lists.where(F.col("batch") > first).select("id").distinct()
        found = again.count()
        if not found:
            return lists.select(*columns)
        if found <= MOST_IDS:
            again = F.broadcast(again)
        same = lists["id"].eqNullSafe(again["id"])
        changed = lists.join(again, same, "left_semi").select("id", *self.keys, "sign").repartition("id")
        several = self._lists(changed.select("id", F.arrays_zip(*self.keys, "sign").alias("rows")))
        return lists.join(again, same, "left_anti").select(*columns).unionByName(several)

    def _rows(self, lists: DataFrame, values: Sequence | None, *others: str) -> DataFrame:
        """Single rows of lists, their columns and ``sign``, then ``others``."""
        names = [*self.keys, "sign"]
        rows = lists.select("id", F.explode(F.arrays_zip(*names)).alias("r"), *others).select("id", *[f"r.{c}" for c in names], *others)
        return rows if values is None else rows.where(F.col(self.bucket_key).isin(list(values)))

    def stored(self, spark: SparkSession, values: Sequence | None = None) -> DataFrame:
        """Signed rows of all batches; with ``values`` of the bucket key only those, from their buckets."""
        return self._rows(self._stored_lists(spark, values), values, "batch", "bucket")

    def current(self, spark: SparkSession, values: Sequence | None = None) -> DataFrame:
        """``id``, ``keys``, ``n``: the rows as they are now, and how many times each is there."""
        return self._rows(self._current_lists(spark, values), values).withColumnRenamed("sign", "n")

    def compacted(self, spark: SparkSession, path: str) -> "SignedLists":
        """The same rows as one batch of a table elsewhere; batches written meanwhile are not in it."""
        table = SignedLists(path, self.keys, self.bucket_key, self.buckets)
        table._write(self._current_lists(spark), 0)
        return table


@dataclass(frozen=True)
class CatalogTable:
    """Documents by batch; of each id the row of the latest batch counts."""

    path: str
    buckets: int = 64

    def write_batch(self, upserts: DataFrame, batch: int, deleted: DataFrame | None = None) -> None:
        """New and changed rows, and ids (``id``) that go."""
        rows = upserts.select(F.col("id"), F.struct(*upserts.columns).alias("row"))
        if deleted is not None:
            none = F.lit(None).cast(rows.schema["row"].dataType).alias("row")
            gone = deleted.select("id").join(upserts.select("id"), "id", "left_anti").distinct()
            rows = rows.unionByName(gone.select("id", none))
        placed = rows.withColumn("bucket", _bucket(F.col("id"), self.buckets)).hint("rebalance", "bucket")
        placed.write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batch={batch}")

    def current(self, spark: SparkSession, ids: DataFrame | None = None, before_batch: int | None = None) -> DataFrame:
        """The documents as they are now, or (``before_batch``) before a batch; with ``ids`` only those."""
        rows = spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        if before_batch is not None:
            rows = rows.where(F.col("batch") < before_batch)
        if ids is not None:
            # at most as many numbers as there are buckets
            placed = ids.select("id", _bucket(F.col("id").cast(rows.schema["id"].dataType), self.buckets).alias("bucket"))
            chosen = [r[0] for r in placed.select("bucket").distinct().collect()]
            rows = rows.where(F.col("bucket").isin(chosen) if chosen else F.lit(False))
            rows = rows.join(ids.select("id").distinct(), "id", "left_semi")
        latest = rows.groupBy("id").agg(F.max_by("row", "batch").alias("row"))
        return latest.where(F.col("row").isNotNull()).select("row.*")


def update(
    spark: SparkSession,
    catalog: CatalogTable,
    views: Sequence[tuple[SignedTable | SignedLists, View | Callable[[DataFrame], Column]]],
    batch: int,
    upserts: DataFrame,
    deleted: DataFrame | None = None,
) -> None:
    """Store a batch of changed documents and what follows from it in each derived table.

    Derived rows are written before the documents, from the state before the batch: a run that was interrupted is
    repeated as a whole with the same result.
    """
    ids = upserts.select("id")
    if deleted is not None:
        ids = ids.unionByName(deleted.select("id"))
    before = upserts.limit(0) if batch == 0 else catalog.current(spark, ids, before_batch=batch)
    for table, view in views:
        table.write_change(before, upserts, view, batch)
    catalog.write_batch(upserts, batch, deleted)
