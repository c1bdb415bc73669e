"""Approximate nearest vectors: inverted lists around trained centroids.

``write_index`` trains centroids on a bounded sample (``SAMPLE_PER_LIST`` rows for each list), assigns every
row to its nearest centroid and stores two tables partitioned by list: codes (the
residual to the centroid, one byte per dimension, with the exact length of what the byte rounds away) and the vectors
themselves.  ``append_to_index`` assigns further rows to the same centroids and writes to the same
partitions; nothing stored is read or rewritten.

A query compares its vector with the centroids and reads the ``probes`` nearest lists only.  A code
gives a similarity and, by the stored error, a bound on either side; a row whose upper bound lies
below the k-th best lower bound of its query cannot be among the first k.  The rest is ranked by the vectors
themselves.  So the answer is exact for the lists that are read, and with ``probes`` of all
lists it is the exact answer; fewer lists cost recall, measured by ``recall``.

Similarity is the cosine.  Rows without a vector, or with one of length 0, are not indexed.  The centroids
(``lists`` times dimensions) are in the driver and travel with the tasks; ``lists`` grows with the root of the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_PER_LIST = 256
LIST_ROWS = 4096  # rows of a list that are scored together
PROBES = 16
SEED = 7


@dataclass
class VectorIndex:
    """A stored index: its folder and its centroids (unit vectors, one row for each list)."""

    path: str
    centroids: np.ndarray

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/codes")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrays of equal length as a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten(), dtype=np.float64).reshape(len(whole), -1)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    narrow = df.select(df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{vector_col}`"].cast("array<double>").alias("vector"))
    return narrow.where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0))


def trained_centroids(rows: DataFrame, lists: int, total: int) -> np.ndarray:
    """Cosine k-means over a sample of the rows (``id, vector``) chosen by a hash of the id."""
    share = min(1.0, lists * SAMPLE_PER_LIST / max(1, total))
    chance = F.xxhash64(F.lit(SEED), "id").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    sample = rows.where(chance < share).select(array_to_vector("vector").alias("features"))
    model = KMeans(k=lists, seed=SEED, maxIter=15, distanceMeasure="cosine").fit(sample)
    return unit_rows(np.array(model.clusterCenters()))


def _coded(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``list, part, id, code, scale, error, vector`` of the rows, vectors of length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unit_rows(matrix_of(batch.column(1)))
            nearest = np.argmax(vectors @ centroids.T, axis=1)
            residual = vectors - centroids[nearest]
            scale = np.maximum(np.abs(residual).max(axis=1), 1e-12) / 127
            code = np.rint(residual / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(residual - code * scale[:, None], axis=1)
            flat = pa.array(vectors.ravel())
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nearest.astype(np.int32)),
                    batch.column(0),
                    pa.array([c.tobytes() for c in code], pa.binary()),
                    pa.array(scale),
                    pa.array(error),
                    pa.ListArray.from_arrays(ends, flat),
                ],
                names=["list", "id", "code", "scale", "error", "vector"],
            )

    return rows.mapInArrow(run, "list int, id long, code binary, scale double, error double, vector array<double>")


def _store(rows: DataFrame, centroids: np.ndarray, path: str, mode: str) -> None:
    # a frequent list spans as many tasks and files as it needs
    coded = _coded(rows, centroids).hint("rebalance", "list")
    for name, columns in (("codes", ["list", "id", "code", "scale", "error"]), ("vectors", ["list", "id", "vector"])):
        coded.select(*columns).write.partitionBy("list").mode(mode).parquet(f"{path}/{name}")


def write_index(df: DataFrame, path: str, lists: int | None = None, id_col: str = "id", vector_col: str = "search_vector") -> VectorIndex:
    """Train, code and store every row of ``df``; by default a list for each root of the number of rows."""
    rows = _usable(df, id_col, vector_col)
    total = rows.count()
    if not total:
        raise ValueError("no vectors to index")
    wanted = lists or max(2, round(total**0.5))
    centroids = trained_centroids(rows, min(wanted, total), total) if total > 1 else unit_rows(matrix_of(rows.toArrow()["vector"]))
    spark = df.sparkSession
    stored = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(stored, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    _store(rows, centroids, path, "errorifexists")
    return VectorIndex(path, centroids)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return VectorIndex(path, np.array([row["centroid"] for row in found]))


def append_to_index(index: VectorIndex, df: DataFrame, id_col: str = "id", vector_col: str = "search_vector") -> None:
    """Add rows to the stored lists."""
    _store(_usable(df, id_col, vector_col), index.centroids, index.path, "append")


def _bounds(index: VectorIndex, query: np.ndarray, lists: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the similarity of rows with queries (rows by queries)."""
    about = index.centroids[lists] @ query.T + (codes @ query.T) * scale[:, None]
    # beside the rounding of the codes that of this sum
    slack = error[:, None] + 1e-9
    return about - slack, about + slack


def _code_matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, dimensions).astype(np.float64)


def _kept(lower: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the first k."""
    if len(lower) <= k:
        return np.arange(len(lower))
    return np.flatnonzero(upper >= np.partition(lower, len(lower) - k)[len(lower) - k])


def probed_lists(index: VectorIndex, vectors: np.ndarray, probes: int) -> np.ndarray:
    """The lists each vector reads, nearest first."""
    return np.argsort(-(vectors @ index.centroids.T), axis=1, kind="stable")[:, :probes]


def nearest(spark: SparkSession, index: VectorIndex, query_vector: Sequence[float], k: int, probes: int = PROBES) -> DataFrame:
    """``id, vector_relevance`` of the first ``k`` rows of the probed lists."""
    query = unit_rows(np.array([query_vector], dtype=np.float64))
    lists = [int(x) for x in probed_lists(index, query, probes)[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _code_matrix(batch.column(2), query.shape[1])
            own = [batch.column(i).to_numpy() for i in (0, 3, 4)]
            lower, upper = _bounds(index, query, own[0], codes, *own[1:])
            keep = _kept(lower[:, 0], upper[:, 0], k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(lower[keep, 0]), pa.array(upper[keep, 0])],
                names=["list", "id", "lower", "upper"],
            )

    read = index.codes(spark).where(F.col("list").isin(lists)).select("list", "id", "code", "scale", "error")
    possible = read.mapInArrow(run, "list int, id long, lower double, upper double")
    first = possible.orderBy(F.desc("lower")).limit(k)
    least = first.agg(F.min("lower").alias("least"), F.count("*").alias("n"))
    least = least.select(F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(-2.0)))
    candidates = possible.where(F.col("upper") >= least.scalar()).select("list", "id")
    vectors = index.vectors(spark).where(F.col("list").isin(lists))
    literal = F.array(*[F.lit(float(x)) for x in query[0]])
    score = F.aggregate(F.zip_with("vector", literal, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return (
        vectors.join(candidates, ["list", "id"], "left_semi")
        .select("id", score.alias("vector_relevance"))
        .orderBy(F.desc("vector_relevance"), "id")
        .limit(k)
    )


def nearest_of_many(
    index: VectorIndex, queries: DataFrame, k: int, probes: int = PROBES, id_col: str = "query_id", vector_col: str = "vector"
) -> DataFrame:
    """``query_id, id, vector_relevance, rank, list``: the first ``k`` rows of the probed lists of each query.

    Queries are a table and travel to their lists; a list is scored in parts of some ``LIST_ROWS`` rows, each with the
    queries that read it, and hands on only rows that may be among the first k of a query.
    """
    spark = queries.sparkSession
    dimensions = index.centroids.shape[1]
    rows = _usable(queries, id_col, vector_col)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unit_rows(matrix_of(batch.column(1)))
            lists = probed_lists(index, vectors, probes)
            at = np.repeat(np.arange(len(vectors)), lists.shape[1])
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists.ravel().astype(np.int32)), batch.column(0).take(pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(vectors[at].ravel()))],
                names=["list", "query_id", "query"],
            )

    asked = rows.mapInArrow(probing, "list int, query_id long, query array<double>")
    codes = index.codes(spark)
    sizes = codes.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    parted = codes.join(sizes, "list").select("list", part, "id", "code", "scale", "error")
    spread = asked.join(sizes, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    spread = spread.withColumnsRenamed({"list": "q_list", "part": "q_part"})
    empty = pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("list", pa.int32()), ("id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64()))})

    def met(stored: pa.Table, asking: pa.Table) -> pa.Table:
        if not stored.num_rows or not asking.num_rows:
            return empty
        matrix = _code_matrix(stored["code"].combine_chunks(), dimensions)
        lists, ids = stored["list"].to_numpy(), stored["id"].to_numpy()
        out = []
        for start in range(0, asking.num_rows, 256):
            some = asking.slice(start, 256)
            lower, upper = _bounds(index, matrix_of(some["query"]), lists, matrix, stored["scale"].to_numpy(), stored["error"].to_numpy())
            for j, name in enumerate(some["query_id"].to_pylist()):
                keep = _kept(lower[:, j], upper[:, j], k)
                own = [np.full(len(keep), name), lists[keep], ids[keep], lower[keep, j], upper[keep, j]]
                out.append(pa.table([pa.array(c, t) for c, t in zip(own, empty.schema.types)], names=empty.schema.names))
        return pa.concat_tables(out)

    schema = "query_id long, list int, id long, lower double, upper double"
    possible = parted.groupBy("list", "part").cogroup(spread.groupBy("q_list", "q_part")).applyInArrow(met, schema)
    # parts that were cut at random hold about as much of the best each: the k-th lower bound of all of them prunes the rest
    by_lower = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    kth = possible.withColumn("n", F.row_number().over(by_lower)).where(F.col("n") == k).select("query_id", F.col("lower").alias("least"))
    candidates = possible.join(kth, "query_id", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    exact = candidates.select("query_id", "list", "id").join(index.vectors(spark), ["list", "id"])
    unit = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    length = F.sqrt(F.aggregate("query", F.lit(0.0), lambda a, x: a + x * x))
    score = F.aggregate(F.zip_with("vector", "query", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / length
    scored = exact.join(unit, "query_id").select("query_id", "id", score.alias("vector_relevance"), "list")
    rank = Window.partitionBy("query_id").orderBy(F.desc("vector_relevance"), "id")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, wanted, found``: rows of the exact answers (``query_id, id``), and those that were found."""
    hit = found.select("query_id", "id").withColumn("hit", F.lit(1))
    return exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


def tuned_probes(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.9, most: int = 200, id_col: str = "query_id", vector_col: str = "vector") -> int:
    """The fewest lists that find a share of ``target`` of the exact answers, measured on at most about ``most`` of the queries
    (chosen by a hash; their ``most * k`` answers come to the driver)."""
    total = queries.count()
    chance = F.xxhash64(F.lit(SEED + 1), id_col).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    asked = queries.where(chance < most / max(1, total))
    answers = nearest_of_many(index, asked, k, len(index.centroids), id_col, vector_col).select("query_id", "list").collect()
    vectors = {row[id_col]: np.array(row[vector_col], dtype=np.float64) for row in asked.select(id_col, vector_col).collect()}
    if not answers:
        return len(index.centroids)
    places = []
    for row in answers:
        order = probed_lists(index, unit_rows(vectors[row["query_id"]][None, :]), len(index.centroids))[0]
        places.append(int(np.flatnonzero(order == row["list"])[0]) + 1)
    return int(np.quantile(places, target, method="higher"))
