"""Substring search by an index of three-character pieces.

``write_trigrams`` stores rows of a field, a trigram (its code points as one number) and the ids of documents that have
it, one row for each trigram of a batch of documents, in folders by a hash of the trigram, sorted by trigram: a search reads only the folders of the trigrams of its term.  A row that contains the
term has all of them, so the rows that do are candidates; each candidate is then tested by the term itself, hence
results equal those of the scan.  A term without three literal characters in a row has no
trigram and is answered by the scan.

Case is folded on both sides as the test itself does.  ``%`` and ``_`` are literal unless ``wildcards`` is set; then the
literal stretches between them give the trigrams.  A null value has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.text import contains_term

FOLDERS = 64


def trigram_codes(points: np.ndarray) -> np.ndarray:
    """The three code points that begin at each place, as one number."""
    p = points.astype(np.int64)
    return p[:-2] << 42 | p[1:-1] << 21 | p[2:]


def grouped_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gram, ids`` of rows (``id``, ``texts``): for each trigram in the texts of a batch the rows that have it."""
    for batch in batches:
        n, texts = batch.num_rows, batch.column("texts").flatten()
        rows = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(batch.column("texts")), 0))
        given = texts.is_valid()
        texts, rows = texts.filter(given), rows[given.to_numpy(zero_copy_only=False)]
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        if len(points) < 3:
            continue
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        alphabet = np.flatnonzero(seen)
        size = len(alphabet)
        if size**3 * n >= 1 << 63:
            yield from grouped_trigrams(iter([batch.slice(0, n // 2), batch.slice(n // 2)]))
            continue
        # a number for each trigram of this alphabet and row, sorted
        letters = (np.cumsum(seen) - 1)[points]
        lengths = pc.utf8_length(texts).to_numpy()
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
        inside = left[:-2] >= 3  # a trigram ends in the text it began in
        codes = (letters[:-2] * size + letters[1:-1]) * size + letters[2:]
        pairs = np.unique((codes * n + np.repeat(rows, lengths)[:-2])[inside])
        first = np.flatnonzero(np.diff(pairs // n, prepend=-1))
        own = pairs[first] // n
        grams = alphabet[own // size**2] << 42 | alphabet[own // size % size] << 21 | alphabet[own % size]
        ids = batch.column("id").take(pa.array(pairs % n))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(pairs)], pa.int32()), ids)
        yield pa.record_batch([pa.array(grams), lists], ["gram", "ids"])


def term_trigrams(term: str, wildcards: bool = False) -> list[int]:
    """Trigrams every text with the term has."""
    stretches = re.split(r"[%_]|\\(?=[%_\\])", term) if wildcards else [term]
    folded = [s.lower() for s in stretches]
    points = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in folded if len(s) > 2]
    return sorted({g for p in points for g in trigram_codes(p).tolist()})


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def write_trigrams(df: DataFrame, fields: dict[str, Column], path: str, id_col: str = "id", mode: str = "errorifexists") -> None:
    """Index the fields (texts, or arrays of texts) of every row; ``mode="append"`` adds further documents."""
    kind = df.schema[id_col].dataType.simpleString()
    parts = []
    for name, value in fields.items():
        rows = df.select(F.col(id_col).alias("id"), value.alias("value"))
        if rows.schema["value"].dataType.typeName() == "array":
            texts = F.transform("value", F.lower)
        else:
            texts = F.array(F.lower("value"))
        grams = rows.select("id", texts.alias("texts")).mapInArrow(grouped_trigrams, f"gram long, ids array<{kind}>")
        parts.append(grams.select(F.lit(name).alias("field"), "gram", "ids"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("folder", _folder(F.col("gram")))
    # a frequent trigram spans as many files as it needs
    rows.hint("rebalance", "folder").sortWithinPartitions("folder", "field", "gram").write.partitionBy("folder").mode(mode).parquet(path)


def candidates(spark: SparkSession, path: str, fields: list[str], term: str, wildcards: bool = False) -> DataFrame | None:
    """Ids of the documents with a field that has all trigrams of the term; None if the term has none."""
    grams = term_trigrams(term, wildcards)
    if not grams:
        return None
    folders = [row[0] for row in spark.createDataFrame([(g,) for g in grams], "gram long").select(_folder(F.col("gram"))).distinct().collect()]
    stored = spark.read.parquet(path).where(F.col("folder").isin(folders) & F.col("field").isin(fields) & F.col("gram").isin(grams))
    # an id may be in several rows of a trigram
    each = stored.select("field", "gram", F.explode("ids").alias("id"))
    having = each.groupBy("id", "field").agg(F.collect_set("gram").alias("grams")).where(F.size("grams") == len(grams))
    return having.select("id").distinct()


def containing(df: DataFrame, path: str, fields: dict[str, Column], term: str, wildcards: bool = False, id_col: str = "id") -> DataFrame:
    """Rows of ``df`` of which a field (text or array of texts, as indexed) contains the term."""
    found = candidates(df.sparkSession, path, list(fields), term, wildcards)
    if found is not None:
        df = df.join(found.withColumnRenamed("id", id_col), id_col, "left_semi")
    hit = F.lit(False)
    for value in fields.values():
        kind = df.select(value.alias("value")).schema["value"].dataType.typeName()
        test = F.exists(value, lambda x: contains_term(x, term, wildcards)) if kind == "array" else contains_term(value, term, wildcards)
        hit = hit | F.coalesce(test, F.lit(False))
    return df.where(hit)
