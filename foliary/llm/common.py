"""Helpers the operators of this folder share."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.session import new_folder

# Bytes that count as white space, and the bytes kept in words
# (digits, letters, all bytes of characters beyond ASCII).
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and characters beyond
    ASCII.  UTF-8 keeps the bytes of the latter at 0x80 and above, so one byte
    table does for all."""
    return text.translate(WORD_BYTES).split()


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, one at a time; null gives no bytes."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to and read from the folder all executors share."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def whole_rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``row, doc_id`` with all columns in ``row``, and the place of the text in it: it is not copied beside it."""
    names = df.columns
    row = F.struct(*[df[f"`{n}`"] for n in names]).alias("row")
    at = [n.lower() for n in names].index(text_col.lower())
    return df.select(row, df[f"`{id_col}`"].cast("long").alias("doc_id")), at


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files and checkpoints of frames no longer referenced; a loop that runs
    many small actions would otherwise keep those of every round until the driver's heap fills."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def mixed64(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (finaliser of splitmix64), one to one."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(column: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed only."""
    return (F.xxhash64(F.lit(seed), column).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` bytes of text, one row at least, so
    that what a task makes of them stays bounded."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
