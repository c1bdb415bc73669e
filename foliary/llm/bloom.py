"""A Bloom filter over a column of hashes, filled by tasks and merged block by block.

Each position has a two-bit counter, so a filter can hold the hashes that occur (``least=1``) or those
that may occur twice (``least=2``: a hash that does has all its positions at two).  Its size is
``bits_per_row`` positions for each row, a power of two, at most ``2**max_bits``: that bounds what is
sent to the executors, and a filter that is too small only lets more rows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = 4
BLOCK = 1 << 16  # positions of one block


def filter_size(rows: int, bits_per_row: int = 16, max_bits: int = 27) -> int:
    wanted = max(BLOCK, rows * bits_per_row)
    return 1 << min(max_bits, (wanted - 1).bit_length())


def positions(hashes: pa.Array, size: int) -> np.ndarray:
    """``PROBES`` positions of each hash of 16 bytes or more, one row per hash."""
    parts = np.frombuffer(b"".join(hashes.to_pylist()), dtype="<u8").reshape(len(hashes), -1 if len(hashes) else 2)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (parts[:, :1] + steps * (parts[:, 1:2] | np.uint64(1))) & np.uint64(size - 1)


def filled(hashes: DataFrame, size: int, least: int) -> np.ndarray:
    """Packed bits of the positions that were hit at least ``least`` (1 or 2) times; ``hashes`` has one
    column.  Each task sends the blocks it has touched; they merge by position."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.uint8)
        for batch in batches:
            for probe in positions(batch.column(0), size).T:
                at, n = np.unique(probe, return_counts=True)
                counts[at] = np.minimum(2, counts[at] + np.minimum(n, 2))
        for start in range(0, size, BLOCK):
            own = counts[start : start + BLOCK]
            if own.any():
                bits = [pa.array([np.packbits(own >= n).tobytes()], pa.binary()) for n in (1, 2)]
                yield pa.record_batch([pa.array([start // BLOCK], pa.int32()), *bits], ["block", "once", "twice"])

    def merged(table: pa.Table) -> pa.Table:
        once = np.zeros(BLOCK // 8, dtype=np.uint8)
        twice = np.zeros(BLOCK // 8, dtype=np.uint8)
        for a, b in zip(table.column("once").to_pylist(), table.column("twice").to_pylist()):
            a = np.frombuffer(a, dtype=np.uint8)
            twice |= np.frombuffer(b, dtype=np.uint8) | (once & a)
            once |= a
        bits = once if least == 1 else twice
        return pa.table({"block": table.column("block").slice(0, 1), "bits": [bits.tobytes()]})

    out = np.zeros(size // 8, dtype=np.uint8)
    blocks = hashes.mapInArrow(fill, "block int, once binary, twice binary")
    for row in blocks.groupBy("block").applyInArrow(merged, "block int, bits binary").toLocalIterator():
        start = row["block"] * BLOCK // 8
        out[start : start + BLOCK // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def tested(hashes: pa.Array, bits: np.ndarray, size: int) -> pa.Array:
    """Whether the filter may hold each hash."""
    where = positions(hashes, size)
    hit = (bits[where >> np.uint64(3)] >> (np.uint64(7) - (where & np.uint64(7))).astype(np.uint8)) & 1
    return pa.array(hit.all(axis=1))


def with_test(df: DataFrame, column: str, bits: np.ndarray, size: int, name: str = "possible") -> DataFrame:
    """``df`` and whether the filter may hold the hash in ``column``."""
    sent = df.sparkSession.sparkContext.broadcast(bits)
    at = df.columns.index(column)
    schema = df.select("*", F.lit(True).alias(name)).schema

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            hit = tested(batch.column(at), own, size)
            yield pa.RecordBatch.from_arrays([*batch.columns, hit], names=[*batch.schema.names, name])

    return df.mapInArrow(test, schema)
