"""Packed token-id matrices.

Documents are encoded (byte-level BPE, an end token after each), and cut into segments of at
most ``width`` tokens, losslessly and in order.  Segments are packed into rows of ``width``
by best-fit-decreasing: from the longest to the shortest, each goes to the row with the least room
that still takes it.  A segment tree over the possible amounts of room finds that row
in about ``log2(width)`` steps.

Packing is local to blocks of ``block`` tokens inside a task, so nothing shuffles, memory
is bounded and each block loses at most its last few rows' padding.  Rows are

* ``ids``: ``width`` token ids, padded at the end,
* ``lengths``: cumulative segment lengths, beginning with 0, the last is the tokens used,
* ``resets``: where positions start again at 0 (the start of each segment),
* ``doc_ids``, ``segments``: the document of each segment and its number there, from 0.

``positions`` gives the position of each token in its segment, from ``lengths``.

Defined cases: a null or empty text is a document of the end token alone.  Equal lengths are
packed in the order of the rows, so a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.byte_bpe import int_lists, rank_encoder
from foliary.llm.common import byte_texts, slices


class RoomTree:
    """How many open rows have a given room; finds the least room of at least a size."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.counts[i] += n
            i >>= 1

    def least(self, size: int) -> int | None:
        i = size + self.leaves
        if self.counts[i]:
            return size
        while i > 1:
            # climb until a right sibling has rows, then go down to its first
            if not i & 1 and self.counts[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.counts[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Rows of indices into ``sizes`` (each between 1 and ``width``)."""
    rows: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    tree = RoomTree(width)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        room = tree.least(size)
        if room is None:
            row, room = len(rows), width
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        if room > size:
            by_room.setdefault(room - size, []).append(row)
            tree.add(room - size, 1)
    return rows


def packed_block(docs: list[tuple[int, np.ndarray]], width: int, pad: int) -> dict[str, list]:
    segments = [
        (doc_id, n, ids[start : start + width])
        for doc_id, ids in docs
        for n, start in enumerate(range(0, len(ids), width))
    ]
    out: dict[str, list] = {k: [] for k in ("ids", "lengths", "resets", "doc_ids", "segments")}
    for row in best_fit_decreasing([len(s[2]) for s in segments], width):
        own = [segments[i] for i in row]
        lengths = np.cumsum([0, *(len(s[2]) for s in own)])
        ids = np.full(width, pad, np.int32)
        ids[: lengths[-1]] = np.concatenate([s[2] for s in own])
        out["ids"].append(ids)
        out["lengths"].append(lengths)
        out["resets"].append(lengths[:-1])
        out["doc_ids"].append([s[0] for s in own])
        out["segments"].append(np.array([s[1] for s in own]))
    return out


SCHEMA = (
    "pack_id string, ids array<int>, lengths array<int>, resets array<int>, doc_ids array<long>, segments array<int>"
)


def packed(
    df: DataFrame,
    ranks: str,
    pattern: str,
    width: int = 2048,
    end_id: int = 50256,
    block: int = 1 << 22,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packed rows of all documents; see the module.  ``pack_id`` is partition, block and row."""
    if width < 1:
        raise ValueError("width must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = rank_encoder(ranks, pattern)
        part, number = TaskContext.get().partitionId(), 0
        docs: list[tuple[int, np.ndarray]] = []
        held = 0
        end = np.array([end_id], "<i4").tobytes()

        def flush() -> pa.RecordBatch:
            made = packed_block(docs, width, end_id)
            names = [f"{part}-{number}-{i}" for i in range(len(made["ids"]))]
            columns = [int_lists(made[k]) for k in ("ids", "lengths", "resets")]
            return pa.RecordBatch.from_arrays(
                [pa.array(names), *columns, pa.array(made["doc_ids"], pa.list_(pa.int64())), int_lists(made["segments"])],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

        for batch in batches:
            for piece in slices(batch, 1):
                for doc_id, text in zip(piece.column(0).to_pylist(), byte_texts(piece.column(1))):
                    ids = np.frombuffer(encode(text.decode("utf-8", "replace")) + end, "<i4")
                    docs.append((doc_id, ids))
                    held += len(ids)
                    if held >= block:
                        yield flush()
                        docs, held, number = [], 0, number + 1
        if docs:
            yield flush()

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def positions(lengths: list[int] | np.ndarray) -> np.ndarray:
    """Position of each token in its segment."""
    sizes = np.diff(lengths)
    return np.arange(lengths[-1]) - np.repeat(np.asarray(lengths)[:-1], sizes)
