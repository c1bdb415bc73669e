"""Byte-level BPE: encoding with offsets, and decoding.

The vocabulary is a ``tokenizers`` file, checked against a rank file: both must give
each id the same bytes.  In the file a byte is written as a printable character; ``byte_of_character``
is that table reversed, and ``token_bytes`` has the bytes of each id.

Words repeat, so a text is cut into pieces at places where tokens always end; each distinct
piece is split by the pattern and each distinct match encoded once, and then looked up.  Tokens never run from
a character that is not white space into one that is (the splitting pattern has no such match),
so before each space that follows such a character a piece may begin, and what
comes before or after does not change its tokens.  ``PIECE`` cuts there only; Python's white
space includes that of the pattern, so a doubtful place is no cut.

Offsets are code points: a token covers the characters that any of its bytes belong to.  A
character whose bytes are split over tokens lies in all of them.  Decoding joins bytes; in a stream
of tokens ``decoded_parts`` holds back the bytes of a character that is not complete yet.

Defined cases: a null or empty text has no tokens; decoding no tokens gives an empty text; ids
outside the vocabulary raise an error.  Special strings are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import byte_texts, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KNOWN_PIECES = 400_000
KNOWN_WORDS = 300_000
LONG_PIECE = 64  # characters; longer pieces are encoded each time and not kept
# a space after any white space is no plain cut
DOUBTFUL = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
DOUBTFUL_ASCII = [d for d in DOUBTFUL if d.isascii()]
PIECE = re.compile(r"\s*\S+(?:[^\S\t-\r ]\s*(?:\S+|$))*|\s+")


def pieces_of(text: str) -> list[str]:
    """The text in pieces that can be encoded alone."""
    if any(d in text for d in (DOUBTFUL_ASCII if text.isascii() else DOUBTFUL)):
        return PIECE.findall(text)
    first, *rest = text.split(" ")
    pieces = [" " + x for x in rest]
    return [first, *pieces] if first else pieces


class PieceEncoder:
    """Encodes texts piece by piece; a result is the ids as little-endian 32-bit numbers.

    ``encode`` takes one match of the splitting pattern, or a piece if it splits by itself.  Pieces and matches seen before
    are looked up; either memory is emptied when it is full.
    """

    def __init__(self, encode: Callable[[str], list[int]], pattern: str | None):
        self.encode = encode
        self.matches = regex.compile(pattern).findall if pattern else None
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = array("i", self.encode(word)).tobytes()
            if len(word) <= LONG_PIECE:
                if len(self.words) >= KNOWN_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        pieces = pieces_of(text)
        new = set(pieces).difference(self.pieces)
        if len(self.pieces) + len(new) > KNOWN_PIECES:
            self.pieces.clear()
            new = set(pieces)
        for piece in new:
            if self.matches:
                self.pieces[piece] = b"".join(map(self.word, self.matches(piece)))
            else:
                self.pieces[piece] = array("i", self.encode(piece)).tobytes()
        ids = b"".join(map(self.pieces.__getitem__, pieces))
        for piece in new:
            if len(piece) > LONG_PIECE:
                del self.pieces[piece]
        return ids


def byte_of_character() -> dict[str, int]:
    """Printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str, ranks: str | None = None) -> list[bytes]:
    """The bytes of each id, special tokens left out."""
    from tokenizers import Tokenizer

    table = byte_of_character()
    own = Tokenizer.from_file(vocabulary)
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    by_id = {
        i: bytes(table[c] for c in token) for token, i in own.get_vocab(with_added_tokens=True).items() if token not in special
    }
    if ranks:
        with open(ranks, "rb") as lines:
            wanted = {int(i): base64.b64decode(token) for token, i in map(bytes.split, lines)}
        if wanted != by_id:
            raise ValueError(f"{ranks} and {vocabulary} differ")
    return [by_id[i] for i in range(len(by_id))]


def encoder(vocabulary: str, pattern: str) -> PieceEncoder:
    """By the library's BPE model, on the printable characters of the bytes."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary).model
    character = {b: c for c, b in byte_of_character().items()}
    return PieceEncoder(
        lambda word: [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(character))], pattern
    )


def rank_encoder(ranks: str, pattern: str) -> Callable[[str], bytes]:
    """The same encoding by the rank file alone.  The library splits whole texts itself: on the test table that takes
    somewhat less time than to look up their pieces here."""
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}
    own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return lambda text: own.encode_to_numpy(text, disallowed_special=()).astype("<i4").tobytes()


def int_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.empty(0)
    if ends[-1] < 1 << 31:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
    raise ValueError("more than 2**31 tokens in one slice")


def offsets_of(text: bytes, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last."""
    ends = np.cumsum(sizes[ids])
    character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    return character[ends - sizes[ids]], character[ends - 1] + 1


def encoded(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_offsets: bool = False,
) -> DataFrame:
    """``doc_id, ids`` of each row, and with offsets ``starts, ends``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern)
        sizes = np.array([len(t) for t in token_bytes(vocabulary, ranks)])
        for batch in batches:
            for part in slices(batch, 1):
                out: list[list[np.ndarray]] = [[], [], []]
                for text in byte_texts(part.column(1)):
                    ids = np.frombuffer(encode(text.decode("utf-8", "replace")), "<i4")
                    spans = offsets_of(text, ids, sizes) if with_offsets else ()
                    for column, value in zip(out, (ids, *spans)):
                        column.append(value)
                columns = out if with_offsets else out[:1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(int_lists, columns)], names=["doc_id", "ids", "starts", "ends"][: len(columns) + 1]
                )

    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, schema)


def decoded_parts(tokens: Iterable[bytes]) -> Iterator[str]:
    """The text that each token completes; bytes of an unfinished character wait for the next."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for token in tokens:
        yield decoder.decode(token)
    yield decoder.decode(b"", final=True)


def with_decoded(df: DataFrame, vocabulary: str, ranks: str | None = None) -> DataFrame:
    """``df`` (with ``ids``) and the bytes its ids stand for, ``decoded``."""
    at = df.columns.index("ids")
    schema = df.select("*", F.lit(b"").cast("binary").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocabulary, ranks)
        for batch in batches:
            ids = batch.column(at)
            if (pc.min(ids.flatten()).as_py() or 0) < 0:
                raise ValueError("negative token id")
            out = [b"".join(map(table.__getitem__, row.values.to_numpy().tolist())) if row.is_valid else b"" for row in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def ids_as_text(ids: Column) -> Column:
    """Decimal ids with a space between."""
    return F.array_join(ids.cast("array<string>"), " ")


def token_rows(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple = (),
) -> DataFrame:
    """One row per row: ``doc_id``, the columns of ``keep``, ``ids``, ``n_tokens``, and whether the decoded
    ids give the text again, ``round_trip``."""
    kept = [df[f"`{name}`"] for name in keep]
    schema = df.select(
        df[f"`{id_col}`"].cast("long").alias("doc_id"),
        *kept,
        F.array(F.lit(0)).alias("ids"),
        F.lit(0).cast("long").alias("n_tokens"),
        F.lit(True).alias("round_trip"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern)
        table = token_bytes(vocabulary, ranks)
        for batch in batches:
            for part in slices(batch, part_at):
                ids, same = [], []
                for text in byte_texts(part.column(part_at)):
                    ids.append(np.frombuffer(encode(text.decode("utf-8", "replace")), "<i4"))
                    same.append(b"".join(map(table.__getitem__, ids[-1].tolist())) == text)
                counts = pa.array([len(i) for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:part_at], int_lists(ids), counts, pa.array(same, pa.bool_())],
                    names=schema.fieldNames(),
                )

    part_at = 1 + len(keep)
    rows = df.select(df[f"`{id_col}`"].cast("long").alias("doc_id"), *kept, df[f"`{text_col}`"].alias("text"))
    return rows.mapInArrow(run, schema)
