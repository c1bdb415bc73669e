"""Alignment of two tokenizations of the same text.

Tokenizer A is byte-level BPE, tokenizer B a sentence-piece model with byte fallback that puts a space before the
text.  Both encode space + text, so their tokens cover the same bytes.  The cumulative ends of A's
tokens and those of B's are dictionaries from end to index; the sorted keys they share cut both id lists into
groups, and in each slice the tokens that end together are linked (one of each side, since no
token is empty).

Texts repeat their words, so they are aligned in parts that are remembered.  A part ends where a match of A's
splitting pattern ends, hence one of its tokens does, unless the two characters there stand side by side in
some piece of B: if they do not, no token of B covers both.  So the end of a part is a common end, and the groups of a
text are those of its parts one after the other.

How often a pair of ids is linked is counted over the corpus.  Texts are gathered in blocks of
``BLOCK`` bytes; a block adds its pairs up, so a frequent pair is one row per block.  The corpus counts come back to a block
as one row per pair of its own, and meet its documents there.

Defined cases: a null or empty text, or one whose tokens do not give its bytes again, has no tokens: zeros and an empty
string for the digest.  Special strings are ordinary text.  Rows that repeat an id are rows of their own; an empty
table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import byte_bpe
from foliary.llm.common import byte_texts, slices, stored

SPACE = "▁"
LINE_BREAK = "\n"
KNOWN_PARTS = 150_000
LONG_PART = 64
MISSING = ("missing",)
BLOCK = 4 << 20
B_BITS = 32
Group = tuple[list[int], list[int]]


def aligned(a_ids: list[int], a_sizes: list[int], b_ids: list[int], b_sizes: list[int]) -> list[Group]:
    """The groups of two id lists over the same bytes; the last ids of a group are linked."""
    a_ends = dict(zip(accumulate(a_sizes), range(1, len(a_ids) + 1)))
    b_ends = dict(zip(accumulate(b_sizes), range(1, len(b_ids) + 1)))
    groups, a, b = [], 0, 0
    for end in sorted(a_ends.keys() & b_ends):
        i, j = a_ends[end], b_ends[end]
        groups.append((a_ids[a:i], b_ids[b:j]))
        a, b = i, j
    return groups


class PieceModel:
    """The sentence-piece model: ids and bytes of a part of a text, and where no token of it can end."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in zip(ids, pieces)]
        plain = [p.replace(SPACE, " ") for i, p in zip(ids, pieces) if not (self.model.is_byte(i) or self.model.is_control(i))]
        # pairs of characters that a token may cover; a space is also what stands for it
        self.joined = {x + y for p in plain for x, y in zip(p, p[1:])}
        self.joined |= {pair.replace(" ", SPACE) for pair in self.joined}
        self.space = self.model.piece_to_id(SPACE)
        # a line break is a byte that joins nothing: what follows it is encoded without the model's own space
        self.lead = self.model.encode(LINE_BREAK)
        if any(LINE_BREAK in p for p in plain) or len(self.lead) != 2 or self.model.decode(self.model.encode("a  b ")) != "a  b ":
            raise ValueError(f"{path} changes white space or joins line breaks")

    def __call__(self, part: str) -> list[int]:
        if part[0] == " ":
            # the model puts a space before any text that is not empty
            return self.model.encode(part[1:]) if len(part) > 1 else [self.space]
        return self.model.encode(LINE_BREAK + part)[2:]


Part = str | tuple[str, ...]  # a match of A's pattern, or several that B may join


class Aligner:
    """Groups of the parts of a text; None where the tokens do not give the bytes again."""

    def __init__(self, vocabulary: str, pattern: str, model: str):
        encode = byte_bpe.encoder(vocabulary, pattern)
        self.matches, self.ids_of = encode.matches, encode.encode
        self.a_bytes = byte_bpe.token_bytes(vocabulary)
        self.a_sizes = list(map(len, self.a_bytes))
        self.piece_model = PieceModel(model)
        self.b_sizes = list(map(len, self.piece_model.bytes))
        self.known: dict[Part, tuple | None] = {}
        self.older: dict[Part, tuple | None] = {}

    def parts(self, text: str) -> list[Part]:
        """Space + text in parts."""
        matches, joined = self.matches(" " + text), self.piece_model.joined
        inner = [x[-1] + y[0] in joined for x, y in pairwise(matches)]
        if True not in inner:
            return matches
        out, several = [], [matches[0]]
        for match, within in zip(matches[1:], inner):
            if not within:
                out.append(several[0] if len(several) == 1 else tuple(several))
                several = []
            several.append(match)
        return [*out, several[0] if len(several) == 1 else tuple(several)]

    def groups(self, part: Part) -> list[Group] | None:
        if isinstance(part, str):
            a, whole = self.ids_of(part), part
        else:
            a, whole = list(chain.from_iterable(map(self.ids_of, part))), "".join(part)
        b, raw = self.piece_model(whole), whole.encode()
        if b"".join([self.piece_model.bytes[i] for i in b]) != raw or b"".join([self.a_bytes[i] for i in a]) != raw:
            return None
        return aligned(a, [self.a_sizes[i] for i in a], b, [self.b_sizes[i] for i in b])

    def look_up(self, parts: list[Part], made: Callable) -> list:
        """``made(groups)`` of each part (None for no groups).

        Parts used lately are remembered: a full memory becomes the older one, and what is asked for again moves back."""
        new = set(parts).difference(self.known)
        if len(self.known) + len(new) > KNOWN_PARTS:
            self.older, self.known = self.known, {}
            new = set(parts)
        for part in new:
            found = self.older.get(part, MISSING)
            if found is MISSING:
                groups = self.groups(part)
                found = None if groups is None else made(groups)
            self.known[part] = found
        out = list(map(self.known.__getitem__, parts))
        for part in new:
            if len(part) > LONG_PART:
                del self.known[part]
        return out


def _listed(ids: list[int]) -> str:
    return str(ids[0]) if len(ids) == 1 else ",".join(map(str, ids))


def _digest_parts(groups: list[Group]) -> tuple[int, int, int, bytes, bytes]:
    """Numbers of ids and groups, the groups as text, and the links as 64-bit numbers."""
    listed = ";".join([f"{_listed(a)}|{_listed(b)}" for a, b in groups]).encode()
    links = array("q", [(a[-1] << B_BITS) | b[-1] for a, b in groups]).tobytes()
    return sum([len(a) for a, _ in groups]), sum([len(b) for _, b in groups]), len(groups), listed, links


def groups_of_texts(
    df: DataFrame, vocabulary: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, groups``: of each row the ids of A and of B in each group, with the byte where it ends (space + text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(vocabulary, pattern, model)
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for raw in byte_texts(part.column(1)):
                    parts = align.look_up(align.parts(raw.decode("utf-8", "replace")), list) if raw else []
                    whole = [] if None in parts else list(chain.from_iterable(parts))
                    ends = accumulate(sum(len(align.a_bytes[i]) for i in a) for a, _ in whole)
                    out.append([{"a": a, "b": b, "end": end} for (a, b), end in zip(whole, ends)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["doc_id", "groups"])

    ints = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("a", ints), ("b", ints), ("end", pa.int64())]))
    narrow = df.select(df[f"`{id_col}`"].cast("long").alias("doc_id"), df[f"`{text_col}`"].alias("text"))
    return narrow.mapInArrow(run, "doc_id long, groups array<struct<a:array<int>,b:array<int>,end:long>>")


SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _gathered(df: DataFrame, vocabulary: str, pattern: str, model: str, id_col: str, text_col: str) -> DataFrame:
    """A row per row with its block and the pairs it links, and a row per block with the pairs of the block (``whole_block``)."""
    names = [*(x.split()[0] for x in SUMMARY.split(", ")), "block", "whole_block", "pairs", "counts"]

    def lists(rows: list[np.ndarray], kind) -> pa.Array:
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows]), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(vocabulary, pattern, model)
        # a repeated task gets the same rows, and the stored result of one attempt only is read
        block, filled, total = TaskContext.get().partitionId() << 32, 0, {}

        def block_row() -> pa.RecordBatch:
            pairs = np.fromiter(total, np.int64, len(total))
            counts = np.fromiter(total.values(), np.int64, len(total))
            zero = [pa.array([None], pa.int64())] + [pa.array([0], pa.int64())] * 4 + [pa.array([""])]
            last = [pa.array([block]), pa.array([True]), lists([pairs], pa.int64()), lists([counts], pa.int64())]
            return pa.RecordBatch.from_arrays([*zero, *last], names=names)

        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                if filled >= BLOCK:
                    yield block_row()
                    block, filled, total = block + 1, 0, {}
                rows, pairs, counts = [], [], []
                for raw in byte_texts(part.column(1)):
                    filled += len(raw)
                    found = align.look_up(align.parts(raw.decode("utf-8", "replace")), _digest_parts) if raw else []
                    if None in found:
                        found = []
                    a, b, n, listed, links = zip(*found) if found else ((),) * 5
                    linked, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
                    digest = hashlib.sha256(b";".join(listed)).hexdigest() if found else ""
                    rows.append((sum(a), sum(b), sum(n), int(times.sum()), digest))
                    pairs.append(linked)
                    counts.append(times)
                    for pair, k in zip(linked.tolist(), times.tolist()):
                        total[pair] = total.get(pair, 0) + k
                columns = [pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*rows))]
                own = [pa.array([block] * len(rows)), pa.array([False] * len(rows))]
                both = [lists(pairs, pa.int64()), lists(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *own, *both], names=names)
        yield block_row()

    narrow = df.select(df[f"`{id_col}`"].cast("long").alias("doc_id"), df[f"`{text_col}`"].alias("text"))
    schema = f"{SUMMARY}, block long, whole_block boolean, pairs array<long>, counts array<long>"
    return stored(narrow.mapInArrow(run, schema), "alignments")


def _pairs_of_blocks(gathered: DataFrame) -> DataFrame:
    each = F.explode(F.arrays_zip("pairs", "counts")).alias("x")
    return gathered.where("whole_block").select("block", each).select("block", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def _corpus_counts(block_pairs: DataFrame) -> DataFrame:
    """``pair, times, best``: links of each id pair in the corpus, and whether its B id has no pair with more."""
    counts = block_pairs.groupBy("pair").agg(F.sum("n").alias("times"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)))
    most = counts.groupBy("b").agg(F.max("times").alias("most"))
    return counts.join(most, "b").select("pair", "times", (F.col("times") == F.col("most")).alias("best"))


def pair_counts(df: DataFrame, vocabulary: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b, times, best`` of all id pairs that are linked somewhere."""
    found = _corpus_counts(_pairs_of_blocks(_gathered(df, vocabulary, pattern, model, id_col, text_col)))
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).cast("int").alias("b")
    return found.select(F.shiftright("pair", B_BITS).cast("int").alias("a"), b, "times", "best")


def summaries(
    df: DataFrame, vocabulary: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row: tokens of A and B, groups, links, links that are the best of their B id, the sum of the
    corpus counts of the links, and a digest of the groups."""
    gathered = _gathered(df, vocabulary, pattern, model, id_col, text_col)
    block_pairs = _pairs_of_blocks(gathered)
    known = block_pairs.join(_corpus_counts(block_pairs), "pair").select(F.col("block").alias("of"), "pair", "times", "best")
    schema = f"{SUMMARY}, n_best long, count_sum long"

    def met(documents: pa.Table, counts: pa.Table) -> pa.Table:
        """The documents of one block and the corpus counts of its pairs."""
        order = np.argsort(counts["pair"].to_numpy())
        pair, times = counts["pair"].to_numpy()[order], counts["times"].to_numpy()[order]
        best = counts["best"].to_numpy()[order]
        n_best, count_sum = [], []
        for pairs, n in zip(documents["pairs"], documents["counts"]):
            at = np.searchsorted(pair, pairs.values.to_numpy())
            n = n.values.to_numpy()
            n_best.append(int(n[best[at]].sum()) if len(at) else 0)
            count_sum.append(int((n * times[at]).sum()) if len(at) else 0)
        kept = documents.select([x.split()[0] for x in SUMMARY.split(", ")])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    rows = gathered.where("not whole_block").drop("whole_block")
    return rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(met, schema)
