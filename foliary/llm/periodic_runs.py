"""Periodic runs of words: stretches in which a short passage follows itself again and again.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) that
is at least ``min_length`` words and ``repeats`` periods long and that no neighbouring word extends.

Method: maximal pairs.  Two places ``i < j`` with equal words ahead, ``l`` of them, are a maximal pair if the
words before them differ and the words after the equal ones differ.  Then the words from ``i`` to ``j + l``
have period ``j - i``, and neither side can be extended.  So the maximal pairs with
``l >= (repeats - 1) * (j - i)`` and ``j - i + l >= min_length`` are the runs; a run of period q is
also found with 2q, 3q, ...: of pairs with the same stretch the smallest distance is kept.

Pairs are read off the tree of LCP intervals, bottom up.  A node keeps its places in order, as a whole and in one list for
each word that stands before them.  When two children meet at depth ``l``, each place of the smaller one looks for
places of the larger one within ``l / (repeats - 1)``.  Places so near to each other share a
period, so all of them but the first have the same word before them: on either side at most one
list holds partners.  The lists are merged small into large, hence near-linear work.

The tree is built of places only that can be in such a pair: those whose first ``seed`` words occur
again in the same text (found by a hash, then compared exactly), and whose nearest such place
is near enough for their longest match.  Suffixes are sorted by prefix doubling, in
numpy, for all texts of a slice at once; a text is one unit, so memory follows the longest text.

Defined cases: a null or empty text, or one of white space, has no words and no runs; rows that repeat an id are rows of
their own; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import byte_texts, mixed64, slices

SLICE = 1 << 20  # bytes of text worked on at once
NOTHING_BEFORE = -1
Run = tuple[int, int, int]  # start, length, period


def seed_length(min_length: int, repeats: int) -> int:
    """Equal words that both places of any pair share."""
    return min(max(min_length - q, (repeats - 1) * q) for q in range(1, min_length + 1))


class Texts:
    """Word numbers of several texts in one array, a number of its own after each text."""

    def __init__(self, texts: list[list[bytes]]):
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ids = np.empty(int(lengths.sum()) + len(texts), np.int64)
        for start, n, words in zip(self.starts, lengths, texts):
            self.ids[start : start + n] = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
        self.ids[self.starts + lengths] = len(numbers) + np.arange(len(texts))
        self.owner = np.repeat(np.arange(len(texts)), lengths + 1)
        self.lengths = lengths


def repeated_places(texts: Texts, seed: int) -> np.ndarray:
    """Places whose first ``seed`` words may occur again in their text."""
    n = len(texts.ids) - seed + 1
    if n < 2:
        return np.empty(0, np.int64)
    total = mixed64(texts.owner[:n] + 1)
    for k in range(seed):
        total = mixed64(total + texts.ids[k : k + n].astype(np.uint64) + np.uint64(1))
    order = np.argsort(total)
    same = total[order[1:]] == total[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def sorted_suffixes(texts: Texts, places: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in an order in which equal beginnings stand together, and how many words each shares with the one before.

    Less than ``seed`` shared words count as none.
    """
    ids, n = texts.ids, len(texts.ids)
    columns = [ids[places + k] for k in range(seed - 1, -1, -1)] + [texts.owner[places]]
    order = np.lexsort(columns)
    suffixes = places[order]
    new = np.ones(len(places), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    # the rank of a place is where its group begins; places that are not sorted have ranks of their own
    rank = len(places) + np.arange(n, dtype=np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
    rank[suffixes] = group
    ranks, width = [rank], seed
    while True:
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, len(places)])
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(open_):
            break
        u = suffixes[open_]
        # an open place shares `width` words of its text with another, so this is at most the end of the text
        further = u + width
        ahead = rank[further]
        # places that are not sorted are in the order of their words among the others
        words = [ids[np.minimum(further + k, n - 1)] for k in range(seed - 1, -1, -1)]
        order = np.lexsort((ahead, *words, rank[u]))
        u, ahead, own = u[order], ahead[order], rank[u][order]
        suffixes[open_] = u
        split = np.ones(len(u), bool)
        split[1:] = (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])
        new[open_] = split
        group = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        rank = rank.copy()
        rank[suffixes] = group
        ranks.append(rank)
        width *= 2
    return suffixes, shared_words(ids, suffixes, ranks, seed)


def shared_words(ids: np.ndarray, suffixes: np.ndarray, ranks: list[np.ndarray], seed: int) -> np.ndarray:
    """Words each suffix shares with the one before, by descending widths."""
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    begun = ranks[0][a] == ranks[0][b]
    shared = np.zeros(len(suffixes), np.int64)
    at = np.flatnonzero(begun)
    a, b, total = a[at], b[at], np.zeros(len(at), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        equal = ranks[k][a + total] == ranks[k][b + total]
        total += equal * (seed << k)
    going = np.ones(len(at), bool)
    for _ in range(seed - 1):
        going &= ids[a + total] == ids[b + total]
        total += going
    shared[at + 1] = total
    return shared


def near_places(suffixes: np.ndarray, shared: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Only the places whose nearest fellow is near enough for their longest match."""
    group = np.cumsum(shared == 0)
    order = np.lexsort((suffixes, group))
    step = np.diff(suffixes[order])
    step = np.where(np.diff(group[order]) == 0, step, np.iinfo(np.int64).max // repeats)
    far = np.iinfo(np.int64).max // repeats
    nearest = np.empty(len(suffixes), np.int64)
    nearest[order] = np.minimum(np.r_[far, step], np.r_[step, far])
    longest = np.maximum(shared, np.r_[shared[1:], 0])
    keep = np.flatnonzero(nearest * (repeats - 1) <= longest)
    if not len(keep):
        return suffixes[:0], shared[:0]
    # what a place shares with the last one kept is the least of what lies between
    bounds = np.r_[0, keep[:-1] + 1]
    between = np.minimum.reduceat(shared[: keep[-1] + 1], bounds)
    between[0] = 0
    return suffixes[keep], between


class Places:
    """Places below a node: in order, and in order for each word before them."""

    __slots__ = ("all", "before")

    def __init__(self, place: int, word: int):
        self.all = [place]
        self.before = {word: [place]}


def maximal_pairs(
    suffixes: list[int], shared: list[int], word_before: dict[int, int], min_length: int, repeats: int
) -> Iterator[tuple[int, int, int]]:
    """``i, j, l`` of the maximal pairs near enough to be runs."""

    def meet(a: Places, b: Places, depth: int) -> Places:
        large, small = (a, b) if len(a.all) >= len(b.all) else (b, a)
        reach, least = depth // (repeats - 1), max(1, min_length - depth)
        places = large.all
        for p in small.all:
            word = word_before[p]
            at = bisect_left(places, p)
            if at and p - places[at - 1] <= reach:
                other = word_before[places[bisect_left(places, p - reach)]]
                if other != word:
                    fellows = large.before[other]
                    for i in fellows[bisect_left(fellows, p - reach) : bisect_right(fellows, p - least)]:
                        pairs.append((i, p, depth))
            if at < len(places) and places[at] - p <= reach:
                other = word_before[places[at]]
                if other != word:
                    fellows = large.before[other]
                    for j in fellows[bisect_left(fellows, p + least) : bisect_right(fellows, p + reach)]:
                        pairs.append((p, j, depth))
        for p in small.all:
            insort(places, p)
        for word, fellows in small.before.items():
            own = large.before.setdefault(word, [])
            for p in fellows:
                insort(own, p)
        return large

    pairs: list[tuple[int, int, int]] = []
    open_nodes: list[tuple[int, Places]] = []
    done = None
    for place, depth in zip([*suffixes, None], [*shared, 0]):
        if done is not None:
            while open_nodes and open_nodes[-1][0] > depth:
                below, node = open_nodes.pop()
                done = meet(node, done, below)
            if depth:
                if open_nodes and open_nodes[-1][0] == depth:
                    done = meet(open_nodes.pop()[1], done, depth)
                open_nodes.append((depth, done))
            yield from pairs
            pairs.clear()
        if place is not None:
            done = Places(place, word_before[place])


def runs_of(texts: list[list[bytes]], min_length: int = 6, repeats: int = 4) -> list[list[Run]]:
    """The runs of each text, by start, then period."""
    if repeats < 3 or min_length < 1:
        raise ValueError("runs repeat at least three times")
    found: list[list[Run]] = [[] for _ in texts]
    if not texts:
        return found
    made, seed = Texts(texts), seed_length(min_length, repeats)
    places = repeated_places(made, seed)
    if not len(places):
        return found
    suffixes, shared = near_places(*sorted_suffixes(made, places, seed), repeats)
    if not len(suffixes):
        return found
    first = made.starts[made.owner[suffixes]] == suffixes
    before = np.where(first, NOTHING_BEFORE, made.ids[suffixes - 1])
    word_before = dict(zip(suffixes.tolist(), before.tolist()))
    stretches: dict[tuple[int, int], int] = {}
    for i, j, equal in maximal_pairs(suffixes.tolist(), shared.tolist(), word_before, min_length, repeats):
        stretch = i, j + equal
        stretches[stretch] = min(stretches.get(stretch, j - i), j - i)
    for (start, end), period in stretches.items():
        text = int(made.owner[start])
        found[text].append((start - int(made.starts[text]), end - start, period))
    for runs in found:
        runs.sort(key=lambda run: (run[0], run[2]))
    return found


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length over period; the first, then the shortest period, of equals."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but those that a run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a repeated stretch in one document of ten, chosen by its id: a stated change of the input
    that gives the runs of the registered query something to find."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


Change = Callable[[int | None, list[bytes]], list[bytes]]


def _per_text(df: DataFrame, id_col: str, text_col: str, schema: str, row: Callable, change: Change | None, limits: tuple[int, int]) -> DataFrame:
    """``row(doc_id, words, runs)`` of each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids = part.column(0).to_pylist()
                texts = [text.split() for text in byte_texts(part.column(1))]
                if change:
                    texts = [change(i, words) for i, words in zip(ids, texts)]
                rows = [row(*x) for x in zip(ids, texts, runs_of(texts, *limits))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    narrow = df.select(df[f"`{id_col}`"].cast("long").alias("doc_id"), df[f"`{text_col}`"].alias("text"))
    return narrow.mapInArrow(run, schema)


def collapsed_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, repeats: int = 4
) -> DataFrame:
    """``doc_id, runs, text``: the runs of each row, and its words with each run cut to one period."""
    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string"

    def row(doc_id, words, runs):
        named = [dict(zip(("start", "length", "period"), r)) for r in runs]
        return doc_id, named, b" ".join(collapsed(words, runs)).decode("utf-8", "replace")

    return _per_text(df, id_col, text_col, schema, row, None, (min_length, repeats))


def summaries(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 6,
    repeats: int = 4,
    change: Change | None = None,
) -> DataFrame:
    """One row per row: number of runs, the strongest run, digests of all runs and of the collapsed text.

    ``change`` may give other words for those of a text.
    """
    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )

    def row(doc_id, words, runs):
        best = strongest(runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
        return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests

    return _per_text(df, id_col, text_col, schema, row, change, (min_length, repeats))
