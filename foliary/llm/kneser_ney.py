"""Character n-gram models with modified Kneser-Ney smoothing.

A text is modelled word by word: the characters of a word and its end, each given the characters
before it in the word.  Characters fold to 32 symbols, so an n-gram is a number of ``5 n`` bits and
a model of order n has at most ``32 ** n`` n-grams, however large the corpus: with order 4 about
a million.  That bounds what is sent to the executors.  Counting is a Spark aggregation over all
documents; a level of a model is a sorted array of hashed n-grams beside their discounted
probabilities, and one of hashed contexts beside their backoff weights, both looked up by binary
search.

The second half of the module models characters as they are: an n-gram is the code points before (``context``,
21 bits each) and the ``symbol``, so nothing bounds a model but the corpus, and it stays a table.  Its
levels are aggregations and joins, and only the discounts (a few numbers per kind and order) come to the driver.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.common import mixed64

BITS, SYMBOLS = 5, 32
# symbols: 0 the end of a word (and what is before it), 1-26 letters, then
DIGIT, JOINER, STOP, OTHER = 27, 28, 29, 30


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point.  A letter beyond a-z counts as the letter that its code
    point gives modulo 26, so that other alphabets are told apart as well."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x80, 0x30000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            table[c] = 1 + c % 26
        elif kind == "N":
            table[c] = DIGIT
    letters = np.arange(26)
    table[ord("a") + letters] = table[ord("A") + letters] = 1 + letters
    table[ord("0") : ord("9") + 1] = DIGIT
    table[[ord(c) for c in "'-_"]] = JOINER
    table[[ord(c) for c in ".,;:!?"]] = STOP
    return table


def windows(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of each word and at its end (newest symbol in the
    lowest bits, symbols before the word are 0), and where each word starts."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text = b"\n".join(words).decode("utf-8", "replace") + "\n"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    ends = points == 10
    symbols = np.where(ends, np.uint8(0), symbol_table()[points]).astype(np.uint64)
    starts = np.r_[0, np.flatnonzero(ends)[:-1] + 1]
    at = np.arange(len(points)) - np.repeat(starts, np.diff(np.r_[starts, len(points)]))
    code = symbols.copy()
    for j in range(1, order):
        older = np.zeros_like(symbols)
        older[j:] = symbols[:-j]
        code |= np.where(at >= j, older, np.uint64(0)) << np.uint64(BITS * j)
    return code, starts


def gram_counts(words: Counter, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of counted words and how often they occur."""
    codes, starts = windows(list(words), order)
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.diff(np.r_[starts, len(codes)]))
    distinct, inverse = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(inverse, weights=times, minlength=len(distinct)).astype(np.int64)


@dataclass
class Level:
    """One order of a model, in sorted hash arrays."""

    order: int
    grams: np.ndarray
    alpha: np.ndarray
    contexts: np.ndarray
    gamma: np.ndarray

    def extend(self, lower: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Probabilities of this order from those of the one below."""
        own = codes & np.uint64((1 << BITS * self.order) - 1)
        at, seen = find(self.grams, hashed(own, self.order))
        alpha = np.where(seen, self.alpha[at], 0.0)
        at, seen = find(self.contexts, hashed(own >> np.uint64(BITS), self.order))
        return alpha + np.where(seen, self.gamma[at], 1.0) * lower


def hashed(codes: np.ndarray, order: int) -> np.ndarray:
    return mixed64(codes | np.uint64(order << 56))


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discount of a count of 0, 1, 2 and 3 or more, from how many n-grams occur 1 to 4 times."""
    return discounts_of([int((counts == i).sum()) for i in range(1, 5)])


def discounts_of(occurring: list[int]) -> np.ndarray:
    """The same from the numbers of n-grams that occur once, twice, 3 and 4 times."""
    n = [max(1, i) for i in occurring]
    y = n[0] / (n[0] + 2 * n[1])
    own = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.1), i * 0.95) for i, d in enumerate(own, 1))])


def level(codes: np.ndarray, counts: np.ndarray, order: int) -> Level:
    """Level of sorted n-grams with their counts."""
    d = discounts(counts)[np.minimum(counts, 3)]
    contexts = codes >> np.uint64(BITS)
    first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]][: len(codes)])
    if not len(codes):
        none, zero = np.empty(0, np.uint64), np.empty(0)
        return Level(order, none, zero, none, zero)
    total = np.add.reduceat(counts, first)
    gamma = np.add.reduceat(d, first) / total
    alpha = (counts - d) / np.repeat(total, np.diff(np.r_[first, len(codes)]))
    grams, context = hashed(codes, order), hashed(contexts[first], order)
    a, b = np.argsort(grams), np.argsort(context)
    return Level(order, grams[a], alpha[a].astype(np.float32), context[b], gamma[b].astype(np.float32))


def suffixes(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the order below, and how many different symbols precede each."""
    return np.unique(codes & np.uint64((1 << BITS * (order - 1)) - 1), return_counts=True)


class Model:
    """Levels from order 1 up; each interpolates with the one below."""

    def __init__(self, levels: list[Level]):
        self.levels = levels
        self.order = max([1, *(one.order for one in levels)])

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray, order: int) -> Model:
        """From all n-grams of the highest order, sorted, and their counts."""
        levels = []
        for k in range(order, 0, -1):
            levels.append(level(codes, counts, k))
            if k > 1:
                codes, counts = suffixes(codes, k)
        return cls(levels[::-1])

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1 / SYMBOLS)
        for one in self.levels:
            p = one.extend(p, codes)
        return p

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of the probability of each word with its end."""
        codes, starts = windows(words, self.order)
        return np.add.reduceat(np.log(self.probabilities(codes)), starts) if words else np.empty(0)


class GramCounter:
    """Counts words by kind inside a task and turns them into n-gram rows.

    Words are counted first: each distinct one is cut into n-grams once.  The memory is
    emptied into rows when ``most`` distinct words are held.
    """

    SCHEMA = "kind string, code long, n long"

    def __init__(self, orders: dict[str, int], most: int = 200_000):
        self.orders, self.most = orders, most
        self.words: dict[str, Counter] = {kind: Counter() for kind in orders}

    def add(self, kind: str, words: list[bytes]) -> None:
        self.words[kind].update(words)

    def full(self) -> bool:
        return sum(map(len, self.words.values())) >= self.most

    def rows(self) -> Iterator[pa.RecordBatch]:
        for kind, words in self.words.items():
            codes, counts = gram_counts(words, self.orders[kind])
            words.clear()
            if len(codes):
                yield pa.record_batch(
                    [pa.array([kind] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(counts)], ["kind", "code", "n"]
                )


def summed(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams and counts of each kind.  The driver gets one row per distinct n-gram, a number
    that the order bounds."""
    table = rows.groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow()
    kinds = np.array(table.column("kind").to_pylist(), dtype=object)
    codes, counts = table.column("code").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    out = {}
    for kind in set(kinds.tolist()):
        own = kinds == kind
        order = np.argsort(codes[own])
        out[kind] = codes[own][order], counts[own][order]
    return out


class Vocabulary:
    """Numbers of words, and a value of each, computed once."""

    def __init__(self, value: Callable[[list[bytes]], np.ndarray], most: int = 150_000):
        self.value, self.most = value, most
        self.number: dict[bytes, int] = {}
        self.values = np.empty(0)

    def prepare(self, texts: Iterable[list[bytes]]) -> None:
        """Make sure that the words of all these texts have a number."""
        words = set().union(*texts)
        new = list(words.difference(self.number))
        if len(self.number) + len(new) > self.most:
            self.number.clear()
            self.values, new = np.empty(0), list(words)
        start = len(self.number)
        self.number.update(zip(new, range(start, start + len(new))))
        self.values = np.r_[self.values, self.value(new)]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


# characters as they are

POINT_BITS, MOST_ORDER = 21, 4
CHARACTERS = 0x110000 + 1  # every code point, and the end of a word


def character_grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of words, sorted: ``context`` (the newest character in the lowest bits) and ``symbol``; then the
    number of the n-gram at each character of each word and at its end, and where each word starts.

    A symbol is the code point plus 1; 0 is the end of a word and what is before it."""
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"a context holds at most {MOST_ORDER - 1} characters")
    if not words:
        none = np.empty(0, np.int64)
        return none, none, none, none
    text = b"\n".join(words).decode("utf-8", "replace") + "\n"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = points == 10
    symbols = np.where(ends, 0, points + 1)
    starts = np.r_[0, np.flatnonzero(ends)[:-1] + 1]
    at = np.arange(len(points)) - np.repeat(starts, np.diff(np.r_[starts, len(points)]))
    contexts = np.zeros_like(symbols)
    for j in range(1, order):
        older = np.zeros_like(symbols)
        older[j:] = symbols[:-j]
        contexts |= np.where(at >= j, older, 0) << (POINT_BITS * (j - 1))
    own, place = np.unique(contexts, return_inverse=True)
    both, number = np.unique(place << POINT_BITS | symbols, return_inverse=True)
    return own[both >> POINT_BITS], both & ((1 << POINT_BITS) - 1), number, starts


def discounts_by_kind(levels: list[DataFrame]) -> list[dict[str, np.ndarray]]:
    """Discounts of each level (``kind, n``) and kind."""
    numbers = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]
    rows = [own.groupBy(F.lit(k).alias("level"), "kind").agg(*numbers) for k, own in enumerate(levels)]
    out: list[dict[str, np.ndarray]] = [{} for _ in levels]
    for k, kind, *n in reduce(DataFrame.unionByName, rows).collect():
        out[k][kind] = discounts_of(n)
    return out


def log_probabilities(grams: DataFrame, order: int) -> DataFrame:
    """``kind, context, symbol, log_p`` of the n-grams ``kind, context, symbol, n`` of the highest order, each given once.

    The n-grams of one context are at most as many as there are characters."""
    levels = [grams]
    for k in range(order - 1, 0, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << POINT_BITS * (k - 1)) - 1).cast("long"))
        levels.append(levels[-1].groupBy("kind", shorter.alias("context"), "symbol").agg(F.count("*").alias("n")))
    levels.reverse()
    same_context = Window.partitionBy("kind", "context")
    found = None
    for k, (own, taken) in enumerate(zip(levels, discounts_by_kind(levels)), 1):
        if not taken:
            return grams.select("kind", "context", "symbol", F.lit(0.0).alias("log_p"))
        entries = ((F.lit(kind), F.array(*[F.lit(float(x)) for x in d[1:]])) for kind, d in sorted(taken.items()))
        discount = F.create_map(*chain.from_iterable(entries))[F.col("kind")][F.least("n", F.lit(3)).cast("int") - 1]
        rows = own.withColumn("d", discount).withColumns(
            {"total": F.sum("n").over(same_context), "free": F.sum("d").over(same_context)}
        )
        lower = F.lit(1 / CHARACTERS)
        if found is not None:
            shorter = F.col("context").bitwiseAND(F.lit((1 << POINT_BITS * (k - 2)) - 1).cast("long"))
            below = found.select("kind", F.col("context").alias("shorter"), "symbol", F.col("p").alias("lower"))
            rows, lower = rows.withColumn("shorter", shorter).join(below, ["kind", "shorter", "symbol"]), F.col("lower")
        p = (F.col("n") - F.col("d") + F.col("free") * lower) / F.col("total")
        found = rows.select("kind", "context", "symbol", p.alias("p"))
    return found.select("kind", "context", "symbol", F.log("p").alias("log_p"))
