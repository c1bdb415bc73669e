"""Quality rules by n-gram perplexity.

For each language of ``languages``, and one for all other rows (a null language too), a character model
with modified Kneser-Ney smoothing (``kneser_ney``) is counted over all documents.  The
perplexity of a document is that of its words and their ends, per character, under the model of its
language.  With ``folded`` the characters of the model are 32 symbols and it is broadcast; without, they are all characters as
they are and the model is a table: documents lie in blocks, a block's distinct n-grams are joined with the
table, and the block is scored by the probabilities that come back.  A language's band lies around the median of the logarithm of its documents'
perplexities, in units of their spread (the interquartile range over 1.349): ``low`` spreads below and
``high`` above.  Documents outside the band are rejected: repetitive text below, text of another kind or
noise above.  Medians and spreads are taken over all documents that pass the base rules.

Base rules, on words ``[^\\x20\\x09-\\x0D]+``: ``word_chars``, code points in words; ``n_symbols``, characters
of ``SYMBOLS_COUNTED``; ``n_dup_lines``, lines with a word that equal an earlier line;
``n_repeat_words``, words in a window of three words that occurs again in the text.  A text of fewer
than 50 words, or with more than half of its words repeated, fails.

Defined cases: a null or empty text has no words, fails the base rules and has a null perplexity.
A language whose documents all fail has no band, and nothing there is kept.
"""

from __future__ import annotations

import bz2
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import WHITE_SPACE, byte_texts, mixed64, slices, stored
from foliary.llm.kneser_ney import GramCounter, Model, Vocabulary, character_grams, log_probabilities, summed

LANGUAGES = ("en", "de", "fr", "es")
REST = ""
ORDER = 4
LOW, HIGH = 6.0, 40.0
LEAST_SPREAD = 0.01
SYMBOLS_COUNTED = b"#*$%&|<>"
NOT_COUNTED = WHITE_SPACE + bytes(range(0x80, 0xC0))


def kind_of(lang: Column, languages: tuple) -> Column:
    return F.when(lang.isin(*languages), lang).otherwise(F.lit(REST)) if languages else F.lit(REST)


def models(rows: DataFrame, languages: tuple, order: int) -> dict[str, Model]:
    """A model for each kind; ``rows``: ``kind, text``."""
    kinds = dict.fromkeys((*languages, REST), order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter(kinds)
        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                counter.add(kind, text.split())
                if counter.full():
                    yield from counter.rows()
        yield from counter.rows()

    counts = summed(rows.select("kind", "text").mapInArrow(run, GramCounter.SCHEMA))
    return {kind: Model.of(*counts[kind], order) for kind in counts}


def repeated_words(numbers: np.ndarray) -> int:
    """Words in a three-word window found twice or more."""
    if len(numbers) < 4:
        return 0
    own = mixed64(numbers + 1)
    windows = own[:-2] * np.uint64(0x9E3779B97F4A7C15) + own[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + own[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(numbers), bool)
    for j in range(3):
        covered[j : j + len(windows)] |= again
    return int(covered.sum())


SCHEMA = (
    "doc_id long, kind string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, log_perplexity double"
)
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64()]


def counts_of(text: bytes, numbers: np.ndarray | None, values: np.ndarray | None) -> tuple:
    """The columns of a text from ``n_words`` on; ``numbers`` of its words (None: it has none) and ``values`` by number."""
    n = 0 if numbers is None else len(numbers)
    chars = len(text.translate(None, NOT_COUNTED))
    lines = [x for x in text.split(b"\n") if x.strip(WHITE_SPACE)]
    symbols = len(text) - len(text.translate(None, SYMBOLS_COUNTED))
    repeats, value = 0, None
    if n:
        repeats = repeated_words(numbers)
        value = -float(values[numbers].sum()) / (chars + n)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, value


def scored(rows: DataFrame, own_models: dict[str, Model]) -> DataFrame:
    """Counts and log perplexity of each document; ``rows``: ``doc_id, kind, text``."""
    sent = rows.sparkSession.sparkContext.broadcast(own_models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = 400_000 // max(1, len(sent.value))
        known = {kind: Vocabulary(model.log_words, share) for kind, model in sent.value.items()}
        for batch in batches:
            for part in slices(batch, 2):
                kinds = part.column(1).to_pylist()
                texts = list(byte_texts(part.column(2)))
                words = [text.split() for text in texts]
                for kind in set(kinds) & set(known):
                    known[kind].prepare(w for w, k in zip(words, kinds) if k == kind)
                out: list[list] = [[] for _ in range(6)]
                for kind, text, own in zip(kinds, texts, words):
                    numbers = known[kind].numbers(own) if own else None
                    for column, v in zip(out, counts_of(text, numbers, known[kind].values if own else None)):
                        column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(out, TYPES[2:])]],
                    names=NAMES,
                )

    return rows.select("doc_id", "kind", "text").mapInArrow(run, SCHEMA)


BLOCK_BYTES = 5 << 20
BLOCKS = "kind string, block long, documents binary, contexts array<long>, symbols array<long>, counts array<long>"


def block_row(kind: str, block: int, documents: pa.Table, order: int) -> pa.RecordBatch:
    """Documents of a kind, compressed, and their distinct n-grams with the times they occur."""
    words = Counter(chain.from_iterable(text.split() for text in byte_texts(documents.column("text"))))
    contexts, symbols, number, starts = character_grams(list(words), order)
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.diff(np.r_[starts, len(number)]))
    counts = np.bincount(number, weights=times, minlength=len(contexts)).astype(np.int64)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema) as out:
        out.write_table(documents.combine_chunks())
    # texts are stored and shuffled once each, so their size is most of the disk: bz2 takes an eighth less than zstd
    packed = bz2.compress(sink.getvalue())
    values = [pa.array([kind]), pa.array([block]), pa.array([packed], pa.binary())]
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (contexts, symbols, counts)]
    return pa.RecordBatch.from_arrays(values + lists, names=[f.split()[0] for f in BLOCKS.split(", ")])


def blocked(rows: DataFrame, order: int, most: int = BLOCK_BYTES) -> DataFrame:
    """All documents in blocks of one kind and of about ``most`` bytes of text (or one document); a task's last ones
    are smaller.  Numbers of blocks depend on the split of the input, so the rows are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: dict[str, list[pa.RecordBatch]] = {}
        size: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 2, most // 4):
                for kind in part.column(1).unique().to_pylist():
                    own = part.filter(pc.equal(part.column(1), kind))
                    held.setdefault(kind, []).append(own.select(["doc_id", "text"]))
                    size[kind] += pc.sum(pc.binary_length(own.column(2))).as_py() or 0
                    if size[kind] >= most:
                        yield block_row(kind, block, pa.Table.from_batches(held.pop(kind)), order)
                        block, size[kind] = block + 1, 0
        for kind, own in held.items():
            yield block_row(kind, block, pa.Table.from_batches(own), order)
            block += 1

    return stored(rows.select("doc_id", "kind", "text").mapInArrow(run, BLOCKS), "perplexity-blocks")


def scored_as_they_are(rows: DataFrame, order: int) -> DataFrame:
    """As ``scored``, by models over characters as they are, counted over all documents."""
    blocks = blocked(rows, order)
    each = blocks.select("kind", "block", F.posexplode(F.arrays_zip("contexts", "symbols", "counts")).alias("at", "g"))
    # named anew: both sides of the cogroup come from one table
    each = each.select("kind", "block", "at", "g.*").toDF("kind", "block", "at", "context", "symbol", "n")
    grams = stored(each.groupBy("kind", "context", "symbol").agg(F.sum("n").alias("n")), "perplexity-grams")
    wanted = each.drop("n").join(log_probabilities(grams, order), ["kind", "context", "symbol"])
    # a block has one kind, and its number is its own
    wanted = wanted.select("block", "at", "log_p")

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        kind = block.column("kind")[0].as_py()
        documents = pa.ipc.open_stream(bz2.decompress(block.column("documents")[0].as_py())).read_all()
        texts = list(byte_texts(documents.column("text")))
        words = [text.split() for text in texts]
        place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        contexts, _, number, starts = character_grams(list(place), order)
        at = found.column("at").to_numpy()
        if not np.array_equal(np.sort(at), np.arange(len(contexts))):
            raise ValueError("a block needs the probability of each of its n-grams once")
        log_p = found.column("log_p").to_numpy()[np.argsort(at)]
        values = np.add.reduceat(log_p[number], starts) if place else log_p
        out = [counts_of(t, np.fromiter(map(place.__getitem__, w), np.int64, len(w)), values) for t, w in zip(texts, words)]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), TYPES[2:])]
        return pa.Table.from_arrays([documents.column("doc_id"), pa.array([kind] * len(texts)), *columns], names=NAMES)

    return blocks.select("block", "kind", "documents").groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, SCHEMA)


def bands(scores: DataFrame, low: float, high: float) -> dict[str, tuple[float, float]]:
    """Least and greatest log perplexity of each kind; one row per kind comes to the driver."""
    q = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    found = scores.where("not base_failed").groupBy("kind").agg(q.alias("q")).collect()
    out = {}
    for row in found:
        a, m, b = row["q"]
        spread = max(LEAST_SPREAD, (b - a) / 1.349)
        out[row["kind"]] = (m - low * spread, m + high * spread)
    return out


def judged(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    languages: tuple = LANGUAGES,
    order: int = ORDER,
    low: float = LOW,
    high: float = HIGH,
    folded: bool = True,
) -> DataFrame:
    """One row per document: counts of the base rules, ``base_failed``, ``perplexity``,
    ``least_perplexity``, ``most_perplexity`` and ``kept``."""
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), kind_of(F.col(lang_col), languages).alias("kind"), F.col(text_col).alias("text")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = scored(rows, models(rows, languages, order)) if folded else scored_as_they_are(rows, order)
    scores = stored(counted.withColumn("base_failed", failed), "perplexity")
    band = bands(scores, low, high)
    limits = [F.lit(None).cast("double"), F.lit(None).cast("double")]
    if band:
        for i in (0, 1):
            entries = chain.from_iterable((F.lit(kind), F.lit(float(b[i]))) for kind, b in sorted(band.items()))
            limits[i] = F.create_map(*entries)[F.col("kind")]
    value = F.col("log_perplexity")
    inside = F.coalesce((value >= limits[0]) & (value <= limits[1]), F.lit(False))
    return scores.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.exp(value).alias("perplexity"),
        F.exp(limits[0]).alias("least_perplexity"),
        F.exp(limits[1]).alias("most_perplexity"),
        (~F.col("base_failed") & inside).alias("kept"),
    )
