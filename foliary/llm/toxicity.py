"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, of the toxic and the ordinary labelled documents, have their upper
orders to themselves and share the lower ones, which are counted over all documents.  A rare
expression, unseen in either class, so gets the same probability from both and says nothing.  The
log-likelihoods of a word under both are compared per character.  A document has three figures:
the ratio per character of its whole text, that of its most telling word, and the mean of the three
most telling (a word counts with at most ``LONGEST`` characters, so long random strings do not
add up).  A logistic function of the three is its score.

Labels are used of rows with ``crc32(doc_id as text) mod 3`` other than 1: those with 0 train the
models, those with 2 the logistic function, so it sees figures of texts the models have
not seen.  The sample is bounded class by class: the ``model_rows`` and ``fit_rows`` labelled rows of each class that come
first in the order of a hash, so a rare class is not crowded out.  Where that thins one class more than the other, the
constant of the logistic function is set back to the share the classes have among all labels.  Labels, language, source and
id are not part of any figure.

Defined cases: a null or empty text has figures of 0 and the score these give.  An id with several labels
counts as toxic if one of them is.  If the labels of a part lack a class nothing can be learned and all scores
are 0.  A null id is held in (its remainder is taken as 0) and has no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import byte_texts, slices, words_of
from foliary.llm.kneser_ney import GramCounter, Level, Model, Vocabulary, level, suffixes, summed, windows

ORDER, SHARED = 5, 3
LONGEST = 10
MODEL_ROWS, FIT_ROWS = 20_000, 10_000
RIDGE = 0.01
TOP = 3


def part_of(doc_id: Column) -> Column:
    """``crc32`` of the id as text, modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def sample(labels: DataFrame, id_col: str, label_col: str, part: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted ids and classes of at most ``most`` labelled rows of each class of one part, and the logarithm by which the
    odds of the toxic class are smaller among all labels of the part."""
    own = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (part_of(F.col("doc_id")) == part))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    first = [own.where(F.col("toxic") == c).orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(most) for c in (0, 1)]
    rows = first[0].unionByName(first[1]).toArrow()
    ids, classes = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy()
    order = np.argsort(ids)
    thinned = [0.0, 0.0]
    for c, n in own.groupBy("toxic").count().collect():
        thinned[c] = float(np.log(n / min(n, most)))
    return ids[order], classes[order], thinned[0] - thinned[1]


def look_up(ids: np.ndarray, classes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Class of each wanted id, -1 for those not in the sample."""
    if not len(ids):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, classes[at], -1)


@dataclass
class Ratio:
    """Log-likelihood ratio of words: levels both models share, and their own."""

    shared: list[Level]
    toxic: list[Level]
    ordinary: list[Level]

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0)
        codes, starts = windows(words, ORDER)
        base = Model(self.shared).probabilities(codes)
        sides = []
        for own in (self.toxic, self.ordinary):
            p = base
            for one in own:
                p = one.extend(p, codes)
            sides.append(np.log(p))
        total = np.add.reduceat(sides[0] - sides[1], starts)
        length = np.diff(np.r_[starts, len(codes)])
        return total * np.minimum(1.0, LONGEST / length)


def figures(words: list[bytes], known: Vocabulary) -> tuple[float, float, float]:
    if not words:
        return 0.0, 0.0, 0.0
    values = known.values[known.numbers(words)]
    top = np.sort(np.partition(values, -TOP)[-TOP:] if len(values) > TOP else values)
    return float(values.sum()) / (sum(map(len, words)) + len(words)), float(top[-1]), float(top.sum()) / TOP


@dataclass
class Classifier:
    ratio: Ratio | None
    weights: np.ndarray | None
    mean: np.ndarray | None
    scale: np.ndarray | None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        z = (rows - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def count_grams(rows: DataFrame, ids: np.ndarray, classes: np.ndarray) -> dict:
    """N-grams of all documents for the shared orders, and of the sample by class for the upper ones."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, classes))
    orders = {"shared": SHARED + 1, "toxic": ORDER, "ordinary": ORDER}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter(orders)
        for batch in batches:
            own = look_up(*sent.value, batch.column(0).fill_null(-1).to_numpy())
            for kind, text in zip(own, byte_texts(batch.column(1))):
                words = words_of(text)
                counter.add("shared", words)
                if kind >= 0:
                    counter.add("toxic" if kind else "ordinary", words)
                if counter.full():
                    yield from counter.rows()
        yield from counter.rows()

    return summed(rows.mapInArrow(run, GramCounter.SCHEMA))


def measured(rows: DataFrame, ratio: Ratio, ids: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Figures and classes of the sampled rows, at most as many as the sample has ids."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, classes, ratio))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(sent.value[2])
        for batch in batches:
            own = look_up(*sent.value[:2], batch.column(0).fill_null(-1).to_numpy())
            batch = batch.append_column("toxic", pa.array(own.astype(np.int32))).filter(pa.array(own >= 0))
            for part in slices(batch, 1):
                words = [words_of(text) for text in byte_texts(part.column(1))]
                known.prepare(words)
                found = np.array([figures(w, known) for w in words])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *[pa.array(c) for c in found.T]], names=["doc_id", "toxic", "a", "b", "c"]
                )

    # a repeated id gives one row
    out = (
        rows.mapInArrow(run, "doc_id long, toxic int, a double, b double, c double")
        .groupBy("doc_id")
        .agg(F.max(F.struct("toxic", "a", "b", "c")).alias("m"))
        .select("m.*")
        .toArrow()
    )
    return np.column_stack([out.column(c).to_numpy() for c in "abc"]), out.column("toxic").to_numpy()


def logistic(rows: np.ndarray, classes: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method, the constant first; ``ridge`` keeps separable data finite."""
    x = np.column_stack([np.ones(len(rows)), rows])
    penalty = np.diag([1e-6, *[ridge] * rows.shape[1]])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (classes - p) - penalty @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    model_rows: int = MODEL_ROWS,
    fit_rows: int = FIT_ROWS,
) -> Classifier:
    """The classifier of a corpus and its labels."""
    nothing = Classifier(None, None, None, None)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids, classes, _ = sample(labels, id_col, label_col, 0, model_rows)
    if len(set(classes.tolist())) < 2:
        return nothing
    counts = count_grams(rows, ids, classes)
    if not {"shared", "toxic", "ordinary"} <= set(counts):
        return nothing
    codes, n = suffixes(counts["shared"][0], SHARED + 1)
    shared = Model.of(codes, n, SHARED).levels
    own = {}
    for kind in ("toxic", "ordinary"):
        codes, n = counts[kind]
        own[kind] = []
        for k in range(ORDER, SHARED, -1):
            own[kind].insert(0, level(codes, n, k))
            codes, n = suffixes(codes, k)
    ratio = Ratio(shared, own["toxic"], own["ordinary"])
    ids, classes, rarer = sample(labels, id_col, label_col, 2, fit_rows)
    seen, wanted = measured(rows, ratio, ids, classes)
    if len(set(wanted.tolist())) < 2:
        return nothing
    mean, scale = seen.mean(axis=0), np.maximum(seen.std(axis=0), 1e-9)
    x = (seen - mean) / scale
    # the penalty of the whole sample does not grow with it: one that did would keep scores near the sample's share
    weights = logistic(x, wanted)
    weights[0] -= rarer
    return Classifier(ratio, weights, mean, scale)


def scored(df: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    sent = df.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _scores(batches, 2, sent.value):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    doc_id = F.col(id_col).cast("long")
    rows = df.select(doc_id.alias("doc_id"), (part_of(doc_id) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def _scores(batches: Iterator[pa.RecordBatch], column: int, classifier: Classifier) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    known = Vocabulary(classifier.ratio) if classifier.ratio else None
    for batch in batches:
        for part in slices(batch, column):
            if known is None:
                yield part, np.zeros(part.num_rows)
                continue
            words = [words_of(text) for text in byte_texts(part.column(column))]
            known.prepare(words)
            yield part, classifier.scores(np.array([figures(w, known) for w in words]).reshape(len(words), 3))


def without_toxic(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **parameters
) -> DataFrame:
    """``df`` without the rows whose score reaches the threshold, all columns as they were."""
    classifier = fitted(df, labels, id_col, text_col, **parameters)
    sent = df.sparkSession.sparkContext.broadcast(classifier)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _scores(batches, at, sent.value):
            yield part.filter(pa.array(scores < threshold))

    return df.mapInArrow(run, df.schema)
