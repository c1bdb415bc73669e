"""Near duplicates by DartMinHash signatures and banding.

A document is the set of its shingles: ``size`` consecutive words (lower-cased runs of
digits, letters and characters beyond ASCII); a text of fewer words is one shingle.  With
``weights="counts"`` a shingle that occurs n times weighs n.  Two documents are linked when
their (weighted) Jaccard similarity is at least ``threshold``; classes are the connected parts.

DartMinHash throws darts at the plane of weight and rank: each unit of weight of each shingle is a
region, and a hash of shingle, region and rank band says how many darts (a Poisson number) fall
into that cell and where.  A dart counts if it hits below the shingle's weight.  Each dart
belongs to one of ``bands * rows`` coordinates, whose signature value is the dart of the earliest
rank.  Rank bands are opened one after the other until every coordinate has its dart, so the work
is one look at each shingle and band plus the darts, not shingles times coordinates.

Documents that agree on all rows of a band share a bucket.  Equal word sequences are one
node from the start.  In the first ``BUCKET_ROUNDS`` rounds all nodes meet a fixed number of heads of their bucket, which
settles most of them.  A head has then met all nodes of the bucket beyond its own part and leaves it.  Connected parts are
found anew after each round, by alternating large and small stars; a bucket is done when one part is left in it.

What is left are nodes that agree on a band and are mostly not similar.  They are dealt anew by a test that loses no
link: with the shingles of a node in one order for all (rarest first), two nodes that have at least ``o`` shingles in common
share one of the first ``size - o + 1`` of each.  ``o`` follows from the threshold and both sizes, so a bucket is now a shingle and
a pair of size classes, the sizes in a class lying within ``SIZE_STEP``; only nodes of different classes meet in it if
the classes differ.  A text that is far from all others begins with shingles of its own and meets nobody.  Heads are now the nodes
with the fewest shingles of their own, the likeliest to be linked with what is still apart.

Rounds go on until any two nodes of a bucket have been compared or are known to be connected: ``LARGEST_HEADS`` heads of the
largest part and ``HEADS`` of the others on each side, the latter four times as many in each round after the first ``STEADY_ROUNDS``.
A round takes rows in proportion to the members of buckets that are not settled.  Only many parts that stay apart although their
nodes share rare shingles and sizes take more rounds, in the worst case up to the square of the nodes of such a bucket.

Defined cases: a null or empty text, or one without words, is in no class but its own.  Rows that
repeat an id are rows of their own.  ``class_id`` is the smallest id of the class; the row with it
stays (of repeated rows, one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm import bloom
from foliary.llm.common import byte_texts, mixed64, release, slices, stored, whole_rows, words_of
from foliary.session import cut_lineage

BANDS, ROWS = 24, 5
BAND_MASK = 31
LARGEST_HEADS, HEADS, MOST_HEADS = 8, 8, 256
BUCKET_ROUNDS, STEADY_ROUNDS = 1, 4
SIZE_STEP = 1.05
# a member of a bucket: its shingles that no other node has, and its side (nodes of the same side do not meet, 0: all meet)
MEMBER = ["bucket", "node", "part", "alone", "side"]
FIRST_RANK = 1 / 64
KNOWN_WORDS = 100_000
SLICE = 1 << 20  # bytes of text cut into shingles at once
STEP = np.uint64(0x9E3779B97F4A7C15)
# an odd factor for each place in a shingle
FACTORS = mixed64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = set(words)
        for w in new:
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int, counts: bool) -> np.ndarray:
    """Distinct shingles; with counts the n-th occurrence of one is an element of its own, so
    that the Jaccard similarity of the sets is the weighted one."""
    n = max(1, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(size, len(hashes))):
        total += hashes[j : j + n] * FACTORS[j]
    own = mixed64(total)
    if not counts:
        return np.unique(own)
    own.sort()
    first = np.r_[True, own[1:] != own[:-1]]
    starts = np.flatnonzero(first)
    nth = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    return np.unique(own + mixed64(nth.astype(np.uint64) * STEP))


@lru_cache(maxsize=64)
def poisson(mean: float) -> np.ndarray:
    """Distribution function of a Poisson number, up to where it reaches 1."""
    term, total, out, n = exp(-mean), 0.0, [], 0
    while total < 1 - 1e-15 and n < mean + 20 * mean**0.5 + 40:
        total += term
        out.append(total)
        n += 1
        term *= mean / n
    return np.array(out)


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def signatures(cells: np.ndarray, owner: np.ndarray, n: int, k: int, heights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash: ``k`` values for each of ``n`` owners.

    ``cells``: hash of each unit of weight; ``heights``: how much of the unit the element
    fills (all of it if none are given).  An owner without weight has zeros.
    """
    best = np.zeros(n * k, np.uint64)
    free = np.ones(n * k, bool)
    if heights is not None:
        cells, owner, heights = cells[heights > 0], owner[heights > 0], heights[heights > 0]
    start, width, band = 0.0, FIRST_RANK, 0
    while len(cells):
        salt = mixed64(np.array([band + 1], np.uint64) * STEP)[0]
        counts = np.searchsorted(poisson(width), unit(mixed64(cells ^ salt)), side="right")
        hit = np.flatnonzero(counts)
        own = counts[hit]
        at = np.repeat(hit, own)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(own) - own, own)
        darts = mixed64(cells[at] + salt + nth.astype(np.uint64) * STEP)
        slot = owner[at] * k + ((darts >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        good = free[slot]
        if heights is not None:
            good &= unit(mixed64(darts + STEP)) < heights[at]
        darts, slot = darts[good], slot[good]
        rank = mixed64(darts ^ STEP)
        order = np.lexsort((rank, slot))
        slot, darts = slot[order], darts[order]
        first = np.r_[True, slot[1:] != slot[:-1]][: len(slot)]
        best[slot[first]] = darts[first]
        free[slot[first]] = False
        left = free.reshape(n, k).any(axis=1)[owner]
        cells, owner = cells[left], owner[left]
        heights = heights[left] if heights is not None else None
        start += width
        width, band = start, band + 1
    return best.reshape(n, k)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band: its number and its values."""
    grid = values.reshape(len(values), bands, rows)
    key = np.broadcast_to(mixed64(np.arange(1, bands + 1, dtype=np.uint64) * STEP), grid.shape[:2]).copy()
    for r in range(rows):
        key = mixed64(key * STEP + grid[:, :, r])
    # the band in the lowest bits
    return key & np.uint64(~BAND_MASK & (1 << 64) - 1) | np.arange(bands, dtype=np.uint64)


def signed(
    df: DataFrame, id_col: str, text_col: str, size: int, counts: bool, bands: int, rows: int
) -> DataFrame:
    """``doc_id, content, keys``: the hash of the word sequence (null without words) and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                content, cells = [], []
                for text in byte_texts(part.column(1)):
                    words = words_of(text)
                    content.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                    cells.append(shingles(hashes(words), size, counts) if len(words) >= size else np.empty(0, np.uint64))
                owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
                values = signatures(np.concatenate(cells), owner, len(cells), bands * rows)
                keys = band_keys(values, bands, rows).view(np.int64)
                full = np.array([len(c) > 0 for c in cells])
                ends = np.cumsum(np.r_[0, np.where(full, bands, 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(content, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel())),
                    ],
                    names=["doc_id", "content", "keys"],
                )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, content binary, keys array<long>")


def shingle_sets(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int, counts: bool) -> DataFrame:
    """``node, cells`` of the nodes (``node``: hashes of word sequences) from a second reading.  A filter over the
    nodes says which rows to cut into shingles; only those move."""
    filter_bits = bloom.filter_size(nodes.count())
    bits = df.sparkSession.sparkContext.broadcast(bloom.filled(nodes, filter_bits, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                found, cells = [], []
                for text in byte_texts(part.column(0)):
                    words = words_of(text)
                    content = xxhash.xxh3_128_digest(b" ".join(words))
                    if words and bloom.tested(pa.array([content]), bits.value, filter_bits)[0].as_py():
                        found.append(content)
                        cells.append(shingles(hashes(words), size, counts).view(np.int64))
                if found:
                    ends = np.cumsum([0, *map(len, cells)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cells)))],
                        names=["node", "cells"],
                    )

    rows = df.select(F.col(text_col).alias("text")).mapInArrow(run, "node binary, cells array<long>")
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``node, first``) that are linked, by the exact similarity."""
    a = sets.select(F.col("node"), F.col("cells").alias("a"))
    b = sets.select(F.col("node").alias("first"), F.col("cells").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(a, "node")
        .join(b, "first")
        .where(common >= threshold * (F.size("a") + F.size("b") - common) - 1e-9)
        .drop("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of the links (``node, first``), root the smallest of its part.

    Alternating large stars (larger neighbours go to the smallest neighbour) and small stars
    (smaller neighbours do), until every edge ends in a root.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else edges
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.join(least, "u")
        if large:
            return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        to = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return to.where("u <> v").distinct()

    u, v = F.col("node"), F.col("first")
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    while True:
        inner = edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi")
        forked = edges.groupBy("u").count().where("count > 1").select("u")
        if inner.unionByName(forked).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = cut_lineage(star(cut_lineage(star(edges, True)), False))
        release(edges)


def crowded_buckets(signs: DataFrame) -> DataFrame:
    """``bucket, node`` of the buckets that hold several nodes.

    Of all rows only bucket and a short hash of the node shuffle, to tell which buckets these
    are; a filter of these buckets then picks the rows that go on.
    """
    rows = signs.select(F.xxhash64("content").alias("short"), F.explode("keys").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.min("short").alias("a"), F.max("short").alias("b")).where("a <> b")
    several = cut_lineage(several.select(F.unhex(F.md5(F.col("bucket").cast("string").cast("binary"))).alias("key")))
    size = bloom.filter_size(several.count())
    keyed = signs.select("content", F.explode("keys").alias("bucket"))
    bits = signs.sparkSession.sparkContext.broadcast(bloom.filled(several, size, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column(1).to_numpy()
            digests = [hashlib.md5(str(b).encode()).digest() for b in buckets.tolist()]
            yield batch.filter(bloom.tested(pa.array(digests, pa.binary()), bits.value, size))

    return keyed.mapInArrow(run, "content binary, bucket long").select("bucket", F.col("content").alias("node")).distinct()


def several_parts(members: DataFrame) -> DataFrame:
    """``members`` of the buckets that hold several parts that may meet, and whether a node is of the largest one."""
    counts = members.groupBy("bucket", "part").agg(F.count("*").alias("count"), F.min("side").alias("a"), F.max("side").alias("b"))
    largest = F.max(F.struct("count", "part"))["part"].alias("largest")
    mixed = counts.groupBy("bucket").agg(largest, F.count("*").alias("parts"), F.min("a").alias("a"), F.max("b").alias("b"))
    mixed = mixed.where("parts > 1 AND (b = 0 OR a < b)").select("bucket", "largest")
    return members.join(mixed, "bucket").select(*MEMBER, (F.col("part") == F.col("largest")).alias("in_largest"))


def bucket_heads(grouped: DataFrame, turn: int) -> DataFrame:
    """The members (columns as in ``MEMBER``) that all others of their bucket meet in this turn."""
    best = F.min(F.struct("alone", "node", "part")).alias("h")
    if not turn:
        heads = grouped.groupBy("bucket", "side").agg(best)
    else:
        # a hash of the node alone: a node heads its buckets in the same turn, so its pairs are compared once
        others = min(HEADS * 4 ** max(0, turn - STEADY_ROUNDS), MOST_HEADS)
        slot = F.pmod(F.xxhash64(F.lit(turn), "node"), F.when(F.col("in_largest"), LARGEST_HEADS).otherwise(others)).alias("slot")
        heads = grouped.groupBy("bucket", "side", "in_largest", slot).agg(best)
    return heads.select("bucket", "side", "h.*")


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(log(SIZE_STEP)))


def rare_buckets(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Members of buckets by the rarest shingles of the nodes (``node, part``).

    Any two nodes whose similarity reaches the threshold share a bucket.  Shingles of one node only make no
    bucket, but count among the first ones.
    """
    own = stored(nodes.join(sets, "node").select("node", "part", "cells"), "open-sets")
    cells = own.select("node", F.explode("cells").alias("cell"))
    common = cells.groupBy("cell").agg(F.count("*").alias("times")).where("times > 1")
    ranked = cells.join(common, "cell").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "cell"))).alias("shared"))
    rows = own.select("node", "part", F.size("cells").alias("n")).join(ranked, "node")
    n = F.col("n")
    classes = F.sequence(F.greatest(F.lit(0), size_class(threshold * n - 1e-6)), size_class(n / threshold + 1e-6))
    rows = rows.select("*", size_class(n).alias("own_class"), F.explode(classes).alias("other"))
    least = F.ceil(F.pow(F.lit(SIZE_STEP), F.col("other")) - 1e-6)
    overlap = F.ceil(threshold / (1 + threshold) * (n + least) - 1e-6)
    first = F.size("shared") - overlap + 1
    side = F.when(F.col("own_class") == F.col("other"), 0).when(F.col("own_class") < F.col("other"), 1).otherwise(2)
    ends = F.least("own_class", "other"), F.greatest("own_class", "other")
    keys = F.transform(F.slice("shared", F.lit(1), F.greatest(F.lit(0), first).cast("int")), lambda x: F.xxhash64(x["cell"], *ends))
    return rows.select(F.explode(keys).alias("bucket"), "node", "part", (n - F.size("shared")).alias("alone"), side.alias("side"))


def linked_parts(df: DataFrame, signs: DataFrame, id_col: str, text_col: str, size: int, counts: bool, threshold: float) -> DataFrame:
    """``node, root`` of all nodes with links."""
    members = stored(crowded_buckets(signs), "buckets").select("bucket", "node", F.col("node").alias("part"), F.lit(0).alias("alone"), F.lit(0).alias("side"))
    links = df.sparkSession.createDataFrame([], "node binary, first binary")
    sets, turn, rounds = None, 0, 0
    while True:
        grouped = stored(several_parts(members), "bucket-members")
        if grouped.isEmpty():
            return components(links)
        if rounds == BUCKET_ROUNDS:
            members = rare_buckets(grouped.select("node", "part").distinct(), sets, threshold)
            grouped, turn = stored(several_parts(members), "rare-members"), 0
            if grouped.isEmpty():
                return components(links)
        heads = cut_lineage(bucket_heads(grouped, turn))
        met = heads.select("bucket", F.col("node").alias("first"), F.col("part").alias("first_part"), F.col("side").alias("first_side"))
        faced = grouped.join(met, "bucket").where("part <> first_part AND (side = 0 OR side <> first_side)")
        # a pair has one form, whichever of the two is the head and in whatever bucket they meet
        turned = F.col("node") > F.col("first")
        ends = [("node", "first"), ("first", "node"), ("part", "first_part"), ("first_part", "part")]
        pairs = cut_lineage(faced.select(*[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in ends]).distinct())
        if sets is None:
            # later rounds compare nodes of the first one only
            nodes = cut_lineage(pairs.select("node").unionByName(pairs.select(F.col("first").alias("node"))).distinct())
            sets = stored(shingle_sets(df, nodes, id_col, text_col, size, counts), "shingle-sets")
        linked = cut_lineage(similar(pairs, sets, threshold))
        links = links.unionByName(linked.select("node", "first"))
        release(df)
        turn, rounds = turn + 1, rounds + 1
        # parts are named by their smallest node, so those that are joined keep that name
        merged = components(linked.select(F.col("part").alias("node"), F.col("first_part").alias("first")))
        left = grouped.join(heads.select("bucket", "node"), ["bucket", "node"], "left_anti")
        left = left.join(merged.withColumnRenamed("node", "part"), "part", "left")
        members = left.select("bucket", "node", F.coalesce("root", "part").alias("part"), "alone", "side")


def _classes(
    df: DataFrame, id_col: str, text_col: str, size: int, threshold: float, weights: str, bands: int, rows: int
) -> tuple[DataFrame, DataFrame]:
    """Stored signs with a tag, and ``node, root`` of the nodes that have links."""
    if weights not in ("set", "counts") or not 0 < bands <= BAND_MASK + 1:
        raise ValueError(f"weights: set or counts; at most {BAND_MASK + 1} bands")
    counts = weights == "counts"
    signs = stored(
        signed(df, id_col, text_col, size, counts, bands, rows).withColumn("tag", F.monotonically_increasing_id()), "signatures"
    )
    return signs, linked_parts(df, signs, id_col, text_col, size, counts, threshold)


def _best() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("tag").alias("c"))).alias("best")


def classes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    weights: str = "set",
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept``."""
    signs, roots = _classes(df, id_col, text_col, size, threshold, weights, bands, rows)
    signs = signs.select("doc_id", "tag", "content")
    rooted = signs.where("content is not null").join(roots.withColumnRenamed("node", "content"), "content", "left")
    rooted = rooted.select("doc_id", "tag", F.coalesce("root", "content").alias("root"))
    best = rooted.groupBy("root").agg(_best(), F.count("*").alias("class_size"))
    found = rooted.join(best, "root").select(
        "doc_id", F.col("best.b").alias("class_id"), "class_size", (F.col("tag") == F.col("best.c")).alias("kept")
    )
    alone = signs.where("content is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")
    )
    return found.unionByName(alone)


def without_near_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    weights: str = "set",
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``df`` with one row of each class, all columns as they were.

    A filter over the word sequences that have company picks the rows that are stored with a
    tag and joined with the winners of their classes; all others pass straight through.
    """
    signs, roots = _classes(df, id_col, text_col, size, threshold, weights, bands, rows)
    contents = signs.where("content is not null").groupBy("content").count()
    crowded = contents.where("count > 1").select("content").unionByName(roots.select(F.col("node").alias("content")))
    crowded = cut_lineage(crowded.unionByName(roots.select(F.col("root").alias("content"))).distinct())
    filter_bits = bloom.filter_size(crowded.count())
    names = df.columns
    whole, text_at = whole_rows(df, id_col, text_col)
    bits = df.sparkSession.sparkContext.broadcast(bloom.filled(crowded, filter_bits, 1))
    schema = whole.select("row", "doc_id", F.lit(b"").cast("binary").alias("content"), F.lit(True).alias("possible")).schema

    # rows are hashed and looked up in one step: a second one would be a second Python process for each task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(0).field(text_at))
            content = pa.array([xxhash.xxh3_128_digest(b" ".join(words_of(text))) for text in texts], pa.binary())
            possible = bloom.tested(content, bits.value, filter_bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), content, possible], names=["row", "doc_id", "content", "possible"]
            )

    flagged = whole.mapInArrow(run, schema)
    possible = stored(
        flagged.where("possible").drop("possible").withColumn("tag", F.monotonically_increasing_id()), "possible-near-copies"
    )
    narrow = possible.select("doc_id", "tag", "content").join(crowded.withColumn("crowd", F.lit(True)), "content", "left")
    narrow = narrow.join(roots.withColumnRenamed("node", "content"), "content", "left")
    # the filter may have let rows through that have no company: each stays
    single = narrow.where("crowd is null").select("tag")
    best = narrow.where("crowd").withColumn("root", F.coalesce("root", "content")).groupBy("root").agg(_best())
    stay = best.select(F.col("best.c").alias("tag")).unionByName(single)
    out = flagged.where("not possible").select("row").unionByName(possible.join(stay, "tag", "left_semi").select("row"))
    return out.select(*[F.col("row")[n].alias(n) for n in names])
