"""Host and path rules for URLs as a sort-merge range join.

A host with its labels reversed and a dot after each (``net.example.``) is the canonical
key: the key of a host is a prefix of the keys of all its subdomains, so the hosts a
rule covers form an interval of keys.  Rules and URLs are range-partitioned together by key
and sorted; a sweep over a partition keeps a stack of the rules whose interval is open.
Intervals nest or are apart, so closing is popping.  Of the rules on the stack
whose path starts the URL's path, the longest (host and path together, then the longer
host) decides.

A partition may begin inside intervals that were opened earlier.  These belong to the
ancestors of its first key, at most one key per label; the rules of just those keys
are joined in and open the sweep.  So no rule is sent anywhere else and a host with any number
of URLs is spread over as many partitions as it fills.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule fits; nor
does a rule with a null host.  A null rule path counts as empty, which fits every path.  Of
rules with the same host and path, ``block`` wins.  Without a rule the verdict is ``default``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.
    Path: then up to ``?``, ``#`` or the end."""
    start = F.locate("://", url)
    rest = F.coalesce(F.when(start > 0, F.substring(url, start + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def host_key(host: Column) -> Column:
    """Labels reversed, a dot after each; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    )


def open_keys(key: str) -> list[str]:
    """The key and its ancestors: every prefix that ends in a dot."""
    return [key[: i + 1] for i, c in enumerate(key) if c == "."]


class Frame:
    """A key on the stack with its rules by path; ``lengths`` are their path lengths."""

    def __init__(self, key: str):
        self.key, self.rules, self.lengths = key, {}, []

    def add(self, path: str, block: bool) -> None:
        if path not in self.rules:
            self.rules[path] = block
            self.lengths = sorted({*self.lengths, len(path)}, reverse=True)
        self.rules[path] |= block

    def longest(self, path: str) -> str | None:
        for n in self.lengths:
            if n <= len(path) and path[:n] in self.rules:
                return path[:n]
        return None


def judge(stack: list[Frame], path: str) -> tuple[str | None, str | None]:
    best = None
    for frame in stack:
        fits = frame.longest(path)
        if fits is not None:
            size = (len(frame.key) - 1 + len(fits), len(frame.key))
            if best is None or size > best[0]:
                best = (size, frame, fits)
    if best is None:
        return None, None
    _, frame, fits = best
    return ".".join(reversed(frame.key[:-1].split("."))) + fits, "block" if frame.rules[fits] else "allow"


def rule_keys(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select(
        host_key(F.translate(F.col("host"), UPPER, UPPER.lower())).alias("key"),
        F.coalesce("path", F.lit("")).alias("path"),
        (F.col("verdict") == "block").alias("block"),
    )


def judged(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per row of ``pages``.

    ``rules``: ``host, path, verdict`` (``allow`` or ``block``).
    """
    host, path = host_and_path(F.col(url_col))
    urls = (
        pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
        .withColumn("key", host_key(F.col("host")))
        .withColumn("is_url", F.lit(True))
        .withColumn("block", F.lit(None).cast("boolean"))
    )
    keyed = rule_keys(rules)
    events = urls.unionByName(keyed.withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    # rules of a key come before its URLs; the id spreads the URLs of one host
    order = ["key", "is_url", "path", "page_id"]
    swept = cut_lineage(events.repartitionByRange(*order).sortWithinPartitions(*order))

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = batch.column(0)[0].as_py()
                own = open_keys(key)
                part = TaskContext.get().partitionId()
                yield pa.record_batch(
                    [pa.array([part] * len(own), pa.int32()), pa.array(own, pa.string())], ["part", "key"]
                )
                for _ in batches:  # a task must read its input to the end
                    pass
                return

    starts = swept.select("key").mapInArrow(first_keys, "part int, key string")
    carried: dict[int, list[tuple[str, str, bool]]] = {}
    # a partition has as many keys as its first host has labels
    for row in starts.join(keyed, "key").toLocalIterator():
        carried.setdefault(row["part"], []).append((row["key"], row["path"], row["block"]))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Frame] = []

        def push(key: str, path: str, block: bool) -> None:
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if not stack or stack[-1].key != key:
                stack.append(Frame(key))
            stack[-1].add(path, block)

        for key, path, block in sorted(carried.get(TaskContext.get().partitionId(), [])):
            push(key, path, block)
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            out: list[list] = [[], [], [], [], []]
            for key, is_url, path, page_id, host, block in zip(*rows):
                if not is_url:
                    push(key, path, block)
                    continue
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                rule, verdict = judge(stack, path)
                for column, value in zip(out, (page_id, host, path, rule, verdict or default)):
                    column.append(value)
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), *[pa.array(c, pa.string()) for c in out[1:]]],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return swept.select("key", "is_url", "path", "page_id", "host", "block").mapInArrow(
        sweep, "page_id long, host string, path string, rule string, verdict string"
    )
