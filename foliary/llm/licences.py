"""Licence scan: identifier tags and notice phrases in whole texts.

Texts are lower-cased (A-Z) and cut into words of digits, letters and characters
beyond ASCII.  One Aho-Corasick automaton over the words, each with a space before and after,
finds all places of all phrases in one pass.  The tag ``SPDX-License-Identifier:`` is one of the
phrases; the expression after it is read by a shunting-yard parser with the operators
``WITH`` over ``AND`` over ``OR`` and parentheses, and evaluated to the restrictions it puts on a
user: of ``OR`` the milder side, of ``AND`` the stricter, an exception halves.  A document's score
is the strictest of its notices and expressions, 0 where there is none.

Base phrases are the ones of ``BASE``; ``n_base``, ``first_word`` and ``last_word`` look at these
only.  ``labels`` also has the method's own: ``NOTICES``, the identifiers of expressions (in lower
case), and ``bad-expression`` for one that cannot be read; what can be read of it still counts.

Defined cases: a null or empty text has no words, no labels (empty strings), null places and
score 0.  Overlapping places all count.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import byte_texts, words_of

# Phrase, label.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
NOTICES = (
    ("apache license", "apache"),
    ("mit license", "mit"),
    ("bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("creative commons", "creative-commons"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("cc by sa", "cc-by-sa"),
    ("cc0", "cc0"),
    ("public domain", "public-domain"),
    ("permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
)
TAG = "spdx license identifier"
TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)

# How much a licence restricts a user of the text, from 0 to 1, by label or by
# the start of an identifier (the longest that fits).
RESTRICTION = {
    "public-domain": 0.1,
    "cc0": 0.1,
    "unlicense": 0.1,
    "mit": 0.2,
    "bsd": 0.2,
    "isc": 0.2,
    "apache": 0.2,
    "cc-by": 0.3,
    "creative-commons": 0.4,
    "mpl": 0.4,
    "lgpl": 0.5,
    "cc-by-sa": 0.6,
    "gpl": 0.7,
    "agpl": 0.8,
    "cc-by-nc": 0.9,
    "cc-by-nd": 0.9,
    "reserved": 1.0,
}
UNKNOWN = 0.5
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[^\s()]+")
IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9.+:-]*")


def restriction(identifier: str) -> float:
    fitting = [k for k in RESTRICTION if identifier.startswith(k)]
    return RESTRICTION[max(fitting, key=len)] if fitting else UNKNOWN


def to_postfix(expression: str) -> tuple[list[str], bool]:
    """Shunting-yard: operands and operators in the order of evaluation, and whether the
    expression is well formed.  Reading stops at the first token that cannot stand there."""
    out: list[str] = []
    waiting: list[str] = []
    want_operand, fine = True, True
    for token in TOKEN.findall(expression.lower()):
        if token == "(" and want_operand:
            waiting.append(token)
        elif token == ")" and not want_operand and "(" in waiting:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in PRECEDENCE and not want_operand:
            while waiting and PRECEDENCE.get(waiting[-1], 0) >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            want_operand = True
        elif want_operand and token not in PRECEDENCE and IDENTIFIER.fullmatch(token):
            out.append(token)
            want_operand = False
        else:
            fine = False
            break
    if want_operand or "(" in waiting:
        fine = False
    while waiting:
        token = waiting.pop()
        if token != "(":
            out.append(token)
    return out, fine


def evaluate(expression: str) -> tuple[set[str], float, bool]:
    """Identifiers, restriction and whether the expression is well formed."""
    postfix, fine = to_postfix(expression)
    values: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            values.append((restriction(token), {token}))
        elif len(values) >= 2:
            (b, more), (a, ids) = values.pop(), values.pop()
            if token == "with":
                values.append((a / 2, ids))
            else:
                values.append((min(a, b) if token == "or" else max(a, b), ids | more))
    ids = set().union(*[i for _, i in values])
    return ids, max((v for v, _ in values), default=0.0), fine and bool(values)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    by_phrase: dict[str, list[tuple[str, bool]]] = {}
    for phrase, label in BASE:
        by_phrase.setdefault(phrase, []).append((label, True))
    for phrase, label in NOTICES:
        by_phrase.setdefault(phrase, []).append((label, False))
    by_phrase[TAG] = []
    for phrase, found in by_phrase.items():
        a.add_word(f" {phrase} ", (phrase, tuple(found)))
    a.make_automaton()
    return a


def scan(text: bytes, machine: ahocorasick.Automaton) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    words = words_of(text)
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    hits = list(machine.iter(joined))
    if not hits:
        return len(words), 0, None, None, "", "", 0.0
    gaps = [i for i, c in enumerate(joined) if c == " "]
    places, base, labels, score = [], set(), set(), 0.0
    for end, (phrase, found) in hits:
        for label, is_base in found:
            labels.add(label)
            score = max(score, RESTRICTION[label])
            if is_base:
                base.add(label)
                places.append(bisect_left(gaps, end - len(phrase) - 1))
        if phrase == TAG:
            labels.add("spdx")
    if "spdx" in labels:
        for line in TAG_LINE.findall(text):
            ids, value, fine = evaluate(line.decode("utf-8", "replace"))
            labels |= ids if fine else ids | {"bad-expression"}
            score = max(score, value)
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        score,
    )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)
TYPES = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; see the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = list(zip(*(scan(text, machine) for text in byte_texts(batch.column(1))))) or [()] * len(TYPES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(rows, TYPES)]],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
