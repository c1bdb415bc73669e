"""Token counts of whole texts, huge ones in overlapping chunks.

A text of up to ``chunk`` characters is encoded piece by piece (see ``byte_bpe``), or at once if
it has a special string.  A longer one is encoded in chunks of that size, each beginning ``overlap`` characters before
the end of the one before.  Two neighbours are spliced at a place where a match of the
splitting pattern begins in both of them, at least ``MARGIN`` characters before the end of the left
one:

* in the left chunk everything before such a place is what it is in the whole text: a
  match ends where the next character does not fit, and that character (and a special
  string that may begin there) is inside the chunk;
* matching goes on from a place where a match begins as if the text began there, so the
  right chunk is what it is in the whole text from there on.

If the overlap has no common place (a word longer than the overlap) it is doubled; once it reaches
back to the last splice, the left chunk is encoded anew with twice the size.  So counts
are exact for any text, and memory is bounded by the longest word.

Defined cases: a null or empty text has 0 bytes and 0 tokens.  Special strings in a text
count as the library's default has it, one token each.  The tokenizer must be byte-level BPE
without a normaliser; another one raises an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.byte_bpe import encoder
from foliary.llm.common import byte_texts

CHUNK = 1 << 15
OVERLAP = 1 << 10


def checked_tokenizer(path: str):
    """The tokenizer of a file without truncation or padding, and the margin of its splices."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    made = json.loads(own.to_str())
    pre = made.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or made.get("normalizer"):
        raise ValueError(f"{path} is not a byte-level tokenizer without normaliser")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
        raise ValueError(f"{path} has added tokens that look at their neighbours")
    return own, 1 + max([1, *(len(t["content"]) for t in made["added_tokens"])])


class Chunk:
    """Tokens of ``text[start:end]``: where each begins, and where matches begin."""

    def __init__(self, own, text: str, start: int, end: int):
        made = own.encode(text[start:end], add_special_tokens=False)
        self.end = end
        self.starts = [start + a for a, _ in made.offsets]
        words = made.word_ids
        self.bounds = {s for i, s in enumerate(self.starts) if i == 0 or words[i] is None or words[i] != words[i - 1]}

    def between(self, low: int, high: int) -> int:
        return sum(low <= s < high for s in self.starts)


def count_long(text: str, own, margin: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by spliced chunks."""
    done, total, size, reach = 0, 0, chunk, overlap
    left = Chunk(own, text, 0, min(size, len(text)))
    while left.end < len(text):
        start = left.end - reach
        if start <= done:
            size *= 2
            left = Chunk(own, text, done, min(done + size, len(text)))
            reach = overlap
            continue
        right = Chunk(own, text, start, min(left.end + size - reach, len(text)) if size > reach else len(text))
        common = [p for p in left.bounds & right.bounds if done < p <= left.end - margin and p > start]
        if not common or right.end <= left.end:
            reach *= 2
            continue
        place = max(common)
        total += left.between(done, place)
        done, left, size, reach = place, right, chunk, overlap
    return total + left.between(done, len(text) + 1)


def counted(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, margin = checked_tokenizer(vocabulary)
        encode = encoder(vocabulary, pattern)
        special = [t.content for t in own.get_added_tokens_decoder().values()]

        def count(text: str) -> int:
            if len(text) > chunk:
                return count_long(text, own, margin, chunk, overlap)
            if any(s in text for s in special):
                return len(own.encode(text, add_special_tokens=False).ids)
            return len(encode(text)) // 4

        for batch in batches:
            sizes, tokens = [], []
            for raw in byte_texts(batch.column(1)):
                text = raw.decode("utf-8", "replace")
                sizes.append(len(raw))
                tokens.append(count(text))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
