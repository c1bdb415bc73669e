"""Words of a text as search lexemes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary import fixed_values as fv


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


# Suffix rules of the published algorithm (M. F. Porter, 1980): the condition
# is the least measure of the remaining stem.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance",
    "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
_STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
_LONGEST_FIRST = sorted(_STEP_4, key=len, reverse=True)
_ENDS_2, _ENDS_3, _ENDS_4 = tuple(_STEP_2), tuple(_STEP_3), tuple(_STEP_4)
_SHAPES = {c: "v" if chr(c) in "aeiou" else "c" for c in range(128)}


def _shape(word: str) -> str:
    """Each letter as ``v`` or ``c``; ``y`` is a vowel after a consonant."""
    if "y" not in word:
        return word.translate(_SHAPES)
    shape = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str], ends: tuple[str, ...]) -> str:
    if not word.endswith(ends):
        return word
    for size in range(7, 1, -1):
        suffix = word[-size:]
        if len(word) > size and suffix in rules:
            stem = word[:-size]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


_STOP_WORDS = frozenset(fv.TEXT_STOP_WORDS)


@lru_cache(maxsize=200_000)
def stem_word(word: str) -> str:
    """Porter stem of one lower-case English word."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    # plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # -ed, -ing
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                if "v" in _shape(stem):
                    if stem.endswith(("at", "bl", "iz")):
                        stem += "e"
                    elif _shape(stem)[-2:] == "cc" and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                        stem = stem[:-1]
                    elif _measure(stem) == 1 and _ends_cvc(stem):
                        stem += "e"
                    word = stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP_2, _ENDS_2), _STEP_3, _ENDS_3)
    if word.endswith(_ENDS_4):
        suffix = next(x for x in _LONGEST_FIRST if word.endswith(x))
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    # final e, double l
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


_PLACED = T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("pos", T.IntegerType())]))


def placed_stems(words: pa.Array, wanted: frozenset[str] | None = None) -> pa.Array:
    """Stems of lists of words with their positions, without stop words; each distinct word of a batch is
    stemmed once."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(words.flatten())
    each = coded.dictionary.to_pylist()
    stems = [stem_word(w) for w in each]
    kept = np.array([w not in _STOP_WORDS and (wanted is None or x in wanted) for w, x in zip(each, stems)], bool)
    at = coded.indices.to_numpy()
    here = kept[at]
    row = np.repeat(np.arange(len(words)), lengths)
    pos = np.arange(len(at)) - (np.cumsum(lengths) - lengths)[row] + 1
    ends = np.cumsum(np.bincount(row[here], minlength=len(words)))
    lexemes = pa.array(stems, pa.string()).take(pa.array(at[here]))
    places = pa.StructArray.from_arrays([lexemes, pa.array(pos[here], pa.int32())], ["lexeme", "pos"])
    offsets = pa.array(np.r_[0, ends], pa.int32())
    return pa.ListArray.from_arrays(offsets, places, mask=words.is_null() if words.null_count else None)


def lexeme_positions(
    text: Column, stem: bool = True, wanted: list[str] | None = None
) -> Column:
    """``array<struct<lexeme, pos>>`` without stop words; positions count every
    word from 1.  ``wanted`` keeps only these lexemes."""
    words = tokens(text)
    if stem:
        chosen = None if wanted is None else frozenset(wanted)

        def run(lists: pa.Array) -> pa.Array:
            return placed_stems(lists, chosen)

        return F.arrow_udf(run, _PLACED)(words)
    placed = F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("pos")))

    def kept(p: Column) -> Column:
        content = ~p["lexeme"].isin(fv.TEXT_STOP_WORDS)
        return content if wanted is None else p["lexeme"].isin(wanted) & content

    return F.filter(placed, kept)


def may_contain(text: Column, lexemes: list[str], stem: bool = True) -> Column:
    """Cheap test that holds for every text with one of the lexemes.  Stemming
    changes at most the last two letters of what it keeps of a word."""
    starts = [x[:-2] if stem else x for x in lexemes]
    if any(len(x) < 2 for x in starts):
        return F.lit(True)
    lowered = F.lower(text)
    hit = F.lit(False)
    for x in dict.fromkeys(starts):
        hit = hit | lowered.contains(x)
    return hit


def query_lexemes(query: str, stem: bool = True) -> list[str]:
    """Distinct lexemes of a query text, by the rules of the documents."""
    import regex

    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if w]
    words = [w for w in words if w not in fv.TEXT_STOP_WORDS]
    return list(dict.fromkeys(stem_word(w) if stem else w for w in words))
