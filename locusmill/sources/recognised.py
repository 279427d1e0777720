"""Words of recognised pages, from their raw JSON (SRC-04, FLT-05).

A page is an array of width, height and blocks; ``LINES`` leads to its lines, of which each has its words
first; a word is an array with its corners in 0 to 3, whether a space follows in 5, and its text in 13.
Words are numbered through a page, and their texts joined give each its offset.

Defined cases: what is no JSON, or has no lines there, has no words; a line that is no array has
none; a word counts only if its corners are numbers that span a box and its text is a text; a
width or height that is neither a number nor reads as one is 0; a space follows where slot 5 is true, a number but 0, a text but the empty one, or a
structure; half a surrogate pair is a question mark. Offsets are code points; pages of any length are taken whole.

A page is read by an Arrow function: an array of mixed kinds has no type in Catalyst but variant, whose slots are looked up
and typed one by one, some twenty times the work.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

# Where lines, words and the slots of a word are.
LINES, WORDS = (2, 0, 0, 0, 4), 0
SPACE_SLOT, TEXT_SLOT = 5, 13
NUMBER = re.compile(r"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*")
_HALF = re.compile("[\ud800-\udfff]")
_OF_WORD = {"line_index": IntegerType(), "text": StringType(), **dict.fromkeys(("x0", "y0", "x1", "y1"), DoubleType()), "space_after": BooleanType(), "char_offset": IntegerType()}
_READ = StructType([StructField("page_w", DoubleType()), StructField("page_h", DoubleType()), *(StructField(n, ArrayType(t)) for n, t in _OF_WORD.items())])


def _no_number(name: str) -> None:
    raise ValueError(name)


def _at(value: object, place: int) -> object:
    return value[place] if type(value) is list and len(value) > place else None


def _size(value: object) -> float:
    return float(value) if type(value) in (int, float, bool) or type(value) is str and NUMBER.fullmatch(value) else 0.0


def _words(value: object, halves: bool) -> list[tuple]:
    lines = value
    for place in LINES:
        lines = _at(lines, place)
    words, offset, numbers = [], 0, {int, float}
    for i, line in enumerate(lines if type(lines) is list else ()):
        held = _at(line, WORDS)
        for word in held if type(held) is list else ():
            if type(word) is not list or len(word) <= TEXT_SLOT:
                continue
            corners, text = word[:4], word[TEXT_SLOT]
            if type(text) is not str or not numbers.issuperset(map(type, corners)):
                continue
            x0, y0, x1, y1 = map(float, corners)
            if not (x1 > x0 and y1 > y0):
                continue
            space = word[SPACE_SLOT]
            follows = bool(space) or type(space) in (list, dict)
            text = _HALF.sub("?", text) if halves else text
            words.append((i, text, x0, y0, x1, y1, follows, offset))
            offset += len(text) + follows
    return words


def _read_so(page: str, **how) -> tuple:
    value = json.loads(page, parse_constant=_no_number, **how)
    words = _words(value, "\\ud" in page.lower())
    return (_size(_at(value, 0)), _size(_at(value, 1)), *(map(list, zip(*words, strict=True)) if words else ([] for _ in _OF_WORD)))


def read_page(page: str | None) -> tuple:
    """Width, height and, of all words that count, their lines, texts, corners, spaces and offsets, each a list."""
    try:
        return _read_so(page or "")
    except (ValueError, OverflowError, RecursionError):
        # Whole numbers of any size are read as doubles; that is slower.
        try:
            return _read_so(page or "", parse_int=float)
        except (ValueError, RecursionError):
            return (0.0, 0.0, *([] for _ in _OF_WORD))


@F.pandas_udf(_READ)
def _read(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(p) for p in pages], columns=_READ.names)


#: A filter on what is read would otherwise be pushed below the function, which would then read each page again.
_read_once = _read.asNondeterministic()


def page_arrays(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, page_w, page_h and words (line_index, text, x0, y0, x1, y1, space_after, char_offset) of each of ``pages`` (doc_id, page_index, page)."""
    rows = pages.select("doc_id", "page_index", _read_once("page").alias("_r"))
    return rows.select("doc_id", "page_index", "_r.page_w", "_r.page_h", F.arrays_zip(*(F.col(f"_r.{n}").alias(n) for n in _OF_WORD)).alias("words"))


def page_words(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, page_w, page_h, line_index, word_index, text, x0, y0, x1, y1, space_after and char_offset of each word of ``pages`` (doc_id, page_index, page)."""
    each = page_arrays(pages).select("doc_id", "page_index", "page_w", "page_h", F.posexplode("words").alias("word_index", "_w"))
    return each.select("doc_id", "page_index", "page_w", "page_h", "_w.line_index", "word_index", *(f"_w.{n}" for n in _OF_WORD if n != "line_index"))
