"""English sentences with their offsets (ARR-05 to ARR-08, FLT-09, FLT-10).

Boundaries follow the default rules for sentences: behind closing marks, the brackets and quotes
that close with them and white space, unless a full stop goes on into a digit, a lower-case word or
another mark. Full stops of the abbreviations below never end a sentence where what follows goes on
with them, and a numeric reference behind a full stop belongs to the sentence before it. Segments
are cut from the text itself: joined, they are the text.

Defined cases: null and empty texts have no sentence; a text of any length is taken whole; offsets
are code points.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from locusmill.functions.text import readable

SPAN = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("text", StringType())]))

# Abbreviations whose full stops are kept, with what must follow (A.1), and the form of a numeric reference.
KEPT_STOPS = tuple(
    regex.compile(p, f)
    for p, f in (
        (r"(?<![A-Za-z0-9_])(?:figs?|eqs?|refs?|secs?|chaps?)\.(?=\s*(?:S?[0-9]|[IVXLC]+(?![A-Za-z0-9_])))", regex.I),
        (r"(?<![A-Za-z0-9_])(?:nos?|vols?|pp?)\.(?=\s*[0-9])", regex.I),
        (r"(?<![A-Za-z0-9_])(?:e\.g|i\.e)\.", regex.I),
        (r"(?<![A-Za-z0-9_])(?:vs|cf|viz)\.(?=\s+\S)", regex.I),
        (r"(?<![A-Za-z0-9_])(?:Dr|Prof|Mr|Mrs|Ms)\.(?=\s+[A-Z][a-z])", 0),
        (r"(?<![A-Za-z0-9_])(?:Inc|Ltd|Corp|Co)\.(?=\s*\([^)]*\))", 0),
        (r"(?<![A-Za-z0-9_])et\s+al\.(?=\s*(?:\(?[0-9]|[a-z]))", 0),
    )
)
_NUMBERS = r"[0-9]+(?:\s*[,–−-]\s*[0-9]+)*"
REFERENCE = rf"[.!?][)\]\"']*\s*(?:\[\s*{_NUMBERS}\s*\]|{_NUMBERS})"
_REFERENCE_BREAK = regex.compile(rf"(?<=[A-Za-z0-9)]){REFERENCE}(?:\s+(?=[A-Z][A-Za-z0-9-])|\s*\Z)")

_CLOSED = r"[\p{Pe}\p{Pf}\p{Pi}\p{Ps}\"']*"
_ENDING = regex.compile(rf"(?P<mark>[.!?。！？])(?P<close>{_CLOSED})(?P<space>[^\S\n\x85\u2028\u2029]*)(?P<line>\r?\n|[\r\x85\u2028\u2029])?|\r?\n|[\r\x85\u2028\u2029]")
_GOES_ON = regex.compile(r"[^\p{L}\n\r\x85\u2028\u2029.!?。！？]*\p{Ll}")


def _stands(text: str, at: int) -> bool:
    """Whether the mark at ``at`` before a reference ends a sentence: not a label such as B.6 nor a plain decimal."""
    if text[at] != ".":
        return True
    token = regex.search(r"[A-Za-z0-9.]*\Z", text[max(0, at - 200) : at])[0]
    if len(token) == 1 and "A" <= token <= "Z":
        return False
    return not ("0" <= text[at - 1 : at] <= "9" and at > 0) or "." in token


def _ends(text: str, masked: set[int]) -> list[int]:
    """Boundaries by the default rules, marks in ``masked`` left out."""
    found = []
    for m in _ENDING.finditer(text):
        at, end = m.start(), m.end()
        if m["mark"] is None or m["line"]:
            if m["mark"] is None or at not in masked:
                found.append(end)
                continue
        if at in masked or end == len(text):
            continue
        following = text[end]
        if following in ".!?。！？,:;-–—、，：；":
            continue
        if m["mark"] == ".":
            tight = not m["close"] and not m["space"]
            if tight and (following.isnumeric() or at > 0 and text[at - 1].isalpha() and following.isupper()):
                continue
            if _GOES_ON.match(text, end):
                continue
        found.append(end)
    return found


def cut_sentences(text: str) -> list[tuple[int, int]]:
    """Starts and stops of all sentences of a text, without gaps."""
    kept = {m.start() + i for pattern in KEPT_STOPS for m in pattern.finditer(text) for i, c in enumerate(m[0]) if c == "."}
    breaks = [m for m in _REFERENCE_BREAK.finditer(text) if m.start() not in kept and _stands(text, m.start())]
    cuts = set(_ends(text, kept | {m.start() for m in breaks})) | {m.end() for m in breaks}
    edges = [0, *sorted(c for c in cuts if 0 < c < len(text)), len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


@F.pandas_udf(SPAN)
def english_sentences(texts: pd.Series) -> pd.Series:
    """All sentences with their places, white space included."""
    return texts.map(lambda t: [{"start": a, "stop": b, "text": t[a:b]} for a, b in cut_sentences(t or "")])


def sentence_spans(column: str | Column, least: int = 2) -> Column:
    """Sentences of the readable text, trimmed, of at least ``least`` characters, at their places (ARR-07; with 8, ARR-06)."""
    strip = lambda t: F.regexp_replace(t, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+\z", "")
    cut = F.transform(english_sentences(readable(column)), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), strip(s["text"]).alias("text")))
    return F.filter(cut, lambda s: F.length(s["text"]) >= least)


def descriptors(spans: Column, most: int = 100) -> Column:
    """Ordinal, start and stop of each sentence of a paragraph; none at all where there are more than ``most`` (ARR-08)."""
    each = F.transform(spans, lambda s, i: F.struct((i + 1).alias("ordinal"), s["start"].alias("start"), s["stop"].alias("stop")))
    return F.when(F.size(spans).between(1, most), each).otherwise(F.slice(each, 1, 0))


def reference_stands(before: Column, mark: Column) -> Column:
    """FLT-10: whether ``mark`` ends a sentence although a numeric reference follows; ``before`` is the text before it."""
    token = F.regexp_extract(before, r"([A-Za-z0-9.]*)\z", 1)
    return (mark != ".") | (~F.regexp_like(token, F.lit(r"^[A-Z]\z")) & (~F.regexp_like(before, F.lit(r"[0-9]\z")) | F.contains(token, F.lit("."))))


def ends_sentence(column: str | Column) -> Column:
    """FLT-09: whether a text ends at a closing mark, or at a reference behind one."""
    text = readable(column)
    suffix = rf"(?s)^(.*?)({REFERENCE}\s*)\z"
    before, found = F.regexp_extract(text, suffix, 1), F.regexp_extract(text, suffix, 2)
    return F.regexp_like(text, F.lit(r"[.!?][)\]\"']*\z")) | ((found != "") & reference_stands(before, F.left(found, F.lit(1))))
