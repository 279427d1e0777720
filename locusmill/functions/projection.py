"""Texts after a normaliser, with maps that lead back to raw offsets (FN-03, ARR-15, ARR-18).

A projection is a struct of ``text`` and ``maps``, one map for each step that changed something. A
map lists the stretches that a step left as they were: at (where one begins after the step), raw
(where it began before it) and n (its length); between two of them stands what was replaced or
left out. Steps are Catalyst expressions but composition (NFKC); only texts that a step changes get
a map, and a stretch costs 12 bytes.

An offset is led back through the maps from the last to the first, in each by bisection. A start that falls
into replaced text leads to where it begins, a stop to where it ends, so a range of the
normalised text is led back to the shortest raw range that covers it; what was dropped at either side
of it is left out. ``into`` leads a raw range forward by the same rule.

Defined cases: a null text counts as empty; offsets are code points, stops exclusive; an offset behind the
text leads behind the raw text; texts of any length are taken whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from locusmill.functions.text import INLINE_TAGS, text_of
from locusmill.operators.spans import count_up_to, once, sums_of

MAP = "array<struct<at:int,raw:int,n:int>>"
#: White space that isn't one plain space.
LOOSE_SPACE = r"(?U)[\s\x{FEFF}&&[^ ]][\s\x{FEFF}]*| [\s\x{FEFF}]+"

Step = Callable[[Column], Column]


def raw(column: str | Column) -> Column:
    """A text that stands for itself."""
    return F.struct(text_of(column).alias("text"), F.expr(f"cast(array() as array<{MAP}>)").alias("maps"))


def replaced(pattern: str, by: str = "", first: int = 0, last: int = 0) -> Step:
    """Every match of ``pattern`` becomes ``by``; its first and last characters, as many as said, stay."""
    keeping = f"(?s)^(.{{{first}}}).*(.{{{last}}})$"

    def change(held: Column) -> Column:
        pieces, found = F.split(held["text"], pattern, -1), F.regexp_extract_all(held["text"], F.lit(pattern), F.lit(0))
        return once(F.struct(pieces.alias("pieces"), found.alias("found")), lambda cut: made(held, cut))

    def made(held: Column, cut: Column) -> Column:
        n = F.size(cut["found"])
        # A kept character belongs to the stretch beside it.
        long = F.transform(cut["pieces"], lambda p, i: (F.length(p) + F.when(i > 0, last).otherwise(0) + F.when(i < n, first).otherwise(0)).cast("bigint"))
        gone = F.concat(F.transform(cut["found"], lambda m: (F.length(m) - first - last).cast("bigint")), F.array(F.lit(0).cast("bigint")))
        before = sums_of(F.zip_with(long, gone, lambda a, b: a + b))
        put = sums_of(F.transform(long, lambda a: a + len(by)))
        stretch = lambda z, _: F.struct(z["at"].cast("int").alias("at"), z["raw"].cast("int").alias("raw"), z["n"].cast("int").alias("n"))
        map_ = F.transform(F.arrays_zip(put.alias("at"), before.alias("raw"), long.alias("n")), stretch)
        new = F.transform(cut["found"], lambda m: F.regexp_replace(m, keeping, "$1" + by + "$2") if first or last else F.lit(by))
        text = F.array_join(F.flatten(F.zip_with(cut["pieces"], F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
        return F.struct(text.alias("text"), F.concat(held["maps"], F.array(map_)).alias("maps"))

    return lambda p: once(p, lambda held: F.when(F.regexp_like(held["text"], F.lit(pattern)), change(held)).otherwise(held))


def same_length(change: Callable[[Column], Column]) -> Step:
    """A step that puts one character for each, such as a translation of marks."""
    return lambda p: once(p, lambda held: F.struct(change(held["text"]).alias("text"), held["maps"].alias("maps")))


def lower_cased(p: Column) -> Column:
    """Lower case; of all letters only U+0130 becomes two."""
    return same_length(F.lower)(replaced("İ", "i̇")(p))


def composition(text: str) -> tuple[str, list[tuple[int, int, int]] | None]:
    """A text in NFKC, and its map; no map where nothing changes.

    A piece ends before each character that composes with nothing in front of it, so that few
    characters share one replacement.
    """
    if unicodedata.is_normalized("NFKC", text):
        return text, None
    out, stretches, at, start = [], [], 0, 0
    for m in re.finditer(r"[\x00-\x7f]+(?![^\x00-\x7f])|[\x00-\x7f]*?[\x00-\x7f]?[^\x00-\x7f]+", text):
        piece = m[0]
        whole = unicodedata.normalize("NFKC", piece)
        units: list[str] = []
        for c in piece:
            form = unicodedata.normalize("NFKC", c)
            last = units[-1] if units else ""
            if last and (unicodedata.combining(form[0]) or unicodedata.normalize("NFKC", last + c) != unicodedata.normalize("NFKC", last) + form):
                units[-1] = last + c
            else:
                units.append(c)
        forms = [unicodedata.normalize("NFKC", u) for u in units]
        if "".join(forms) != whole:
            units, forms = [piece], [whole]
        for unit, form in zip(units, forms, strict=True):
            if unit == form:
                if stretches and stretches[-1][0] + stretches[-1][2] == at and stretches[-1][1] + stretches[-1][2] == start:
                    stretches[-1] = (*stretches[-1][:2], stretches[-1][2] + len(unit))
                else:
                    stretches.append((at, start, len(unit)))
            elif not stretches:
                stretches.append((0, 0, 0))
            at, start = at + len(form), start + len(unit)
            out.append(form)
    if not stretches or stretches[-1][0] + stretches[-1][2] < at or stretches[-1][1] + stretches[-1][2] < start:
        stretches.append((at, start, 0))
    return "".join(out), stretches


_STRETCH = StructType([StructField(n, IntegerType()) for n in ("at", "raw", "n")])


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("map", ArrayType(_STRETCH))]))
def _composed(texts: pd.Series) -> pd.DataFrame:
    found = [composition(t) for t in texts]
    as_rows = lambda m: None if m is None else [{"at": a, "raw": r, "n": n} for a, r, n in m]
    return pd.DataFrame({"text": [t for t, _ in found], "map": [as_rows(m) for _, m in found]})


def composed(column: str | Column) -> Column:
    """A raw text in NFKC."""
    made = _composed(text_of(column))
    return F.struct(made["text"].alias("text"), F.when(made["map"].isNotNull(), F.array(made["map"])).otherwise(F.expr(f"cast(array() as array<{MAP}>)")).alias("maps"))


def _through(p: Column, steps: list[Step]) -> Column:
    for step in steps:
        p = step(p)
    return p


_TRIMMED = replaced(r"\A +| +\z")


def prose_of(p: Column) -> Column:
    """``normal_prose`` of a projection in NFKC."""
    quotes = same_length(lambda t: F.translate(t, "‘’“”", "''\"\""))
    return _through(p, [replaced(r"[A-Za-z]-\s*\n\s*[A-Za-z]", "", 1, 1), quotes, replaced(LOOSE_SPACE, " "), _TRIMMED, lower_cased])


def readable_of(p: Column) -> Column:
    """``readable`` of a projection (FN-03)."""
    return _through(p, [replaced(INLINE_TAGS, " "), replaced("(?i)&nbsp;", " "), replaced(LOOSE_SPACE, " "), _TRIMMED])


def quote_key_of(p: Column) -> Column:
    """``letters_and_digits`` of a projection in NFKC (ARR-18)."""
    return _through(p, [lower_cased, replaced(r"[^\p{L}\p{N}]+")])


def _led(stretches: Column, x: Column, here: str, there: str, stop: bool) -> Column:
    def at(n: Column) -> Column:
        own, next_ = F.get(stretches, n - 1), F.get(stretches, n)
        inside = (x - own[here] <= own["n"]) if stop else ((x - own[here] < own["n"]) | next_[here].isNull())
        beside = next_[there] if stop else own[there] + own["n"]
        # Before the first stretch nothing stands but what was replaced.
        return F.when(n == 0, F.lit(0)).when(inside, own[there] + x - own[here]).otherwise(F.coalesce(beside, own[there] + own["n"]))

    return once(count_up_to(stretches, x, lambda s: s[here], strict=stop), at)


def back(maps: Column, start: Column, stop: Column) -> Column:
    """start and stop in the raw text of a range of the normalised one."""
    lead = lambda x, stop: F.aggregate(F.reverse(maps), x.cast("int"), lambda x, m: _led(m, x, "at", "raw", stop))
    return F.struct(lead(start, False).alias("start"), lead(stop, True).alias("stop"))


def _led_all(at: np.ndarray, raw: np.ndarray, n: np.ndarray, x: np.ndarray, stop: bool) -> np.ndarray:
    """``_led`` from ``at`` to ``raw`` for many offsets."""
    k = np.searchsorted(at, x, side="left" if stop else "right")
    own, next_ = np.maximum(k - 1, 0), np.minimum(k, len(at) - 1)
    last, behind = k >= len(at), raw[own] + n[own]
    past = x - at[own]
    inside = past <= n[own] if stop else (past < n[own]) | last
    beside = np.where(last, behind, raw[next_]) if stop else behind
    return np.where(k == 0, 0, np.where(inside, raw[own] + past, beside))


@F.pandas_udf(ArrayType(StructType([StructField(n, IntegerType()) for n in ("start", "stop")])))
def _back_all(at: pd.Series, raw: pd.Series, n: pd.Series, sizes: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    def one(at, raw, n, sizes, start, stop) -> list[dict[str, int]]:
        ends = np.cumsum(sizes)
        for size, end in zip(sizes[::-1], ends[::-1], strict=True):
            own = slice(end - size, end)
            start, stop = (_led_all(at[own], raw[own], n[own], x, is_stop) for x, is_stop in ((start, False), (stop, True)))
        return [{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)]

    return pd.Series([one(*row) for row in zip(at, raw, n, sizes, starts, stops, strict=True)])


def back_all(maps: Column, starts: Column, stops: Column) -> Column:
    """``back`` of many ranges, given as two arrays: an array of start and stop. Catalyst has no bisection, and a lambda's costs a microsecond a step."""
    flat = lambda name: F.transform(F.flatten(maps), lambda s: s[name])
    return _back_all(flat("at"), flat("raw"), flat("n"), F.transform(maps, lambda m: F.size(m)), starts.cast("array<int>"), stops.cast("array<int>"))


def into(maps: Column, start: Column, stop: Column) -> Column:
    """start and stop in the normalised text of a raw range: the inverse of ``back``."""
    lead = lambda x, stop: F.aggregate(maps, x.cast("int"), lambda x, m: _led(m, x, "raw", "at", stop))
    return F.struct(lead(start, False).alias("start"), lead(stop, True).alias("stop"))


def slice_of(ends: Column, start: Column, stop: Column) -> Column:
    """ARR-15: the part of a text that lies in pieces, by their sorted ends: first and last piece, and the offsets in them.

    A start between two pieces belongs to the later one, a stop to the earlier one. Null where the
    range is empty or leaves the pieces.
    """
    base = lambda n: F.when(n > 0, F.get(ends, n - 1)).otherwise(0)
    both = F.struct(count_up_to(ends, start).alias("a"), count_up_to(ends, stop, strict=True).alias("b"))
    cut = once(both, lambda s: F.struct(
        s["a"].alias("first"), (start - base(s["a"])).cast("int").alias("first_at"), s["b"].alias("last"), (stop - base(s["b"])).cast("int").alias("last_at"),
    ))
    return F.when((start >= 0) & (start < stop) & (stop <= F.element_at(ends, -1)), cut)
