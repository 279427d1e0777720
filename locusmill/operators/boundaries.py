"""Boundaries of translated pieces that drifted, put back on evidence (WIN-08, WIN-09).

A paragraph is a row of pieces, each the translation of one source sentence. A translator moves text
over a boundary: an ending forward into the next piece, or an opening back into the piece before. A
pass forward returns endings, a pass backward openings, each from the first piece to the last,
as a boundary that moved changes what the next one sees. Nothing moves by order or count alone: an
ending needs a scientific token of its own source sentence in it, an opening Chinese text or a
token of the next source sentence.

Each paragraph is one entry of an array, settled by a small function over Arrow batches; paragraphs
are bounded by what a reader sees at once, and never meet.

Defined cases: null texts, sources and gaps count as empty; pieces marked as failed keep their
boundaries, and so do those whose gap holds more than references; a paragraph of one piece stays as
it is; pieces with the same place are taken by their texts; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from locusmill.functions.segment import ends_sentence, sentence_spans
from locusmill.functions.text import text_of

# Closing marks and what closes with them, Chinese letters, dashes, and scientific tokens.
STOPS = "。！？"
CLOSERS = r"[”’」』）)\]]*"
CHINESE = re.compile("[㐀-鿿]")
DASHES = "‐‑‒–—-"
FIRST_ENDING = re.compile(rf"[^{STOPS}]*[{STOPS}]{CLOSERS}")
OPENING = re.compile(rf"[{STOPS}]{CLOSERS}\s*([^{STOPS}]+)\Z")
KEPT_TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9+‐‑–-]{2,}")
SOURCE_TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9+‐‑–-]*")
NEXT_TOKEN = re.compile(rf"[A-Za-z][A-Za-z0-9{DASHES}]*")
GOES_ON = re.compile(rf"\s*([{DASHES}]\s*[A-Za-z0-9][A-Za-z0-9{DASHES}]*)")
GOES_ON_LETTER = re.compile(rf"\s*([{DASHES}]\s*[A-Za-z][A-Za-z0-9{DASHES}]*)")
LATIN = re.compile(rf"[A-Za-z][A-Za-z0-9\s{DASHES}]*")
COMPOUND = re.compile(rf"\s*([A-Za-z][A-Za-z0-9]*)[{DASHES}][A-Za-z0-9]")


class Piece:
    """A piece as the passes see it; ``gap`` is the text between it and the next."""

    def __init__(self, row) -> None:
        self.text, self.source, self.gap = row["text"], row["source"], row["gap"]
        self.single, self.terminal = row["single"], row["terminal"]
        self.fixed = row["failed"] or row["blocked"]
        self.failed = row["failed"]


def _key(token: str) -> str:
    return re.sub(rf"[\s{DASHES}]", "", token.lower())


def _stops(text: str) -> int:
    return sum(text.count(c) for c in STOPS)


def ending_of(one: Piece, two: Piece) -> str:
    """What of the next piece belongs to an unfinished one; empty if nothing is proved."""
    if _stops(one.text) or not CHINESE.search(one.text) or _stops(two.text) != 2:
        return ""
    found = FIRST_ENDING.match(two.text)[0]
    known = {_key(t) for t in SOURCE_TOKEN.findall(one.source)}
    proved = CHINESE.search(found) and any(_key(t) in known for t in KEPT_TOKEN.findall(found))
    return found if proved else ""


def _named_next(opening: str, two: Piece) -> bool:
    """Whether a Latin opening is a token of the next source, or the first half of its leading compound."""
    goes_on = GOES_ON.match(two.text)
    token = _key(opening + (goes_on[1] if goes_on else ""))
    if len(token) < 3 or not LATIN.fullmatch(opening):
        return False
    compound = COMPOUND.match(two.source)
    half = not goes_on and compound is not None and _key(compound[1]) == _key(opening)
    return half or token in {_key(t) for t in NEXT_TOKEN.findall(two.source)}


def opening_of(one: Piece, two: Piece) -> str:
    """What stands behind the last stop of a piece and opens the next; empty if nothing is proved."""
    found = OPENING.search(one.text)
    if not found or not one.terminal or not CHINESE.search(one.text[: found.start()]) or not _stops(two.text) or not CHINESE.search(two.text):
        return ""
    opening = found[1].strip()
    return found[1] if CHINESE.search(opening) or _named_next(opening, two) else ""


def marker_opening_of(one: Piece, two: Piece) -> str:
    """The same for markers that are in no group (WIN-09): one sentence on either side, or a token cut in two."""
    found = OPENING.search(one.text)
    if not found or not one.terminal:
        return ""
    if not CHINESE.search(found[1]):
        goes_on = GOES_ON_LETTER.match(two.text)
        plain = lambda t: re.sub(r"\s+", "", re.sub("[‐‑‒–—]", "-", t.lower()))
        return found[1] if goes_on and plain(found[1] + goes_on[1]) in plain(two.source) else ""
    alone = one.single and two.single and _stops(one.text) == _stops(two.text) == 1
    return found[1] if alone and CHINESE.search(two.text) and CHINESE.search(one.text[: found.start()]) else ""


def settled(pieces: list[Piece], grouped: bool) -> list[str]:
    """The texts of a paragraph's pieces once all boundaries are where they are proved to be."""
    pairs = [(a, b) for a, b in zip(pieces, pieces[1:]) if not (a.fixed or b.failed)]
    if grouped:
        pairs = [(a, b) for a, b in pairs if a.single and b.single]
        for one, two in pairs:
            if ending := ending_of(one, two):
                # What lies between goes with the ending.
                one.text, two.text, one.gap = one.text + one.gap + ending, two.text[len(ending) :], ""
    for one, two in pairs:
        if opening := (opening_of if grouped else marker_opening_of)(one, two):
            one.text, two.text, one.gap = one.text[: -len(opening)], opening + one.gap + two.text, ""
    return [p.text for p in pieces]


def _settle(grouped: bool):
    @F.pandas_udf(ArrayType(StringType()))
    def settle(paragraphs: pd.Series) -> pd.Series:
        return paragraphs.map(lambda rows: settled([Piece(r) for r in rows], grouped))

    return settle


def repaired(pieces: DataFrame, grouped: bool = True) -> DataFrame:
    """paragraph_id, idx and text of all pieces after repair.

    ``pieces`` has paragraph_id, idx, text, source (the English sentence), failed (whether its group can't be used), gap
    (the text up to the next piece) and blocked (whether that gap holds more than references). ``grouped`` says that
    fragments of one sentence were joined; else the stricter rules for single markers hold.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    spans: Column = sentence_spans("source", least=1)
    rows = pieces.select(
        "paragraph_id", "idx", text_of("text").alias("text"), text_of("source").alias("source"), text_of("gap").alias("gap"), flag(F.col("failed")).alias("failed"),
        flag(F.col("blocked")).alias("blocked"), (F.size(spans) == 1).alias("single"), flag(ends_sentence("source")).alias("terminal"),
    )
    fields = ("idx", "text", "source", "gap", "failed", "blocked", "single", "terminal")
    paragraphs = rows.groupBy("paragraph_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_pieces"))
    texts = paragraphs.select("paragraph_id", F.transform("_pieces", lambda p: p["idx"]).alias("_idx"), _settle(grouped)(F.col("_pieces")).alias("_texts"))
    each = texts.select("paragraph_id", F.explode(F.arrays_zip("_idx", "_texts")).alias("_p"))
    return each.select("paragraph_id", F.col("_p._idx").alias("idx"), F.col("_p._texts").alias("text"))
