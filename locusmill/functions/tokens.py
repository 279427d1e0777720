"""Tokens, runs of tokens and measures over them (ARR-01, ARR-02, ARR-09, ARR-10, AGG-07, WIN-07)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusmill.functions.text import normal_prose, same_dashes

WORD = r"[\p{L}\p{N}]+"
# Scientific tokens, clause cuts and Chinese sentences (ARR-02, ARR-09, ARR-10).
SCIENCE = r"[\p{L}][\p{L}\p{N}]*|[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:e[+-]?\d+)?|[<>=≤≥≠±]"
CLAUSE_CUT = r"(?i)[,;]\s+(?=(?:which|where|whereas|however|these|this|they|it|although|while|but|and)\b)"
CJK_SENTENCE = r"[^。！？]+[。！？][”’」』）)\]]*"
#: Between two sentences: behind the last of their closing marks. Linear in texts without any mark.
SENTENCE_END = r"(?<=[.!?])(?![.!?])"


def word_tokens(column: str | Column, composed: bool = False) -> Column:
    return F.regexp_extract_all(normal_prose(column, composed), F.lit(WORD), F.lit(0))


def science_tokens(column: str | Column, composed: bool = False) -> Column:
    """Words, signed numbers and comparators; a sign and its digits are one token."""
    text = F.regexp_replace(same_dashes(normal_prose(column, composed)), r"([+-])\s+(?=\d)", "$1")
    return F.regexp_extract_all(text, F.lit(SCIENCE), F.lit(0))


def plain_sentences(text: Column, most: int | None = None) -> Column:
    """Sentences of at least eight characters by their closing marks alone: all, or the first ``most``.

    Marks before any other character and what stands behind the last mark belong to no sentence.
    """
    found = F.transform(F.split(F.regexp_replace(text, r"\A[.!?]+", ""), SENTENCE_END, -1), lambda s: F.when(F.regexp_like(s, F.lit(r"[.!?]\z")), F.trim(s)))
    found = F.filter(found, lambda s: F.length(s) >= 8)
    return found if most is None else F.slice(found, 1, most)


def _joined(parts: list[Column], n: Column, join) -> Column:
    """Entry i of the first array with entry i + 1 of the second and so on, for every i that all have; each part has ``n`` entries.

    Lengths come from ``n``, so that no array is named, and made, more than once.
    """
    total = parts[0]
    for done, part in enumerate(parts[1:], 1):
        length = F.greatest(n - done, F.lit(0))
        total = F.zip_with(F.slice(total, F.lit(1), length), F.slice(part, F.lit(done + 1), length), join)
    return total


def run_hashes(parts: list[Column], n: Column) -> Column:
    """Hashes of entry i of the first array, entry i + 1 of the second and so on, each array of ``n`` entries."""
    return _joined(parts, n, lambda a, b: F.xxhash64(a, b))


def char_grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters."""
    return _joined([F.split(F.regexp_replace(text, r"(?s)(?<=.)(?=.)", "\x01"), "\x01", -1)] * size, F.length(text), lambda a, b: F.concat(a, b))


def char_run_hashes(text: Column, doublings: int) -> Column:
    """Hashes of all runs of 2 ** ``doublings`` characters; each doubling joins a run with the one behind it."""
    hashes = F.transform(F.split(F.regexp_replace(text, r"(?s)(?<=.)(?=.)", "\x01"), "\x01", -1), lambda c: F.xxhash64(c))
    for i in range(doublings):
        hashes = _doubled(hashes, 1 << i)
    return hashes


def _doubled(hashes: Column, step: int) -> Column:
    """Each hash with the one ``step`` behind it; a lambda with a second parameter, even one with a default, would be given the index for it."""
    n = lambda h: F.greatest(F.size(h) - step, F.lit(0))
    both = lambda h: F.zip_with(F.slice(h, F.lit(1), n(h)), F.slice(h, F.lit(step + 1), n(h)), lambda a, b: F.xxhash64(a, b))
    return F.get(F.transform(F.array(hashes), both), F.lit(0))


def cjk_sentences(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(CJK_SENTENCE), F.lit(0))


def windows(items: Column, least: int = 2, most: int = 5) -> Column:
    """All runs of ``least`` to ``most`` neighbours, as structs of size, start and text."""

    def of(size: Column) -> Column:
        starts = F.when(F.size(items) >= size, F.sequence(F.lit(1), F.size(items) - size + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.struct(size.alias("size"), (i - 1).alias("start"), F.array_join(F.slice(items, i, size), " ").alias("text")))

    return F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), of))


def clauses(sentence: Column) -> Column:
    """What stands between two cuts of a sentence, with the mark and the space behind it."""
    return F.split(F.regexp_replace(sentence, CLAUSE_CUT, "$0\x01"), "\x01", -1)


def sized_spans(parts: Column, least: Column, most: Column) -> Column:
    """``clause_spans`` of one sentence's ``parts`` (pieces, before: the characters before each) that may have ``least`` to ``most`` characters.

    Sizes come from sums, so only such spans are made; a span has up to two spaces at its ends, so it may be shorter by two.
    """
    pieces, before = parts["pieces"], parts["before"]
    n = F.size(pieces)
    size = lambda i, j: F.get(before, j - 1) + F.length(F.get(pieces, j - 1)) - F.get(before, i - 1)
    ends = lambda i: F.filter(F.sequence(i, n), lambda j: (size(i, j) >= least) & (size(i, j) <= most + 2))
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(ends(i), lambda j: F.trim(F.array_join(F.slice(pieces, i, j - i + 1), "")))))


def clause_spans(sentence: Column) -> Column:
    """Every span between two cuts of a sentence; a cut stands behind a mark before a connective."""
    pieces = clauses(sentence)
    n = F.size(pieces)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return F.transform(pairs, lambda p: F.trim(F.array_join(F.slice(pieces, p["i"], p["j"] - p["i"] + 1), "")))


def mapping_candidates(paragraph: Column, sentences: Column) -> Column:
    """The paragraph, its sentences, their clauses and the windows of two to five sentences: distinct, of at least eight characters."""
    clauses = F.flatten(F.transform(sentences, clause_spans))
    runs = F.transform(windows(sentences), lambda w: w["text"])
    return F.filter(F.array_distinct(F.concat(F.array(paragraph), sentences, clauses, runs)), lambda c: F.length(c) >= 8)


def bigrams(text: Column) -> Column:
    """All pairs of neighbouring characters."""
    return char_grams(text, 2)
