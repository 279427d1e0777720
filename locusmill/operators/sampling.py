"""Cases for an evaluation, drawn from texts by rule (SRC-15 to SRC-17, SRT-12, FN-28, FN-29). Nothing leaves its row.

Defined cases: null texts give no case; texts with too few blocks or words give fewer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusmill.functions.text import letters_and_digits
from locusmill.operators.spans import once


def words_of(block: Column) -> Column:
    return F.filter(F.split(F.trim(block), r"\s+"), lambda w: w != "")


def blocks_of(text: Column, least: int = 12) -> Column:
    """The lines of a text that have at least ``least`` words."""
    return F.filter(F.split(text, "\n", -1), lambda b: F.size(words_of(b)) >= least)


def joined_lines(block: Column) -> Column:
    """Words broken at a line's end are one again where the next line goes on in lower case."""
    return F.regexp_replace(block, r"([A-Za-z])-\s+(?=[a-z])", "$1")


def ends_and_middle(blocks: Column) -> Column:
    """Places of the first, the middle and the last entry, each once."""
    n = F.size(blocks)
    return F.when(n > 0, F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1))).otherwise(F.expr("cast(array() as array<int>)"))


def block_cases(text: Column, most_words: int = 60, least_chars: int = 40) -> Column:
    """place and text of the sampled blocks of a text, cut to ``most_words``; short ones are left out."""
    blocks = blocks_of(text)
    cut = F.transform(ends_and_middle(blocks), lambda i: F.struct(i.alias("place"), F.array_join(F.slice(words_of(joined_lines(F.get(blocks, i))), 1, most_words), " ").alias("text")))
    return F.filter(cut, lambda c: F.length(c["text"]) >= least_chars)


def short_cases(block: Column, sizes: tuple[int, ...] = (5, 12, 20), context: int = 96) -> Column:
    """region, size, exact, prefix and suffix of windows at the start, the middle and the end of a block."""
    return once(words_of(block), lambda words: _short_cases(words, sizes, context))


def _short_cases(words: Column, sizes: tuple[int, ...], context: int) -> Column:
    n = F.size(words)

    def case(region: str, size: int, at: Column) -> Column:
        # As many words as there are characters of context fill it.
        some = F.least(at, F.lit(context))
        before, after = F.array_join(F.slice(words, at - some + 1, some), " "), F.array_join(F.slice(words, at + size + 1, F.lit(context)), " ")
        return F.struct(
            F.lit(region).alias("region"), F.lit(size).alias("size"), F.array_join(F.slice(words, at + 1, size), " ").alias("exact"),
            F.right(before, F.lit(context)).alias("prefix"), F.left(after, F.lit(context)).alias("suffix"),
        )

    made = []
    for size in sizes:
        zero = F.lit(0)
        for region, at in (("start", zero), ("middle", F.floor((n - size) / 2).cast("int")), ("end", n - size)):
            made.append(F.when(n >= size, case(region, size, F.greatest(at, zero))))
    return F.filter(F.array(*made), lambda c: c.isNotNull())


def even_places(n: Column, most: int = 12) -> Column:
    """At most ``most`` different places spread evenly over ``n`` entries, ends included."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / (most - 1) + 0.5).cast("int"))
    return F.when(n > 0, F.array_distinct(steps)).otherwise(F.slice(steps, 1, 0))


def ground_truth(needle: Column, blocks: Column) -> Column:
    """The place of the one block that holds a text, compared by letters and digits; null where none or several do (JN-25)."""
    key = letters_and_digits(needle, composed=True)
    hits = F.filter(F.transform(blocks, lambda b, i: F.when(F.contains(letters_and_digits(b, composed=True), key), i)), lambda i: i.isNotNull())
    return F.when((key != "") & (F.size(hits) == 1), F.get(hits, F.lit(0)))
