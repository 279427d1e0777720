"""A source sentence cut so that each sentence of its translation has the part with its figures (ALN-05, JN-32).

The translation's sentences have the figure references as keys, and so has every stretch of the
source between two cuts. An ordered partition gives each sentence a stretch with its key, all
stretches together being the source. For every cut the number of ways to reach it is counted, sentence
by sentence, up to two; a partition counts only if there is exactly one.

Defined cases: a translation of fewer than ``LEAST_PARTS`` or more than ``MOST_PARTS`` sentences, with text behind the last, with a
sentence without figures or two with the same, has no partition; nor has a source of more
than one sentence, one with more than ``MOST_CUTS`` cuts, or a null one. The bound on cuts is the
rule's own, not one of cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.functions.text import figure_keys, stripped, text_of
from locusmill.functions.tokens import CLAUSE_CUT
from locusmill.operators.spans import once, sums_of

LEAST_PARTS, MOST_PARTS, MOST_CUTS = 2, 6, 18
#: Fixed value: a sentence of the translation, with the marks that close behind it.
UNIT = r"[^。！？]+[。！？][”’」』]*"

STATE = "array<struct<ways:int,path:array<int>>>"


def units(translation: Column) -> Column:
    """A struct of units, an array of start, stop and text, and rest, the text behind the last."""
    cut = F.split(F.regexp_replace(translation, f"({UNIT})", "\x01$1\x01"), "\x01", -1)

    def placed(pieces: Column) -> Column:
        at = sums_of(F.transform(pieces, lambda p: F.length(p).cast("bigint")))
        each = F.transform(F.arrays_zip(pieces.alias("t"), at.alias("at")), lambda z: F.struct(z["at"].cast("int").alias("start"), (z["at"] + F.length(z["t"])).cast("int").alias("stop"), z["t"].alias("text")))
        # Units and what lies between them alternate.
        return F.struct(F.filter(each, lambda _, i: i % 2 == 1).alias("units"), F.element_at(pieces, -1).alias("rest"))

    return once(cut, placed)


def _ways(keys: Column, wanted: Column) -> Column:
    """The cuts after each part of the only partition, null if there is none or there are several.

    ``keys`` has the figure key of each piece of the source between neighbouring cuts, ``wanted`` those of the parts.
    """
    n = F.size(keys)
    key_of = lambda i, j: F.array_join(F.filter(F.slice(keys, i + 1, j - i), lambda k: k != ""), "|")
    start = F.transform(F.sequence(F.lit(0), n), lambda j: F.struct(F.when(j == 0, 1).otherwise(0).alias("ways"), F.expr("cast(array() as array<int>)").alias("path")))

    def after(state: Column, key: Column) -> Column:
        def at(j: Column) -> Column:
            before = F.when(j > 0, F.sequence(F.lit(0), j - 1)).otherwise(F.expr("cast(array() as array<int>)"))
            hits = F.filter(before, lambda i: (F.get(state, i)["ways"] > 0) & (key_of(i, j) == key))

            def held(from_: Column) -> Column:
                total = F.aggregate(from_, F.lit(0), lambda a, i: a + F.get(state, i)["ways"])
                path = F.concat(F.get(state, F.get(from_, F.lit(0)))["path"], F.array(j))
                return F.struct(F.least(total, F.lit(2)).alias("ways"), F.coalesce(path, F.expr("cast(array() as array<int>)")).alias("path"))

            return once(hits, held)

        return F.transform(F.sequence(F.lit(0), n), at)

    return once(F.aggregate(wanted, start, after), lambda state: F.when(F.element_at(state, -1)["ways"] == 1, F.element_at(state, -1)["path"]))


def aligned_parts(rows: DataFrame, key: str, translation: str, source: str, single: Column) -> DataFrame:
    """``key``, part, source (trimmed), start and stop (in the translation) of each part of the rows with exactly one partition.

    ``single`` tells whether the source is one sentence.
    """
    cut = rows.where(single).select(F.col(key), units(text_of(translation)).alias("_u"), F.split(F.regexp_replace(text_of(source), CLAUSE_CUT, "$0\x01"), "\x01", -1).alias("_pieces"))
    cut = cut.where(F.size("_u.units").between(LEAST_PARTS, MOST_PARTS) & (stripped(F.col("_u.rest")) == "") & (F.size("_pieces") < MOST_CUTS))
    cut = cut.select(key, "_u", "_pieces", F.transform("_u.units", lambda u: figure_keys(u["text"])).alias("_wanted"), F.transform("_pieces", lambda p: figure_keys(p)).alias("_keys"))
    cut = cut.where(~F.exists("_wanted", lambda k: k == "") & (F.size(F.array_distinct("_wanted")) == F.size("_wanted")))

    def parts(path: Column) -> Column:
        begin = lambda i: F.when(i > 0, F.get(path, i - 1)).otherwise(0)
        return F.transform("_u.units", lambda u, i: F.struct(F.array_join(F.slice("_pieces", begin(i) + 1, F.get(path, i) - begin(i)), "").alias("source"), u["start"].alias("start"), u["stop"].alias("stop")))

    # Ways are counted once a row: a filter on the path, or the one that a plain explode infers, would count them again.
    made = once(_ways(F.col("_keys"), F.col("_wanted")), lambda path: F.when(path.isNotNull(), parts(path)))
    each = cut.select(key, F.posexplode_outer(made).alias("part", "_p")).where("part is not null")
    return each.select(key, "part", stripped(F.col("_p.source")).alias("source"), "_p.start", "_p.stop")
