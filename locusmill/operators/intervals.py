"""Intervals of texts that meet, and what is left of them (ALN-01, ARR-16, ARR-19, JN-18, WIN-16).

Intervals are [start, stop) in code points of the text that ``key`` names. Two tables of them meet in
an equi-join on bins of ``BIN`` code points; a pair is taken in the first bin both touch, so it comes
once, and no interval is held against those far from it.

Defined cases: empty intervals, those with a null end and those without a key meet nothing; repeated intervals meet
as often as they are repeated; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.operators.spans import once, sums_of

BIN = 512


def lengths_placed(pieces: Column) -> Column:
    """Pieces of a text with their places in it: an array of n, start, stop and text."""
    placed = lambda ps: F.transform(
        F.arrays_zip(ps.alias("t"), sums_of(F.transform(ps, lambda p: F.length(p).cast("bigint"))).alias("at")),
        lambda z, i: F.struct(i.alias("n"), z["at"].cast("int").alias("start"), (z["at"] + F.length(z["t"])).cast("int").alias("stop"), z["t"].alias("text")),
    )
    return once(pieces, placed)


def _binned(rows: DataFrame, start: str, stop: str, width: int) -> DataFrame:
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))
    return rows.where(F.col(start) < F.col(stop)).withColumn("_bin", F.explode(bins))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Every pair of intervals that share a code point: all columns of ``left`` (``key``, start, stop) and those of ``right`` (``key``, from, to)."""
    both = _binned(left, "start", "stop", width).join(_binned(right, "from", "to", width), [key, "_bin"])
    first = F.floor(F.greatest("start", "from") / width)
    return both.where((F.col("start") < F.col("to")) & (F.col("from") < F.col("stop")) & (F.col("_bin") == first)).drop("_bin")


def markers(sentences: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """ALN-01: the part of each sentence that lies on each text node: ``key``, sentence, node, first and last offset in the node.

    ``sentences`` has sentence, start and stop, ``nodes`` node, start and stop.
    """
    met = overlaps(sentences.select(key, "sentence", "start", "stop"), nodes.select(key, "node", F.col("start").alias("from"), F.col("stop").alias("to")), key)
    return met.select(key, "sentence", "node", (F.greatest("start", "from") - F.col("from")).alias("first"), (F.least("stop", "to") - F.col("from")).alias("last"))


def subtracted(intervals: DataFrame, holes: DataFrame, key: str, name: str) -> DataFrame:
    """ARR-16: what is left of each interval (``key``, ``name``, start, stop) without the holes (``key``, start, stop): ``key``, ``name``, part, start, stop.

    Holes may overlap. An interval that is all holes has no part.
    """
    mine = intervals.select(key, name, "start", "stop").where(F.col("start") < F.col("stop"))
    met = overlaps(mine, holes.select(key, F.col("start").alias("from"), F.col("stop").alias("to")), key)
    own = {c: f"_own_{c}" for c in (key, name, "start", "stop")}
    cut = met.groupBy(*(F.col(c).alias(o) for c, o in own.items())).agg(F.collect_set(F.struct(F.greatest("start", "from").alias("a"), F.least("stop", "to").alias("b"))).alias("_holes"))
    same = F.lit(True)
    for c, o in own.items():
        same &= F.col(c).eqNullSafe(F.col(o))
    all_ = mine.join(cut, same, "left").drop(*own.values())
    # A part begins behind a hole that no other reaches over, and ends at the next hole.
    edge = F.coalesce("_holes", F.expr("cast(array() as array<struct<a:int,b:int>>)"))
    ends = F.concat(F.array(F.struct(F.col("start").cast("int").alias("a"), F.col("start").cast("int").alias("b"))), F.array_sort(edge), F.array(F.struct(F.col("stop").cast("int").alias("a"), F.col("stop").cast("int").alias("b"))))
    each = all_.select(key, name, "start", "stop", F.posexplode(ends).alias("_i", "_e"))
    upto = W.partitionBy(key, name, "start", "stop").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    gaps = each.withColumn("_from", F.max("_e.b").over(upto)).where(F.col("_from") < F.col("_e.a"))
    part = F.row_number().over(W.partitionBy(key, name, "start", "stop").orderBy("_i"))
    return gaps.select(key, name, part.alias("part"), F.col("_from").alias("start"), F.col("_e.a").alias("stop"))


#: The only characters that may stand between two pieces of a source (WIN-16).
GAP = r"(?U)[\s\d.,，、;:()\[\]–−-]*"


def reference_gap(gap: Column, numbers: Column) -> Column:
    """WIN-16: whether a gap holds nothing but digits and marks, and no number but those of ``numbers``, an array of texts."""
    found = F.regexp_extract_all(gap, F.lit(r"\d+"), F.lit(0))
    return F.regexp_like(gap, F.lit(rf"\A{GAP}\z")) & (F.size(F.array_except(found, numbers)) == 0)


def sentence_bounds(text: Column, sentences: Column, saved: Column) -> Column:
    """JN-18: start and stop of each saved sentence (text, start, stop, ordinal) in a paragraph, or null.

    The stored offsets hold if the text stands there; else the sentence of that ordinal, from 0, if
    it reads the same; else the only place where the text stands. ``sentences`` has start, stop and text.
    """

    def at(s: Column) -> Column:
        put = lambda start: F.struct(start.cast("int").alias("start"), (start + F.length(s["text"])).cast("int").alias("stop"))
        stored = (s["start"] >= 0) & (s["stop"] >= s["start"]) & (F.substring(text, s["start"] + 1, s["stop"] - s["start"]) == s["text"])
        own = F.get(sentences, s["ordinal"])
        # Looked for last, and once: each search reads the text.
        only = once(F.instr(text, s["text"]), lambda first: F.when((first > 0) & (F.position(s["text"], text, first + 1) == 0), put(first - 1)))
        held = F.when(stored, put(s["start"])).when((s["ordinal"] >= 0) & (own["text"] == s["text"]), put(own["start"])).otherwise(only)
        return F.when(F.length(s["text"]) > 0, held)

    return F.transform(saved, at)
