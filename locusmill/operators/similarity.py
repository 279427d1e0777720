"""Similarity of short texts, margins and shortlists (AGG-07, WIN-13, SRT-06, FN-26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.functions.text import halves_up
from locusmill.functions.tokens import bigrams
from locusmill.operators.spans import once


def bigram_scored(rows: DataFrame, a: str, b: str, name: str = "score") -> DataFrame:
    """``rows`` with the likeness of two of their texts, 0 to 1: the multiset Dice coefficient of their character pairs.

    Where one text holds the other, 0.65 plus 0.35 times the share it covers; 0 where one is empty.
    Nothing leaves its row. The pairs are columns of their own, so each text is cut once.
    """
    cut = rows.withColumn("_left", bigrams(F.col(a))).withColumn("_right", bigrams(F.col(b)))
    # Equal pairs are told apart by their number among their equals, so that two sets have what the multisets share.
    numbered = lambda grams: once(F.sort_array(grams), lambda s: F.transform(s, lambda g, i: F.concat(g, (i - F.array_position(s, g)).cast("string"))))
    common = F.size(F.array_intersect(numbered(F.col("_left")), numbered(F.col("_right"))))
    la, lb = F.length(a), F.length(b)
    inside = F.contains(a, b) | F.contains(b, a)
    score = F.when((la == 0) | (lb == 0), 0.0).when(inside, 0.65 + 0.35 * F.least(la, lb) / F.greatest(la, lb))
    score = halves_up(score.otherwise(2.0 * common / F.greatest(F.lit(1), la + lb - 2)), 6)
    return cut.withColumn(name, score).drop("_left", "_right")


def best_by_margin(scored: DataFrame, keys: list[str], other: str, score: str, least: float = 0.78, lead: float = 0.1) -> DataFrame:
    """The best row of each key with the runner-up's score; accepted if good enough and far enough ahead."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), other)
    ranked = scored.withColumn("_k", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead(score).over(order), F.lit(0.0)))
    accepted = (F.col(score) >= least) & (F.round(F.col(score) - F.col("second"), 6) >= lead)
    return ranked.where("_k = 1").select(*keys, other, score, "second", accepted.alias("accepted"))


def center(whole: Column, part: Column, size: Column) -> Column:
    """Where the middle of the first ``part`` stands in a text of ``size`` characters, as a share; at the start if it isn't there."""
    return (F.greatest(F.position(part, whole) - 1, F.lit(0)) + F.length(part) / 2.0) / size


def position_penalty(translated: Column, selected: Column, source: Column, candidate: Column) -> Column:
    """How far a candidate's place and length in the source are from those of the selection."""
    middle = F.when(F.length(translated) > 0, center(translated, selected, F.length(translated))).otherwise(0.5)
    share = F.least(F.lit(1.0), F.length(selected) / F.greatest(F.lit(1), F.length(translated)))
    wanted = F.greatest(F.lit(24), F.floor(F.length(source) * share + 0.5))
    return 2 * F.abs(center(source, candidate, F.length(source)) - middle) + 0.35 * F.abs(F.length(candidate) - wanted) / wanted
