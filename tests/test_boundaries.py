"""Boundaries that are put back on evidence, case by case."""

from __future__ import annotations

import random

from locusmill.operators import boundaries

FIELDS = "paragraph_id int, idx int, text string, source string, gap string, failed boolean, blocked boolean"


def repaired(spark, paragraphs, grouped=True):
    rows = [(p, i, t, s, g, f, b) for p, pieces in enumerate(paragraphs) for i, (t, s, g, f, b) in enumerate(pieces)]
    found = boundaries.repaired(spark.createDataFrame(rows, FIELDS).repartition(3), grouped).orderBy("paragraph_id", "idx").collect()
    return [[r.text for r in found if r.paragraph_id == p] for p in range(len(paragraphs))]


def pieces(*pairs, gap="", failed=None, blocked=None):
    return [(t, s, gap, failed, blocked) for t, s in pairs]


CUT = (("细胞", "Cdh5 grows in cells."), ("Cdh5显示。再见Abc。", "Abc follows it."), ("末。", "The end."))
COMPOUND = (("一句。Cre", "One ends."), ("阴性细胞。", "Cre-negative cells stay."))
SPLIT = (("一句。Cre", "One ends."), ("-neg细胞。", "These Cre-neg cells stay."))


def test_cases(spark):
    found = repaired(
        spark,
        [
            pieces(*CUT), pieces(*CUT, gap="[3]"), pieces(*CUT, blocked=True), pieces(*CUT, failed=True), pieces(*COMPOUND), pieces(*SPLIT),
            pieces(("一句。Cre", "One ends"), ("阴性细胞。", "Cre-negative cells stay.")), pieces(("一句。Xq", "One ends."), ("阴性细胞。", "Cre-negative cells stay.")),
            pieces((None, None)), pieces(("甲。乙", "One ends. Two ends."), ("丙。", "Three.")), pieces(("甲。乙 ", "One ends."), ("丙。", "Three.")),
        ],
    )
    whole = ["细胞Cdh5显示。", "再见Abc。", "末。"]
    assert found[0] == whole and found[1] == ["细胞[3]Cdh5显示。", *whole[1:]]
    assert found[2] == found[3] == [t for t, _ in CUT]
    assert found[4] == ["一句。", "Cre阴性细胞。"] and found[5] == ["一句。", "Cre-neg细胞。"]
    assert found[6][0] == "一句。Cre" and found[7][0] == "一句。Xq" and found[8] == [""] and found[9] == ["甲。乙", "丙。"] and found[10] == ["甲。", "乙 丙。"]
    single = repaired(spark, [pieces(*CUT), pieces(*COMPOUND), pieces(*SPLIT)], grouped=False)
    assert single == [[t for t, _ in CUT], [t for t, _ in COMPOUND], ["一句。", "Cre-neg细胞。"]]


def test_a_boundary_that_moved_changes_the_next(spark):
    """The piece in the middle is unfinished only after its ending went back to the first."""
    row = pieces(("细胞", "Aaa grows."), ("Aaa完。中间Bbb。剩余", "Bbb sits."), ("Ccc完。", "Ccc ends."))
    assert repaired(spark, [row]) == [["细胞Aaa完。", "中间Bbb。", "剩余Ccc完。"]]


def test_nothing_is_lost(spark):
    rng = random.Random(5)
    bits, words = ["细胞", "。", "！", "Cdh5", "Cre", "-neg", "见", " "], ["Cdh5", "Cre", "Cre-neg", "cells", "grow"]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
    rows = [[(say(), " ".join(rng.choice(words) for _ in range(3)) + ".", "", rng.random() < 0.1, rng.random() < 0.1) for _ in range(rng.randrange(1, 6))] for _ in range(200)]
    for grouped in (True, False):
        assert ["".join(t) for t in repaired(spark, rows, grouped)] == ["".join(t for t, *_ in r) for r in rows]
