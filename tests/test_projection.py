"""Texts led back to raw offsets: projections of awkward texts against the normalisers, and long texts."""

from __future__ import annotations

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from locusmill.functions import projection as P
from locusmill.functions import text as T
from locusmill.operators import spans

BITS = ["a", "B", "c-\n d", "x- \n\ny", "-\n", "  ", "\n", "\t ", " ", "﻿", " ", "<sup>", "</ em >", "&nbsp;", "&NBSP;", "‘", "”", "ﬁ", "é", "İ", "𝒳", "½", "ｱﾞ", "가", "1", "é", "."]


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "  a"] + ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)


@pytest.mark.parametrize("name", ["prose", "readable", "key"])
def test_ranges_lead_back_and_forth(spark, awkward, name):
    project, normalise = {
        "prose": (P.prose_of(P.composed("t")), T.normal_prose),
        "readable": (P.readable_of(P.raw("t")), T.readable),
        "key": (P.quote_key_of(P.composed("t")), T.letters_and_digits),
    }[name]
    rows = awkward.select("i", "t", project.alias("p"), normalise("t").alias("norm"))
    assert [r for r in rows.collect() if r.p.text != r.norm] == []
    each = rows.where("length(p.text) > 0").select("*", F.explode(F.sequence(F.lit(0), F.length("p.text") - 1)).alias("a"))
    each = each.select("*", F.explode(F.sequence(F.col("a") + 1, F.least(F.col("a") + 7, F.length("p.text")))).alias("b"))
    each = each.withColumn("r", P.back(F.col("p.maps"), F.col("a"), F.col("b")))
    each = each.withColumn("f", P.into(F.col("p.maps"), F.col("r.start"), F.col("r.stop"))).withColumn("want", F.substring("p.text", F.col("a") + 1, F.col("b") - F.col("a")))
    found = each.select("t", "a", "b", "r", "f", "want").collect()
    # Led forward again a range covers itself; it is itself unless it cut a replaced run in two.
    assert all(r.f.start <= r.a and r.f.stop >= r.b and r.r.start < r.r.stop for r in found)
    whole = [((r.t or "")[r.r.start : r.r.stop], r.want) for r in found if (r.f.start, r.f.stop) == (r.a, r.b) and "-" not in r.want]
    cut = spark.createDataFrame(whole, "cut string, want string").withColumn("got", normalise("cut"))
    assert len(whole) > 500 and cut.where(F.trim("want") != F.col("got")).count() == 0


def test_composition_maps_cover_the_text():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(["a", "é", "́", "ﬁ", "½", "é", "가", "가", " ", "𝒳"]) for _ in range(rng.randrange(12)))
        form, stretches = P.composition(text)
        assert form == unicodedata.normalize("NFKC", text)
        for at, raw, n in stretches or []:
            assert form[at : at + n] == text[raw : raw + n]
        assert stretches is None or stretches == sorted(stretches)


def test_slices_of_pieces(spark):
    ends = F.array(*map(F.lit, (3, 3, 8, 10)))
    def at(a, b):
        row = spark.range(1).select(P.slice_of(ends, F.lit(a), F.lit(b)).alias("s")).first().s
        return row and tuple(row)

    assert [at(0, 3), at(1, 4), at(3, 8), at(9, 10), at(8, 10)] == [(0, 0, 0, 3), (0, 1, 2, 1), (2, 0, 2, 5), (3, 1, 3, 2), (3, 0, 3, 2)]
    assert at(4, 4) is None and at(9, 11) is None and at(-1, 2) is None


def test_sums_of_many_pieces_take_seconds(spark):
    text = "ab " * 60_000 + "x" * 2_000_000
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    began = time.monotonic()
    found = spans.occurrences(docs, "doc_id", "text", "ab ").agg(F.count("*"), F.sum("offset")).first()
    assert tuple(found) == (60_000, sum(range(0, 180_000, 3))) and time.monotonic() - began < 10
    sums = spark.range(40).select(F.col("id"), spans.sums_of(F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda x: x.cast("bigint"))).alias("s"))
    for r in sums.where("id > 0").collect():
        assert r.s == [sum(range(1, i)) for i in range(1, r.id + 1)]
    empty = spark.range(1).select(spans.sums_of(F.expr("cast(array() as array<bigint>)")).alias("s"), spans.sums_of(F.expr("cast(null as array<bigint>)")).alias("n")).first()
    assert empty.s == [] and empty.n is None
