"""Rules of scientific text: reference ranges, compact text, compatibility forms, item tiers, laid-out pages."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from locusmill.functions import text as T
from locusmill.functions.segment import cut_sentences
from locusmill.operators import catalog, geometry, records


@pytest.mark.parametrize(
    "run,expected",
    [("54–56", "54,55,56"), ("54 – 56", None), ("3,54–56", "3,54,55,56"), ("3 , 54-56", "3,54,55,56"), ("56–54", None), ("1–21", ",".join(map(str, range(1, 22)))), ("1–22", None), ("1–2–3", None), ("007–9", "7,8,9"), ("4,7–9,05", "4,7,8,9,05")],
)
def test_reference_ranges(run, expected):
    assert T.expand_run(run) == expected


CASES = {
    "The value rose [3‐5] to 5": "thevalueroseto5", "at [3–5, 7] it": "atit", "is −5 mV": "is-5mv", "a - b": "ab", "x >= .5": "x>=.5", "Fig. .5": "fig5", "1.25.": "1.25", "a.5": "a5",
    "analysed 12": "analyzed12", "was shown1–3.": "wasshown123", "é𝒳 ﬁve": "éxfive", "so­ft": "soft", "p < 0.05; n=3": "p<0.05n=3", "no .5": "no5", ". .5": "5",
}


def test_compact_text(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", T.compact_science("t").alias("c"), T.compact_science("t", spellings=False).alias("plain")).collect()
    # A dash that isn't among those of a reference keeps its brackets' numbers.
    expected = CASES | {"The value rose [3‐5] to 5": "thevaluerose3-5to5"}
    assert {r.t: r.c for r in rows} == expected
    assert {r.t: r.plain for r in rows} == expected | {"analysed 12": "analysed12", "was shown1–3.": "wasshown1-3"}


def test_compact_page_agrees_with_compact_text(spark):
    for text, compact in ({t: c for t, c in CASES.items() if "‐" not in t}).items():
        plain = T.unicodedata.normalize("NFKC", text).lower().replace("­", "").replace("−", "-").replace("–", "-")
        words = plain.split(" ")
        got, owners = geometry.compact_page(words, [True] * (len(words) - 1) + [False], True)
        assert got == compact.replace("123", "123") and len(owners) == len(got) and owners == sorted(owners)


def test_compatibility_forms(spark):
    texts = ["ﬁne", "Ⅳ ½", "ｆｕｌｌ　width", "é", "in-\n dent", "“q” ‘r’", "﻿ a b ", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normal_prose("t").alias("p")).collect()
    import re

    for r in rows:
        said = re.sub(r"([A-Za-z])-\s*\n\s*([A-Za-z])", r"\1\2", unicodedata.normalize("NFKC", r.t or ""))
        said = said.translate(str.maketrans("‘’“”", "''\"\""))
        assert r.p == re.sub(r"[\s﻿]+", " ", said).strip().lower()


def test_segments_are_the_text():
    import random

    rng = random.Random(3)
    parts = ["Fig. 2", "et al.", " The", " the", "12", ".", "! ", "?", "(x)", "\n", " ", "é", "e.g.", "[1,2]", "”", "日本。", "U.S.", "1.5", " ", "𝒳"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        cut = cut_sentences(text)
        assert "".join(text[a:b] for a, b in cut) == text and all(a < b for a, b in cut)


def test_latest_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, None), (1, 7, "b"), (None, 1, "c"), (None, None, "d")], "k int, at int, v string")
    assert sorted(((r.k, r.at, r.v) for r in records.latest(rows, ["k"], ["at", "v"]).collect()), key=str) == [(1, 7, "b"), (None, 1, "c")]


def test_item_tiers(spark):
    items = spark.createDataFrame([(1, "10.1/abcdefgh", "A long title here", 1), (2, "10.1/abcdefgh", "Other", 2), (3, None, "Holds a long title here too", 9), (4, "", None, 3)], "item_id bigint, doi string, title string, added long")
    items = items.withColumn("added", F.timestamp_seconds("added"))
    asked = [(1, "https://doi.org/10.1/ABCDEFGH", "nothing"), (2, "abcdefgh", None), (3, None, "a long title here"), (4, "10.9/zzz", "not there"), (5, None, None)]
    found = {r.request_id: (r.tier, r.item_id, r.candidates) for r in catalog.resolved(spark.createDataFrame(asked, "request_id bigint, doi string, title string"), items).collect()}
    assert found == {1: (1, 2, 2), 2: (2, 2, 2), 3: (3, 3, 2), 4: (None, None, 0), 5: (None, None, 0)}
