"""Places in texts by brute force: repeated and null keys, short quotes, both join routes, contexts, and very long texts."""

import re
import time

import pytest
from pyspark.sql import functions as F

from locusmill.functions import tokens as K
from locusmill.operators import locate, spans


def starts(text, phrase, overlapping):
    found, at = [], 0
    while phrase and (at := (text or "").find(phrase, at)) >= 0:
        found.append(at)
        at += 1 if overlapping else len(phrase)
    return found


@pytest.mark.parametrize("overlapping", [False, True])
def test_occurrences_of_rows_with_one_key(spark, overlapping):
    texts = [(1, "a the b"), (1, "cc the dd the e"), (None, " the  the "), (None, " the the the x"), (2, None), (3, ""), (4, "aaaa\\Eaa"), (5, "x𝒳 the 𝒳 the ")]
    rows = spark.createDataFrame(texts, "k bigint, t string").repartition(3)
    for phrase in (" the ", "aa", "\\E", "a", " "):
        found = sorted(((r.k, r.offset) for r in spans.occurrences(rows, "k", "t", phrase, overlapping).collect()), key=str)
        assert found == sorted(((k, at) for k, t in texts for at in starts(t, phrase, overlapping)), key=str)


def test_bounds_of_rows_with_one_key(spark):
    rows = spark.createDataFrame([(1, "ab\nc"), (1, "x\n\nyz"), (None, "q")], "k bigint, t string")
    found = sorted(((r.k, r.page, r.start, r.end) for r in spans.split_bounds(rows, "k", F.split("t", "\n", -1), "page").collect()), key=str)
    assert found == sorted([(1, 0, 0, 2), (1, 1, 3, 4), (1, 0, 0, 1), (1, 1, 2, 2), (1, 2, 3, 5), (None, 0, 0, 1)], key=str)


PAGES = [(0, "the cat sat on the mat and the cat sat by the door"), (1, "a cat"), (2, "concatenate the cats"), (3, None), (4, ""), (5, "the cat sat on the mat"), (5, "cat sat"), (6, "é𝒳 cat, sat.")]
QUOTES = ["the cat sat", "cat", "c", "at", "cat sat", "e cat s", "the cat sat on the mat", "n the c", "", None, "𝒳 cat, sat.", "t s", "zebra", "sat on the mat and the cat sat by", " "]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_located_equals_contains(spark, most):
    pages = spark.createDataFrame(PAGES, "doc_id int, text string")
    selectors = spark.createDataFrame(list(enumerate(QUOTES)), "selector_id int, text string")
    found = sorted((r.selector_id, r.doc_id, r.first_at, r.n_found) for r in locate.located(selectors, pages, most).collect())
    assert found == sorted((i, d, t.index(q), t.count(q)) for i, q in enumerate(QUOTES) if q for d, t in PAGES if t and q in t)
    assert locate.located(selectors.limit(0), pages).count() == 0 == locate.located(selectors, pages.limit(0)).count()


def test_ranked_by_context_with_fragments(spark):
    long = " ".join(f"w{i}" for i in range(20))
    other = long.replace("w9 w10", "v9, v10")
    texts = [(0, "x a b c y. z a b c q a b c"), (1, f"start {other} end {other.replace('w19', 'u')} and {long.split(' w7')[0]}"), (2, f"it has {long} whole"), (3, f"one. {other}")]
    asked = [(0, "a b c", "z", "q"), (1, "a b c", None, None), (2, long, "", ""), (3, "a b c", "x", "nothing")]
    pages = spark.createDataFrame(texts, "doc_id int, text string")
    selectors = spark.createDataFrame(asked, "selector_id int, text string, prefix string, suffix string")

    expected = set()
    for s, quote, before, after in asked:
        for d, text in texts:
            exact = starts(text, quote, False)
            for at in exact:
                left = bool(before) and text[max(0, at - 2 * len(before) - 8) : at].strip().endswith(before)
                right = bool(after) and text[at + len(quote) :][: 2 * len(after) + 8].strip().startswith(after)
                expected.add((s, d, at, len(quote), 1 + 0.5 * left + 0.5 * right, "exact"))
            words, wanted = list(re.finditer(r"[^\W_]+", text)), re.findall(r"[^\W_]+", quote)
            if exact or len(wanted) < 12:
                continue
            k, values = min(7, len(wanted) // 3), [m[0] for m in words]
            heads = [i for i in range(len(values)) if values[i : i + k] == wanted[:k]]
            tails = [i for i in range(len(values)) if values[i : i + k] == wanted[-k:]]
            for head in heads:
                ends = [t for t in tails if t >= head + k and t - head <= len(wanted) + 16]
                if ends:
                    expected.add((s, d, words[head].start(), words[ends[0] + k - 1].end() - words[head].start(), 0.75, "fragment"))
    ranked = locate.ranked(selectors, pages)
    assert {(r.selector_id, r.doc_id, r["at"], r.length, r.score, r.method) for r in ranked.collect()} == expected
    assert {e[5] for e in expected} == {"exact", "fragment"}
    status = {r.selector_id: (r.status, r.n_places, r.score) for r in locate.settled(selectors, locate.best_only(ranked)).collect()}
    assert status == {0: ("unique", 1, 2.0), 1: ("ambiguous", 3, None), 2: ("unique", 1, 1.0), 3: ("unique", 1, 1.5)}
    places = [(r.doc_id, r["at"]) for r in locate.in_order(ranked).where("selector_id = 0").orderBy("place").collect()]
    assert places[0] == (0, 13) and places[1:] == sorted(places[1:])


def test_very_long_texts_take_linear_time(spark):
    """200,000 words, and 200,000 characters without any mark."""
    words = " ".join(f"w{i % 977}" for i in range(200_000))
    quote = " ".join(f"w{i}" for i in range(300, 310))
    began = time.monotonic()
    pages = spark.createDataFrame([(0, words)], "doc_id int, text string")
    selectors = spark.createDataFrame([(0, quote)], "selector_id int, text string")
    assert locate.located(selectors, pages).first().n_found == words.count(quote)
    said = spark.createDataFrame([("x" * 200_000 + " and. then. " + "y" * 200_000,)], "t string").select(K.plain_sentences(F.col("t")).alias("s")).first().s
    assert [len(s) for s in said] == [200_005]
    assert time.monotonic() - began < 90


def test_sentences_by_marks_alone(spark):
    texts = ["", "...abc defgh. x", "One sentence here!? Another... Short. no end", ".", "a.b.c.d.e.f.g", "!first one is here.", None, "tail without a mark"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.plain_sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        expected = None if r.t is None else [s.strip(" ") for s in re.findall(r"[^.!?]+[.!?]+", r.t) if len(s.strip(" ")) >= 8]
        assert r.s == expected
