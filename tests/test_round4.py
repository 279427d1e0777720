"""Cases of the fourth round's findings, each of which failed before its mending."""

import pytest
from compare import assert_same

from locusmill.operators import locate
from locusmill.plans import ORACLES, QUERIES
from locusmill.sources import recognised


def test_long_quotes_of_one_word_meet_few_pages(spark):
    """keys of a long word are runs of its characters, not single ones, wherever the quote lies; pages' keys, many in small files, aren't broadcast."""
    quote = "abcdefghijklmnopqrst𝒳é"
    texts = [quote[::-1] * 3, *("z" * i + quote + "y" * 9 for i in range(7)), quote[:12], quote[1:13] + quote, "𝒳" * 3 + quote[:11], None, ""]
    pages = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = spark.createDataFrame([(0, quote), (1, quote[:12]), (2, quote[:11]), (3, quote[:8]), (4, quote[3:10]), (5, "zzzzzzzzzzzzz"), (6, quote[:9])], "selector_id bigint, text string")
    holding = lambda q: {i for i, t in enumerate(texts) if q in (t or "")}
    found = locate.candidates(asked, pages)
    pairs = {(r.selector_id, r.doc_id) for r in found.collect()}
    places = {(r.selector_id, r.doc_id, r.at) for r in locate.places(asked, pages).collect()}
    for row in asked.collect():
        met = {d for s, d in pairs if s == row.selector_id}
        assert holding(row.text) <= met and (len(row.text) < 8 or 0 not in met)
        assert places >= {(row.selector_id, i, texts[i].index(row.text)) for i in holding(row.text)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" not in plan and "BuildLeft" in plan
    assert {(r.selector_id, r.doc_id) for r in locate.candidates(asked, pages, most_broadcast=0).collect()} == pairs


@pytest.mark.parametrize("name", ["sentence_cases", "keyed_sentences", "sentence_descriptors"])
def test_a_line_may_begin_with_abbreviations(spark, tmp_path, name):
    """among the words that sentences are made of, cf, vs and viz are words as others are."""
    words = ("cf", "vs", "viz", "no", "fig", "sec", "et", "al", "figs", "il", "xi", "co", "dr")
    rows = [(i, "\n".join([f"{w} {w} {w}"] * 25 + [f"ab {w} de", f"{w} vision cfs"])) for i, w in enumerate(words)] + [(100, None), (101, ""), (102, "aa CF VS\nviz cf vs")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(QUERIES[name](spark, str(tmp_path)), str(tmp_path), ORACLES[name])


def test_places_of_a_page_count_whatever_order_they_are_whole_in(spark, tmp_path):
    """of two columns, one place lies whole in the order given and another only in that of the columns; so may places of two pages, or one over their end."""
    said = lambda n, c: [c + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(n)]
    quote = [f"word{c}" for c in "abcdefghijklmno"]
    both = said(35, "x") + quote + said(40, "y") + quote + said(103, "z")
    texts = [both, said(90, "x") + quote + said(103, "y"), said(35, "x") + quote + said(158, "y"), said(30, "p") + quote + said(190, "x") + quote + said(20, "y"), said(240, "x") + both, both + said(32, "q") + both]
    rows = [(2 * i + odd, " ".join(t)) for i, t in enumerate(texts) for odd in (0, 1)]
    items = [(1, " ".join(quote)), (2, " ".join(said(35, "x")[5:20])), (3, " ".join(both[28:43]))]
    for name, rows, schema in (("documents", rows, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert_same(QUERIES["geometry_locate"](spark, str(tmp_path)), str(tmp_path), ORACLES["geometry_locate"])


def test_a_recognised_page_is_read_once(spark, sf_dir):
    """slots of words aren't looked up one by one in a variant, nor pages read again for a filter."""
    planned = QUERIES["recognised_words"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "variant_get" not in planned and planned.count("ArrowEvalPython") == 1


def test_recognised_pages_of_odd_numbers_and_texts(spark):
    """whole numbers of any size, halves of surrogate pairs, sizes as texts, what only looks like JSON."""
    word = lambda x1, text, space="1": f"[0,0,{x1},1,0,{space},0,0,0,0,0,0,0,{text}]"
    page = lambda *words, head="1,2": f"[{head},[[[[0,0,0,0,[[[{','.join(words)}]]]]]]]]"
    pages = [
        page(word(1, '"a"'), word("9" * 400, '"b"'), head='"12.5",true'), page(word(1, r'"\ud83d\ude00"'), word(1, r'"\ud83dx"', "{}"), word(1, '"c"', "0.0")), page(word("NaN", '"d"')), page(word("true", '"e"'), word(1, '"f"', "[]")),
        page(word("9" * 5000, '"g"'), head='" 7 ","1_0"'), "[" * 100_000, "[1,2,[[[[0,0,0,0,{}]]]]]", page("{}", '"h"', word(1, "null"), "[0,0,1,1]"),
    ]
    docs = spark.createDataFrame([("d", i, p) for i, p in enumerate(pages)], "doc_id string, page_index int, page string")
    found = {r.page_index: r for r in recognised.page_arrays(docs).collect()}
    said = lambda i: [(w.text, w.space_after, w.char_offset) for w in found[i].words]
    assert said(0) == [("a", True, 0), ("b", True, 2)] and found[0].words[1].x1 == float("inf") and (found[0].page_w, found[0].page_h) == (12.5, 1.0)
    assert said(1) == [("\U0001f600", True, 0), ("?x", True, 2), ("c", False, 5)] and said(3) == [("f", True, 0)] and said(4) == [("g", True, 0)]
    assert (found[4].page_w, found[4].page_h) == (7.0, 0.0) and all(said(i) == [] for i in (2, 5, 6, 7))
