"""Words of recognised pages from JSON of every shape."""

from locusmill.sources.recognised import page_words


def word(x0, y0, x1, y1, text, space=1):
    return f"[{x0},{y0},{x1},{y1},0,{space},0,0,0,0,0,0,0,{text}]"


def page(*lines, head="600,800.5"):
    return f"[{head},[[[[0,0,0,0,[{','.join(lines)}]]]]]]"


def test_words_and_what_is_none(spark):
    long = page(*("[[" + ",".join(word(i, 0, i + 1, 1, '"ab"', 0) for i in range(2000)) + "]]" for _ in range(3)))
    good = page(f"[[{word(1, 2, 3.5, 4, '"é𝒳"')},{word(5, 2, 9, 4, '"b"', 'false')}]]", "7", "[]", "[null]", f"[[{word(0, 0, 1, 1, '"c"', '""')},{word(0, 0, 1, 1, '"d"', '[]')},{word(0, 0, 1, 1, '"e"', 'null')}]]")
    bad = page(
        f"[[{word(3, 2, 3, 4, '"no width"')},{word('"1"', 0, 2, 2, '"text for a corner"')},{word(0, 0, 1, 1, 5)},{word('null', 0, 1, 1, '"x"')},5,[1,2],null,{word(0, 0, 1, 1, '"ok"')}]]", head='null,"tall"'
    )
    rows = [(0, good), (1, bad), (2, None), (3, "no json"), (4, "[1,2]"), (5, "{}"), (6, "[1,2,[[[[0,0,0,0,9]]]]]"), (7, long)]
    docs = spark.createDataFrame([("d", i, p) for i, p in rows], "doc_id string, page_index int, page string")
    found = page_words(docs).orderBy("page_index", "word_index").collect()
    of = lambda i: [(r.line_index, r.word_index, r.text, r.char_offset, r.space_after) for r in found if r.page_index == i]
    assert of(0) == [(0, 0, "é𝒳", 0, True), (0, 1, "b", 3, False), (4, 2, "c", 4, False), (4, 3, "d", 5, True), (4, 4, "e", 7, False)]
    assert of(1) == [(0, 0, "ok", 0, True)]
    assert {r.page_index for r in found} == {0, 1, 7} and len(of(7)) == 6000 and of(7)[-1][3] == 2 * 5999
    assert [(r.page_w, r.page_h, r.x0, r.x1) for r in found if r.text in ("é𝒳", "ok")] == [(600.0, 800.5, 1.0, 3.5), (0.0, 0.0, 0.0, 1.0)]
