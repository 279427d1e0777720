"""Small fixed tables of scientific text, laid-out pages and translated fragments, with the rows that operators give for them, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions import segment as S
from locusmill.operators import alignment, geometry
from locusmill.sources import html

#: Function and the SQL of its rows.
FIXED = {}


def query(sql):
    def register(function):
        FIXED[function.__name__] = function, sql
        return function

    return register


WORDS = "doc_id string, page_index int, page_w double, page_h double, line_index int, word_index int, text string, x0 double, y0 double, x1 double, y1 double, space_after boolean"
SELECTORS = "selector_id string, doc_id string, exact string, prefix string, suffix string, heading string"

#: Sentences in order; their texts joined by spaces are the case.
SENTENCE_CASES = {
    "figure without space": ["The curve rose as Fig.2 shows, and then fell.", "Blanks stayed flat."],
    "figure in brackets": ["The curve rose (Fig. 2).", "Blanks stayed flat."],
    "figures with letters": ["See Figs. 2a,b for the curve.", "Blanks stayed flat."],
    "roman numeral": ["The trial is given in Sec. IV of the protocol.", "It was blinded."],
    "no is a word": ["No.", "I saw nothing of the kind."],
    "no is a number": ["Plate No. 7 was kept cold.", "Others were not."],
    "for example": ["Some salts, e.g. sodium chloride, dissolve.", "Others do not."],
    "that is": ["The buffer, i.e. the saline, was warm.", "It was stirred."],
    "versus": ["We weighed 10 mg vs. 20 mg of salt.", "Both dissolved."],
    "honorific": ["Dr. Jones weighed the salt.", "It was dry."],
    "supplier": ["Salt came from Acme Inc. (Oslo, Norway) in bags.", "It was dry."],
    "and others go on": ["Jones et al. weighed the salt.", "It was dry."],
    "and others with a year": ["We follow Jones et al. (2019).", "The salt was dry."],
    "and others at the end": ["The salt was weighed by Jones et al.", "We did so again."],
    "capitals": ["The U.S. plant sold it.", "We bought it in the U.S.", "It was dry."],
    "decimals": ["The mean was 1.25 g, with P < 0.05 and a ratio of .5 or so.", "It was dry."],
    "unit at the end": ["It was dried for 24 h.", "IL-9 was then added."],
    "bare reference": ["The yield rose.12", "The blank did not."],
    "reference list": ["The yield rose. 12,13", "The blank did not."],
    "reference in brackets": ["The yield rose.[12,13]", "The blank did not."],
    "reference behind a bracket": ["The yield rose (Fig. 2).12", "The blank did not."],
    "label, no reference": ["Step B.6 The mixture was cooled."],
    "number before a capital": ["The value was 1.25 The unit was left out."],
    "other marks": ["Was it dry?", "Yes!", "We went on."],
    "bracketed sentence": ["The yield rose.", "(Fig. 2).", "Blanks stayed flat."],
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    shown = ", ".join("(" + ", ".join("NULL" if v is None else _quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {shown}) t({names})"


@query(_values([(n, i, s) for n, said in SENTENCE_CASES.items() for i, s in enumerate(said)], "name, ordinal, sentence"))
def sentence_cases(spark: SparkSession) -> DataFrame:
    """ARR-05 to ARR-08 on abbreviations, references and numbers."""
    cases = spark.createDataFrame([(n, " ".join(said)) for n, said in SENTENCE_CASES.items()], "name string, raw string")
    return cases.select("name", F.posexplode(S.sentence_spans("raw")).alias("ordinal", "s")).select("name", "ordinal", F.col("s.text").alias("sentence"))


@query(_values([("The end.", True), ("The end (of it).\"", True), ("The end", False), ("It rose.12", True), ("It rose. [3, 4]", True), ("It was 1.25", False), ("see E14.5.13", True), ("step B.6", False), ("Really? 3", True), ("", False)], "text, ends"))
def sentence_ends(spark: SparkSession) -> DataFrame:
    """FLT-09, FLT-10."""
    texts = ["The end.", "The end (of it).\"", "The end", "It rose.12", "It rose. [3, 4]", "It was 1.25", "see E14.5.13", "step B.6", "Really? 3", ""]
    return spark.createDataFrame([(t,) for t in texts], "text string").select("text", S.ends_sentence("text").alias("ends"))


def laid_out(doc: str, page: int, lines: list[tuple[float, float, str]], width: float = 600, height: float = 800) -> list[tuple]:
    """Words of lines given by left edge, top and text; a character is 5 wide, a line 10 high."""
    rows = []
    for number, (left, top, text) in enumerate(lines):
        for word in text.split(" "):
            rows.append((doc, page, width, height, number, len(rows), word, left, top, left + 5.0 * len(word), top + 10.0, True))
            left += 5.0 * len(word) + 5.0
    return rows


_LABELS = [(100.0, 200.0 + 20 * i, w) for i, w in enumerate(("a", "Day 1", "Day 2", "b", "Control", "Treated", "c", "0 to 5", "d"))]
PAGES = (
    laid_out("one", 0, [(50, 100, "The mean uptake of labelled glucose was 1.25 times that of the"), (50, 120, "resting muscle, and it did not change after the second dose."), (50, 140, "Repeated words stand here twice over. Repeated words stand here twice over.")])
    + laid_out("one", 1, [(50, 650, "At the end of this page the sentence about salted water begins"), (50, 670, "and it goes on to say that")])
    + laid_out("one", 2, _LABELS)
    + laid_out("one", 3, [(50, 50, "crystals form below four degrees when left alone for two days"), (50, 120, "Later text follows.")])
    + laid_out("two", 0, [(50, 100, "left column starts with a signal"), (320, 100, "that crosses into the other one"), (50, 120, "of signalling strength at −5 mV [3–5]"), (320, 120, "and ends there for good.")])
    + laid_out("two", 1, [(50, 100, "Fig. 2 Response of the tissue to heat over time"), (50, 120, "Bars show the mean of three runs and their spread as usual.")])
    + laid_out("two", 2, [(50, 100, "Fig. 3 Response of the tissue to cold over time"), (50, 120, "Bars show the mean of three runs and their spread as usual.")])
)

_UPTAKE = "The mean uptake of labelled glucose was 1.25 times that of the resting muscle, and it did not change after the second dose."
_BARS = "Bars show the mean of three runs and their spread as usual."
#: selector, document, quote, prefix, suffix, heading; then status, places, page, next page, score, method.
CASES = [
    ("exact", "one", _UPTAKE, None, None, None, "unique", 1, 0, None, 1.0, "exact-tokens"),
    ("digit changed", "one", _UPTAKE.replace("1.25", "1.26"), None, None, None, "not-found", 0, None, None, None, None),
    ("decimal point removed", "one", _UPTAKE.replace("1.25", "125"), None, None, None, "not-found", 0, None, None, None, None),
    ("negation removed", "one", _UPTAKE.replace("did not change", "did change"), None, None, None, "not-found", 0, None, None, None, None),
    ("middle replaced", "one", _UPTAKE.replace("resting muscle", "working heart"), None, None, None, "not-found", 0, None, None, None, None),
    ("articles removed", "one", _UPTAKE.replace("that of the", "that of"), None, None, None, "unique", 1, 0, None, 0.94, "ordered-tokens"),
    ("words run together", "one", _UPTAKE.replace("labelled glucose", "labelledglucose"), None, None, None, "unique", 1, 0, None, 0.97, "compact-text"),
    ("twice", "one", "Repeated words stand here twice over.", None, None, None, "ambiguous", 2, None, None, None, None),
    ("twice, with context", "one", "Repeated words stand here twice over.", "did not change after the second dose.", None, None, "unique", 1, 0, None, 2.5, "exact-tokens"),
    ("two pages", "one", "the sentence about salted water begins and it goes on to say that crystals form below four degrees when left alone for two days", None, None, None, "unique", 1, 1, 3, 0.94, "two-pages"),
    ("by column", "two", "a signal of signaling strength at −5 mV that crosses into the other one and ends there", None, None, None, "unique", 1, 0, None, 0.97, "compact-text"),
    ("sign removed", "two", "a signal of signaling strength at 5 mV that crosses into the other one and ends there", None, None, None, "not-found", 0, None, None, None, None),
    ("legend", "two", _BARS, None, None, None, "ambiguous", 2, None, None, None, None),
    ("legend, with heading", "two", _BARS, None, None, "Fig. 3 Response of the tissue to cold over time", "unique", 1, 2, None, 5.0, "exact-tokens"),
    ("elsewhere", "none", "No page of this document is there.", None, None, None, "not-found", 0, None, None, None, None),
    ("no tokens", "one", " … ", None, None, None, "not-found", 0, None, None, None, None),
]


def page_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) if i in (2, 3, 7, 8, 9, 10) else v for i, v in enumerate(row)) for row in PAGES], WORDS)


def _selectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([c[:6] for c in CASES], SELECTORS)


_EXPECTED = _values([(c[0], c[6], c[7], c[8], c[9], c[10], c[11]) for c in CASES], "selector_id, status, n_places, page_index, next_page, score, method")


@query(f"SELECT selector_id, status, CAST(n_places AS BIGINT) AS n_places, CAST(page_index AS INTEGER) AS page_index, CAST(next_page AS INTEGER) AS next_page, CAST(score AS DOUBLE) AS score, method FROM ({_EXPECTED})")
def geometry_locate(spark: SparkSession) -> DataFrame:
    """JN-08 to JN-13: verdicts over laid-out pages, with changes that must not match."""
    return geometry.geometry_verdicts(_selectors(spark), page_words(spark))


@query(_values([("one", 0, False), ("one", 1, False), ("one", 2, True), ("one", 3, False), ("two", 0, False), ("two", 1, False), ("two", 2, False)], "doc_id, page_index, labels_only"))
def figure_page_flag(spark: SparkSession) -> DataFrame:
    """FLT-07."""
    return geometry.label_pages(page_words(spark))


@query(_values([("two", 0, "left starts a of strength −5 [3–5] crosses the one ends for")], "doc_id, page_index, every_second_word"))
def column_order(spark: SparkSession) -> DataFrame:
    """WIN-03: the reading order of a page of two columns, every second word of it."""
    pages = geometry.pages_of(page_words(spark)).where("order = 'column' and doc_id = 'two' and page_index = 0")
    second = F.filter(F.transform("words", lambda w, i: F.when(i % 2 == 0, w["text"])), lambda t: t.isNotNull())
    return pages.select("doc_id", "page_index", F.array_join(second, " ").alias("every_second_word"))


@query(_values([(0, 0, 1, 50.0, 690.0, 360.0, 700.0), (0, 1, 1, 50.0, 670.0, 350.0, 680.0)], "page_index, line_index, segment, x0, y0, x1, y1").replace("SELECT *", "SELECT CAST(page_index AS INTEGER) AS page_index, CAST(line_index AS INTEGER) AS line_index, CAST(segment AS BIGINT) AS segment, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1"))
def quote_rectangles(spark: SparkSession) -> DataFrame:
    """WIN-02, AGG-06: the rectangles around a quote's words."""
    words = page_words(spark)
    held = geometry.distinct_places(geometry.page_candidates(_selectors(spark).where("selector_id = 'exact'"), words))
    return geometry.rectangles(held, words, ["selector_id"]).drop("selector_id")


_URL = "https://x.org/a"
_SOURCES = [(p, _URL, f"{p}{i}", i, 20 * (i - 1), 20 * i - 1, f"Sentence {i} of {p}.") for p, n in (("p", 3), ("q", 2), ("r", 3), ("s", 2), ("t", 2)) for i in range(1, n + 1)]
_FRAGMENTS = [
    # In order, one sentence in two pieces, with a reference between.
    ("p", 0, "p1", "第一句话在这里", False), ("p", 1, None, "[1]", True), ("p", 2, "p1", "结束了。", False), ("p", 3, "p2", "第二句话说完了。", False), ("p", 4, "p3", "第三句话也说完了。", False),
    # Pieces of the first sentence inside the second: votes decide.
    ("q", 0, "q1", "这是很长很长的第一句话的开头，", False), ("q", 1, "q2", "外", False), ("q", 2, "q1", "到此为止。", False), ("q", 3, "q2", "这里是同样很长很长的第二句话。", False),
    # Source order is broken, and votes can't mend it.
    ("r", 0, "r2", "先说第二句很长的话在前面。", False), ("r", 1, "r1", "再说第一句很长的话在后面。", False), ("r", 2, "r3", "最后一句。", False),
    # A piece without a key; a key of another paragraph; a key that nothing has.
    ("s", 0, "s1", "有标记的句子。", False), ("s", 1, None, "没有标记的句子。", False), ("s", 2, "s2", "又有标记的句子。", False),
    ("t", 0, "t1", "自己的句子。", False), ("t", 1, "s1", "别人的句子。", False), ("u", 0, "zz", "无主的句子。", False), ("v", 0, None, "什么都没有。", False),
]


def _aligned(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [(p, _URL + "#part", i, k, t, r) for p, i, k, t, r in _FRAGMENTS]
    fragments = spark.createDataFrame(rows, "paragraph_id string, url string, frag_idx int, sentence_key string, text string, is_reference boolean")
    return fragments, spark.createDataFrame(_SOURCES, "paragraph_id string, url string, sentence_key string, ordinal int, start int, stop int, text string")


@query(_values([("p", "grouped", True, 3), ("q", "noncontiguous-key", True, 4), ("r", "source-order", True, 3), ("s", "unmarked-content", True, 3), ("t", "foreign-owner", False, 2), ("u", "unknown-key", True, 1), ("v", "unmarked-content", True, 1)], "paragraph_id, reason, complete, groups").replace("SELECT *", 'SELECT paragraph_id, reason, complete, CAST("groups" AS BIGINT) AS "groups"').replace("complete, groups)", 'complete, "groups")'))
def alignment_groups(spark: SparkSession) -> DataFrame:
    """JN-19, WIN-10, AGG-15: whether a paragraph's fragments fall into one group for each sentence, and why not."""
    return alignment.paragraph_verdicts(*_aligned(spark))


_SELECTIONS = [("whole", "p", 0, 31), ("first", "p", 0, 14), ("two", "p", 14, 31), ("first and second", "p", 0, 22), ("half", "p", 0, 5), ("mark", "p", 7, 10), ("repaired", "q", 0, 21), ("broken", "r", 0, 10), ("unmarked", "s", 0, 15), ("marked", "s", 0, 7), ("foreign", "t", 0, 6), ("none", "v", 0, 3), ("nowhere", "zz", 0, 3)]
_REASONS = [
    ("whole", "captured", "Sentence 1 of p. Sentence 2 of p. Sentence 3 of p.", "complete-validated-paragraph"), ("first", "captured", "Sentence 1 of p.", "complete-captured-sentence-sequence"),
    ("two", "captured", "Sentence 2 of p. Sentence 3 of p.", "complete-captured-sentence-sequence"), ("first and second", "captured", "Sentence 1 of p. Sentence 2 of p.", "complete-captured-sentence-sequence"),
    ("half", "partial-sentence-boundary", None, None), ("mark", "no-selected-sentence", None, None), ("repaired", "captured", "Sentence 1 of q.", "sentence-text-marker-consensus"),
    ("broken", "invalid-sentence-fragment-groups", None, None), ("unmarked", "uncovered-selection-text", None, None), ("marked", "captured", "Sentence 1 of s.", "complete-captured-sentence-sequence"),
    ("foreign", "invalid-sentence-fragment-groups", None, None), ("none", "no-sentence-anchors", None, None), ("nowhere", "no-sentence-anchors", None, None),
]


@query(_values(_REASONS, "selection_id, reason, source, evidence"))
def alignment_reasons(spark: SparkSession) -> DataFrame:
    """ALN-03, JN-20, JN-21, WIN-12: the source text of selections in a translation, or the reason why there is none."""
    selections = spark.createDataFrame(_SELECTIONS, "selection_id string, paragraph_id string, start int, stop int")
    return alignment.captured(selections, *_aligned(spark))


_PAGE = """<html><head><title>x</title></head><body><header><p>menu</p></header><h2>First &amp; part</h2><div><p id="a">One <i>small</i>
text<a href="#ref-3">[3]</a>.</p><div id="b">flat <b>box</b></div></div><ul><li>item<br>two</li></ul><script>var p = "<p>no</p>"</script>
<h3>Second</h3><p>unclosed<p id="c">last <a href="/x">link</a> <sup><a role="doc-noteref" href="#n">4</a></sup><button>press</button></p><footer><div>end</div></footer></body>"""
_BLOCKS = [
    (0, "h2", None, "First & part", None), (1, "p", "a", "One small text.", "First & part"), (2, "div", "b", "flat box", "First & part"), (3, "li", None, "item two", "First & part"),
    (4, "h3", None, "Second", None), (5, "p", None, "unclosed", "Second"), (6, "p", "c", "last link", "Second"),
]


@query(_values(_BLOCKS, "place, tag, id, text, heading"))
def html_blocks(spark: SparkSession) -> DataFrame:
    """SRC-06, SRC-10, FLT-02, FLT-08, FLT-21 on a page that has every case."""
    return spark.createDataFrame([(_PAGE,), (None,), ("",)], "html string").select(F.inline(html.text_blocks("html")))
