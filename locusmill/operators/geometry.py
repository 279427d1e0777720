"""Quotes among the words of laid-out pages (JN-08 to JN-13, ARR-03, ARR-04, WIN-02 to WIN-05, AGG-02, AGG-06, AGG-08, FLT-07, FLT-22, SET-01, SRT-02 to SRT-04).

``words`` has doc_id, page_index, page_w, page_h, line_index, word_index, text, x0, y0, x1, y1 and
space_after; ``selectors`` selector_id, doc_id, exact, prefix, suffix and heading. A selector is
looked for in the pages of its own document, so the two meet by doc_id, and a page is the largest
thing that one row holds.

Each page is tried tier by tier, and only its first tier with a place counts: equal tokens; equal
text without spaces and marks, in reading order by column and in the given one, spelt as it is and
with the fixed spellings; equal tokens but for the article. Context on either side and the heading
raise a place's score; places are the same when they hold the same words. What is found on no
single page is looked for over two pages, between which pages of figure labels may lie.

Defined cases: null texts count as empty; a quote without tokens is found nowhere; selectors
without pages are kept as not found; repeated selectors are judged each; empty tables give no rows.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from locusmill.functions.text import CITED_RUN, NUMERIC_CITATION, SPELLINGS, compact_science, expand_run, nfkc_lines, rounded, same_dashes, text_of
from locusmill.functions.tokens import SCIENCE, science_tokens
from locusmill.operators.spans import offsets_of
from locusmill.sources.tables import saved

CONTEXT_WORDS = 50
CONTEXT_CHARS = 72
LEAST_CONTEXT = 16
LEAST_CHARS = 24
ARTICLE = "the"
LEAST_CONTENT = 8

# What a figure's heading and its panel letters, scale bars, statistics and closing marks look like (FLT-07, WIN-05).
FIGURE_HEADING = r"(?i)^(?:extended\s+data\s+)?fig(?:ure)?\.?\s*\d+(?![A-Za-z0-9_])"
PANEL, SCALE_BAR, STATISTIC, CLOSED = r"^(?:[a-z]\s*){1,4}\z", r"(?<![A-Za-z0-9_])\d+\s*[µμ]m(?![A-Za-z0-9_])", r"^P\s*[=<]", r"[.!?。！？]\s*\z"
_CITATION = regex.compile(NUMERIC_CITATION)
_BRITISH = regex.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(SPELLINGS)})(?![A-Za-z0-9_])")
#: What compact text keeps: letters, digits, comparators, signs before digits, decimal points not behind a label (FLT-06).
_KEPT = regex.compile(
    r"[\p{L}\p{N}<>=≤≥≠±]|[+-](?=\s*[0-9])|(?<=[0-9])\.(?=[0-9])"
    r"|(?<=\A|\s)(?<!(?:\.|(?<![A-Za-z0-9_])(?:fig|eq|no|vol|pp|sect))\s*)\.(?=[0-9])"
)
_OWNED = StructType([StructField("text", StringType()), StructField("owners", ArrayType(IntegerType()))])


def columns_of(lines: Column, page_w: Column) -> Column:
    """The left edges that part a page's columns: midpoints of gaps over 18 % of its width between margins; else its middle."""
    margins = F.array_sort(F.array_distinct(F.transform(lines, lambda line: line["left"])))
    n = F.size(margins)
    gaps = F.zip_with(F.slice(margins, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(margins, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(b - a > page_w * 0.18, (a + b) / 2))
    found = F.filter(gaps, lambda g: g.isNotNull())
    return F.when(F.size(found).between(1, 3), found).otherwise(F.array(page_w / 2))


def pages_of(words: DataFrame) -> DataFrame:
    """doc_id, page_index, page_w, page_h, order (given, column), the page's words in that order, and its tokens with the place of their word."""
    word = F.struct("word_index", "line_index", text_of("text").alias("text"), "x0", "y0", "x1", "y1", F.coalesce("space_after", F.lit(False)).alias("space_after"))
    usable = words.where("x1 > x0 and y1 > y0").withColumn("_word", word)
    lines = usable.groupBy("doc_id", "page_index", "line_index").agg(
        F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"), F.array_sort(F.collect_list("_word")).alias("words")
    )
    pages = lines.groupBy("doc_id", "page_index").agg(
        F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"), F.collect_list(F.struct("top", "left", "line_index", "words")).alias("lines")
    )
    # Composed by page: a Python function between two groupings would have the words dealt again.
    pages = pages.withColumn("_plain", nfkc_lines(F.transform("lines", lambda line: F.transform(line["words"], lambda w: w["text"]))))
    spelt = lambda w, p: w.withField("plain", same_dashes(F.lower(p)))
    pages = pages.withColumn("lines", F.zip_with("lines", "_plain", lambda line, ps: line.withField("words", F.zip_with(line["words"], ps, spelt)))).drop("_plain")
    pages = pages.withColumn("_edges", columns_of(F.col("lines"), F.col("page_w")))

    def placed(line: Column) -> Column:
        column = F.size(F.filter("_edges", lambda e: line["left"] >= e))
        return F.struct(column.alias("column"), line["top"].alias("top"), line["left"].alias("left"), line["line_index"].alias("line_index"), line["words"].alias("words"))

    given = F.array_sort(F.flatten(F.transform("lines", lambda line: line["words"])))
    by_column = F.flatten(F.transform(F.array_sort(F.transform("lines", placed)), lambda line: line["words"]))
    orders = F.array(F.struct(F.lit("given").alias("order"), given.alias("words")), F.struct(F.lit("column").alias("order"), by_column.alias("words")))
    each = pages.select("doc_id", "page_index", "page_w", "page_h", F.explode(orders).alias("_o")).select("doc_id", "page_index", "page_w", "page_h", "_o.order", "_o.words")
    cut = lambda w: F.regexp_extract_all(F.regexp_replace(w["plain"], r"([+-])\s+(?=\d)", "$1"), F.lit(SCIENCE), F.lit(0))
    tokens = F.flatten(F.transform("words", lambda w, i: F.transform(cut(w), lambda t: F.struct(t.alias("t"), i.alias("w")))))
    return each.withColumn("tokens", tokens)


def _respelt(raw: str, owners: list[int]) -> tuple[str, list[int]]:
    """The fixed spellings and reference ranges in one form; each new character is of the word that it stands in."""
    changes = [(m.start(), m.end(), SPELLINGS[m[0]]) for m in _BRITISH.finditer(raw)]
    for m in CITED_RUN.finditer(raw):
        run = expand_run(m[1]) if regex.search("[–-]", m[1]) else None
        changes += [(m.start(), m.end(), run)] if run is not None else []
    text, owned, at = [], [], 0
    for start, stop, new in sorted(changes):
        text += [raw[at:start], new]
        owned += owners[at:start] + [owners[min(start + i, stop - 1)] for i in range(len(new))]
        at = stop
    return "".join([*text, raw[at:]]), owned + owners[at:]


def compact_page(plain: list[str], spaces: list[bool], spellings: bool) -> tuple[str, list[int]]:
    """A page's compact text, and for each character the place of the word that it is of (ARR-04)."""
    parts = [p + " " * bool(s) for p, s in zip(plain, spaces, strict=True)]
    raw, owners = "".join(parts), [i for i, p in enumerate(parts) for _ in p]
    if spellings:
        raw, owners = _respelt(raw, owners)
    gone = {i for m in _CITATION.finditer(raw) for i in range(*m.span())}
    kept = [m.start() for m in _KEPT.finditer(raw) if m.start() not in gone]
    return "".join(raw[i] for i in kept), [owners[i] for i in kept]


def _compacted(spellings: bool):
    @F.pandas_udf(_OWNED)
    def run(plain: pd.Series, spaces: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compact_page(list(p), list(s), spellings) for p, s in zip(plain, spaces, strict=True)], columns=["text", "owners"])

    return run("_plain", "_spaces")


def indexed(pages: DataFrame) -> DataFrame:
    """Pages with their compact text and owners, spelt as they are (literal) and in one form (alias)."""
    parts = pages.withColumn("_plain", F.transform("words", lambda w: w["plain"])).withColumn("_spaces", F.transform("words", lambda w: w["space_after"]))
    return parts.withColumn("literal", _compacted(False)).withColumn("alias", _compacted(True)).drop("_plain", "_spaces")


_FOUND = ["selector_id", "doc_id", "page_index", "order", "tier", "score", "method", "first", "last", "start_token"]


def _span(tier: int, score: Column, method: str, first: Column, last: Column, token: Column) -> list[Column]:
    return ["selector_id", "doc_id", "page_index", "order", F.lit(tier).alias("tier"), score.cast("double").alias("score"), F.lit(method).alias("method"),
            first.cast("int").alias("first"), last.cast("int").alias("last"), token.cast("int").alias("start_token")]


def _starts(tokens: Column, quote: Column) -> Column:
    """Places where the quote's tokens stand in a row."""
    n, k = F.size(tokens), F.size(quote)
    every = F.when((k > 0) & (n >= k), F.sequence(F.lit(0), n - k)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.filter(every, lambda i: (F.get(tokens, i) == F.get(quote, F.lit(0))) & (F.slice(tokens, i + 1, k) == quote))


def _exact(both: DataFrame) -> DataFrame:
    values = F.transform("tokens", lambda t: t["t"])
    rows = both.where("order = 'given'").withColumn("_v", values).withColumn("_at", F.explode(_starts(F.col("_v"), F.col("quote"))))
    k, at = F.size("quote"), F.col("_at")
    before, after = F.slice("prefix_tokens", F.greatest(F.size("prefix_tokens") - 7, F.lit(1)), F.lit(8)), F.slice("suffix_tokens", 1, 8)
    left = (F.size(before) > 0) & (at >= F.size(before)) & (F.slice("_v", F.greatest(at - F.size(before) + 1, F.lit(1)), F.size(before)) == before)
    right = (F.size(after) > 0) & (F.slice("_v", at + k + 1, F.size(after)) == after)
    place = lambda i: F.get("tokens", i)["w"]
    return rows.select(*_span(1, 1 + 0.5 * left.cast("int") + 0.5 * right.cast("int"), "exact-tokens", place(at), place(at + k - 1), at))


def _compact(both: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    found = None
    for mode in ("literal", "alias"):
        rows = both.where(F.length(f"quote_{mode}") >= least).withColumn("_at", F.explode(offsets_of(F.col(f"{mode}.text"), F.col(f"quote_{mode}"))))
        owner = lambda i, mode=mode: F.get(F.col(f"{mode}.owners"), i.cast("int"))
        first, last = owner(F.col("_at")), owner(F.col("_at") + F.length(f"quote_{mode}") - 1)
        score = F.when(F.col("order") == "column", 0.97).otherwise(0.95)
        part = rows.select(*_span(2, score, "compact-text", first, last, F.get("words", first)["word_index"]))
        found = part if found is None else found.unionByName(part)
    return found


def _tolerant(both: DataFrame) -> DataFrame:
    bare = F.filter(F.transform("tokens", lambda t, i: F.struct(t["t"].alias("t"), t["w"].alias("w"), i.alias("i"))), lambda t: t["t"] != ARTICLE)
    rows = both.withColumn("_q", F.filter("quote", lambda t: t != ARTICLE)).where(F.size("_q") >= LEAST_CONTENT).withColumn("_b", bare)
    rows = rows.withColumn("_at", F.explode(_starts(F.transform("_b", lambda b: b["t"]), F.col("_q"))))
    first, last = F.get("_b", F.col("_at")), F.get("_b", F.col("_at") + F.size("_q") - 1)
    near = F.abs(last["i"] - first["i"] + 1 - F.size("quote")) <= 2
    return rows.where(near).select(*_span(3, F.lit(0.94), "ordered-tokens", first["w"], last["w"], first["i"]))


def _asked(selectors: DataFrame) -> DataFrame:
    """Selectors with their tokens and compact texts, contexts and heading as they are compared."""
    heading = F.regexp_like(F.trim(text_of("heading")), F.lit(FIGURE_HEADING))
    compact = lambda c: compact_science(c)
    return selectors.select(
        "selector_id", "doc_id", science_tokens("exact").alias("quote"), science_tokens("prefix").alias("prefix_tokens"), science_tokens("suffix").alias("suffix_tokens"),
        compact_science("exact", spellings=False).alias("quote_literal"), compact("exact").alias("quote_alias"), F.right(compact("prefix"), F.lit(CONTEXT_CHARS)).alias("before"),
        F.left(compact("suffix"), F.lit(CONTEXT_CHARS)).alias("after"), F.when(heading, F.left(compact("heading"), F.lit(96))).otherwise("").alias("head"),
    ).where(F.size("quote") > 0)


def _with_evidence(found: DataFrame, pages: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores raised by fifty words of context on either side, in either order, and by the heading."""
    own = pages.select("doc_id", "page_index", "order", F.transform("words", lambda w: w["word_index"]).alias("_own"))
    ends = found.join(own, ["doc_id", "page_index", "order"])
    ends = ends.select(*found.columns, F.get("_own", F.col("first")).alias("_a"), F.get("_own", F.col("last")).alias("_z"), F.slice("_own", F.col("first") + 1, F.col("last") - F.col("first") + 1).alias("held"))
    there = pages.select("doc_id", "page_index", F.col("order").alias("_by"), "words", F.col("alias.text").alias("_page"))
    both = ends.join(there, ["doc_id", "page_index"]).join(asked.select("selector_id", "before", "after", "head"), "selector_id")
    at = lambda word: F.array_position(F.transform("words", lambda w: w["word_index"]), F.col(word))
    said = lambda start, n: F.array_join(F.transform(F.slice("words", start, n), lambda w: F.concat(w["text"], F.when(w["space_after"], " ").otherwise(""))), "")
    both = both.withColumn("_left", at("_a").cast("int")).withColumn("_right", at("_z").cast("int")).where("_left > 0 and _right >= _left")
    lead = compact_science(said(F.greatest(F.col("_left") - CONTEXT_WORDS, F.lit(1)), F.least(F.col("_left") - 1, F.lit(CONTEXT_WORDS))))
    trail = compact_science(said(F.col("_right") + 1, F.lit(CONTEXT_WORDS)))
    both = both.withColumn("_lead", lead).withColumn("_trail", trail)
    side = lambda ok: F.when(ok, 0.5).otherwise(0.0)
    evidence = side((F.length("before") >= LEAST_CONTEXT) & F.endswith("_lead", F.col("before"))) + side((F.length("after") >= LEAST_CONTEXT) & F.startswith("_trail", F.col("after")))
    headed = (F.length("head") >= LEAST_CHARS) & F.contains("_page", F.col("head")) & (F.col("_by") == "given")
    best = both.groupBy(*found.columns, "held").agg(F.max(evidence).alias("_e"), F.max(headed).alias("_h"))
    score = F.when(F.col("_e") > 0, 2 + F.col("_e")).otherwise(F.col("score")) + F.when(F.col("_h"), 4.0).otherwise(0.0)
    return best.withColumn("score", score).drop("_e", "_h")


def page_index(words: DataFrame) -> DataFrame:
    """The pages with all that selectors are held against, written once."""
    return saved(indexed(pages_of(words)), "page-index")


def page_candidates(selectors: DataFrame, words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Every place of every selector on a single page: the first tier of each page, with the words held and the score by evidence."""
    pages, asked = page_index(words) if pages is None else pages, _asked(selectors)
    both = asked.join(pages, "doc_id")
    found = _exact(both).unionByName(_compact(both)).unionByName(_tolerant(both))
    first = F.min("tier").over(W.partitionBy("selector_id", "page_index"))
    return _with_evidence(found.withColumn("_first", first).where("tier = _first").drop("_first"), pages, asked)


def distinct_places(found: DataFrame) -> DataFrame:
    """The places that decide: those of 0.97 and more if there are any; of the same words once; above 1 only the best."""
    best = F.max("score").over(W.partitionBy("selector_id"))
    kept = found.withColumn("_best", best).where("_best < 0.97 or score >= 0.97").drop("_best").withColumn("held", F.array_sort("held"))
    order = W.partitionBy("selector_id", "page_index", "held").orderBy(F.desc("score"), F.when(F.col("order") == "column", 0).otherwise(1), "start_token", "method")
    kept = kept.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return kept.withColumn("_best", best).where("_best <= 1 or score = _best").drop("_best")


def rectangles(held: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_index, segment, x0, y0, x1, y1 around the words held (WIN-02, A.3): a line breaks where a gap is over 12 and 2.5 times the word's height."""
    asked = held.select(*keys, "doc_id", "page_index", F.explode("held").alias("word_index"))
    # Words that no page is asked for stay out of the join.
    ends = held.agg(F.min(F.array_min("held")).alias("_least"), F.max(F.array_max("held")).alias("_most"))
    some = words.join(F.broadcast(ends), F.col("word_index").between(F.col("_least"), F.col("_most"))).select("doc_id", "page_index", "word_index", "page_h", "line_index", "x0", "y0", "x1", "y1")
    each = asked.join(some, ["doc_id", "page_index", "word_index"])
    order = W.partitionBy(*keys, "page_index", "line_index").orderBy("x0", "word_index")
    new = F.coalesce(F.col("x0") - F.lag("x1").over(order) > F.greatest(F.lit(12.0), (F.col("y1") - F.col("y0")) * 2.5), F.lit(True))
    marked = each.withColumn("_new", new.cast("int")).withColumn("segment", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    box = marked.groupBy(*keys, "page_index", "line_index", "segment").agg(F.max("page_h").alias("_h"), *(F.min(c).alias(f"_{c}") for c in ("x0", "y0")), *(F.max(c).alias(f"_{c}") for c in ("x1", "y1")))
    return box.select(*keys, "page_index", "line_index", "segment", rounded("_x0").alias("x0"), rounded(F.col("_h") - F.col("_y1")).alias("y0"), rounded("_x1").alias("x1"), rounded(F.col("_h") - F.col("_y0")).alias("y1"))


def label_pages(words: DataFrame) -> DataFrame:
    """doc_id, page_index and whether a page holds nothing but figure labels, or nothing at all away from its edges (FLT-07, AGG-08)."""
    central = (F.col("y0") > F.col("page_h") * 0.12) & (F.col("y1") < F.col("page_h") * 0.88) & (F.col("x0") > F.col("page_w") * 0.06) & (F.col("x1") < F.col("page_w") * 0.94)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", text_of("text").alias("t")))), lambda w: w["t"]), " ")
    lines = words.where(central).groupBy("doc_id", "page_index", "line_index").agg(text.alias("line"))
    spaced = r"(?<![A-Za-z0-9_])((?:[A-Za-z]\s+){2,}[A-Za-z])(?![A-Za-z0-9_])"
    # Letters that stand apart, as in a spaced word, are one word.
    joined = F.regexp_replace("line", r"(?<=(?<![A-Za-z0-9_])[A-Za-z])\s+(?=[A-Za-z](?![A-Za-z0-9_]))", "")
    lines = lines.withColumn("line", F.when(F.regexp_like("line", F.lit(spaced)), joined).otherwise(F.col("line"))).withColumn("n", F.regexp_count("line", F.lit(r"\p{L}+")))
    trimmed = F.trim("line")
    facts = lines.groupBy("doc_id", "page_index").agg(
        F.count(F.lit(1)).alias("lines"), F.max("n").alias("longest"), F.sum("n").alias("total"), F.count_if(F.col("n") <= 3).alias("short"),
        F.max((F.col("n") >= 3) & F.regexp_like("line", F.lit(CLOSED))).alias("sentence"), F.count_if(F.regexp_like(trimmed, F.lit(PANEL))).alias("panels"),
        F.max(F.regexp_like("line", F.lit(SCALE_BAR))).alias("scale"), F.count_if(F.regexp_like(trimmed, F.lit(STATISTIC))).alias("tests"),
    )
    most = F.when((F.col("panels") >= 4) & F.col("scale") & (F.col("tests") >= 4), 400).otherwise(160)
    labels = (F.col("lines") >= 8) & (F.col("longest") <= 6) & (F.col("total") <= most) & (F.col("short") >= 0.8 * F.col("lines")) & ~F.col("sentence")
    known = words.groupBy("doc_id", "page_index").agg(F.max("page_w").alias("_w"), F.max("page_h").alias("_h"))
    measured = (F.col("_w") > 0) & (F.col("_h") > 0)
    return known.join(facts, ["doc_id", "page_index"], "left").select("doc_id", "page_index", (measured & F.coalesce(labels, F.lit(True))).alias("labels_only"))


def over_two_pages(selectors: DataFrame, words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """selector_id, page_index, next_page, head and tail (words held) of quotes that end on a later page (JN-12, FLT-22).

    Up to two pages of figure labels may lie between. Both parts must be on their pages as compact
    text; a part of fewer than eight tokens only where the page ends or begins.
    """
    pages, asked = page_index(words) if pages is None else pages, _asked(selectors)
    n, least = F.size("quote"), F.when(F.size("quote") >= 20, 3).otherwise(8)
    asked = asked.where(n >= 2 * least).withColumn("least", least)
    splits = asked.select("selector_id", "doc_id", "quote", "least", F.explode(F.sequence(F.col("least"), n - F.col("least"))).alias("split"))
    part = lambda start, size: F.array_join(F.slice("quote", start, size), " ")
    splits = splits.withColumn("_head", compact_science(part(F.lit(1), F.col("split")))).withColumn("_tail", compact_science(part(F.col("split") + 1, n)))
    some = F.when(n >= 20, 4).otherwise(LEAST_CHARS)
    sides = {}
    for side in ("head", "tail"):
        rows = splits.withColumn("quote_literal", F.col(f"_{side}")).withColumn("quote_alias", F.col(f"_{side}")).where(F.length(f"_{side}") >= some)
        rows = rows.join(pages, "doc_id").withColumn("selector_id", F.struct("selector_id", "split", n.alias("n")))
        found = _compact(rows, 4).join(pages.select("doc_id", "page_index", "order", "words", "page_h"), ["doc_id", "page_index", "order"])
        held = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + 1)
        edge = F.array_max(F.transform(held, lambda w: w["y1"])) / F.col("page_h") if side == "head" else F.array_min(F.transform(held, lambda w: w["y0"])) / F.col("page_h")
        short = F.col("selector_id.split") if side == "head" else F.col("selector_id.n") - F.col("selector_id.split")
        at_edge = edge >= 0.65 if side == "head" else edge <= 0.2
        sides[side] = found.where((short >= 8) | at_edge).select("selector_id", "doc_id", "page_index", F.array_sort(F.transform(held, lambda w: w["word_index"])).alias(side)).distinct()
    skip = label_pages(words).where("labels_only").select("doc_id", F.col("page_index").alias("_skip"))
    both = sides["head"].join(sides["tail"].withColumnRenamed("page_index", "next_page"), ["selector_id", "doc_id"])
    both = both.where("next_page > page_index and next_page - page_index <= 3")
    between = both.withColumn("_skip", F.explode_outer(F.when(F.col("next_page") - F.col("page_index") > 1, F.sequence(F.col("page_index") + 1, F.col("next_page") - 1))))
    between = between.join(skip.withColumn("_ok", F.lit(True)), ["doc_id", "_skip"], "left")
    kept = between.groupBy("selector_id", "doc_id", "page_index", "next_page", "head", "tail").agg(F.bool_and(F.col("_skip").isNull() | F.coalesce("_ok", F.lit(False))).alias("_all")).where("_all")
    return kept.select(F.col("selector_id.selector_id").alias("selector_id"), "doc_id", "page_index", "next_page", "head", "tail").distinct()


def geometry_verdicts(selectors: DataFrame, words: DataFrame) -> DataFrame:
    """selector_id, status, n_places, page_index, next_page, score and method; a place is named only where it is the only one (JN-13)."""
    pages = page_index(words)
    single = distinct_places(page_candidates(selectors, words, pages))
    places = saved(single.select("selector_id", "page_index", F.lit(None).cast("int").alias("next_page"), "score", "method"), "page-places")
    rest = selectors.join(places.select("selector_id").distinct(), "selector_id", "left_anti")
    two = over_two_pages(rest, words, pages).select("selector_id", "page_index", "next_page", F.lit(0.94).alias("score"), F.lit("two-pages").alias("method"))
    all_ = places.unionByName(two).groupBy("selector_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_index", "next_page", "score", "method")).alias("one"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    one = lambda name: F.when(n == 1, F.col(f"one.{name}")).alias(name)
    return selectors.select("selector_id").join(all_, "selector_id", "left").select(
        "selector_id", F.when(n == 0, "not-found").when(n == 1, "unique").otherwise("ambiguous").alias("status"), n.alias("n_places"), *map(one, ("page_index", "next_page", "score", "method"))
    )
