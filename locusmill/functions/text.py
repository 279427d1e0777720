"""Column functions that normalise text, addresses and labels (FN-01 to FN-31, FLT-01, FLT-03, FLT-04).

All are Catalyst expressions but ``nfkc``, ``nfkc_lines`` and ``expanded_citations``. Offsets are code points.
White space takes in U+00A0 and U+FEFF, which plain ``\\s`` misses.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACE = r"(?U)[\s\x{FEFF}]+"
# Fixed values from here to the note headings: patterns and words that decide results (SRC-08, FN-04, FN-05, FN-13, FN-14, FN-16, FN-20).
INLINE_TAGS = r"(?i)<\s*/?\s*(?:sup|sub|em|strong|i|b)\s*>"
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
NUMERIC_CITATION = r"\[\s*\d+(?:\s*[,–−-]\s*\d+)*\s*\]"
FIGURE = r"(?i)(?:fig(?:ure)?s?\.?|图)\s*([sS]?\d+[a-z]?(?:\s*[-–—]\s*(?:[sS]?\d+)?[a-z])?)"
DEFAULT_COLOUR = "#ffd400"
#: A run of reference numbers behind a word.
CITED_RUN = re.compile(r"(?<=[a-z)])\s*(\d{1,3}(?:\s*[,–-]\s*\d{1,3})+)(?!\d|\.\d)(?=[,.;:]|\s*[a-z])")
SECRET_NAME = r"(?i)token|password|credential|authorization|cookie|api.?key|pairing"

#: British spellings and the American ones that count as equal.
SPELLINGS = {
    "generalised": "generalized", "normalised": "normalized", "unnormalised": "unnormalized",
    "characterised": "characterized", "specialised": "specialized", "analysed": "analyzed",
    "signalling": "signaling", "remodelling": "remodeling", "ischaemic": "ischemic", "ischaemia": "ischemia",
    "oedema": "edema", "hyperglycaemia": "hyperglycemia", "hyperlipidaemia": "hyperlipidemia",
    "hypercholesterolaemia": "hypercholesterolemia", "ageing": "aging",
}
#: Prose marks that coverage ignores; quotes are kept beside a number.
PLAIN_MARKS = "。！？!?,，、;；:：“”「」『』（）()\\[\\]{}【】"
QUOTE_MARKS = "‘’\"'"


def text_of(column: str | Column) -> Column:
    """The column, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def stripped(column: str | Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(text_of(column), r"(?U)\A[\s\x{FEFF}]+|[\s\x{FEFF}]+\z", "")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no expression for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def nfkc_lines(pages: pd.Series) -> pd.Series:
    """``nfkc`` of every word of every line of a page."""
    return pages.map(lambda lines: [[unicodedata.normalize("NFKC", w) for w in line] for line in lines])


def normal_prose(column: str | Column, composed: bool = False) -> Column:
    """Prose for comparison: hyphens at line ends joined, straight quotes, single spaces, lower case.

    ``composed`` says that the text is in NFKC already, which keeps the expression on the JVM.
    """
    text = text_of(column)
    text = text if composed else nfkc(text)
    text = F.regexp_replace(text, r"([A-Za-z])-\s*\n\s*([A-Za-z])", "$1$2")
    text = F.translate(text, "‘’“”", "''\"\"")
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def readable(column: str | Column) -> Column:
    """Without inline tags and entities for spaces; white space collapsed."""
    text = F.regexp_replace(text_of(column), INLINE_TAGS, " ")
    text = F.regexp_replace(text, r"(?i)&nbsp;", " ")
    return F.trim(F.regexp_replace(text, SPACE, " "))


def compact_cjk(column: str | Column) -> Column:
    """Lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(readable(column)), r"(?U)[\s\x{FEFF}\p{P}\p{S}]+", "")


def letters_and_digits(column: str | Column, composed: bool = False) -> Column:
    text = text_of(column)
    return F.regexp_replace(F.lower(text if composed else nfkc(text)), r"[^\p{L}\p{N}]", "")


def coverage_key(column: str | Column) -> Column:
    """What a selection must cover. Prose marks go, but full stops and marks between digits stay."""
    text = F.regexp_replace(F.lower(readable(column)), SPACE, "")
    plain, quotes = f"[{PLAIN_MARKS}]", f"[{QUOTE_MARKS}]"
    return F.regexp_replace(text, rf"(?<!\p{{N}}){plain}|{plain}(?!\p{{N}})|(?<!\p{{N}}){quotes}(?!\p{{N}})", "")


def translation_key(column: str | Column, composed: bool = False) -> Column:
    text = readable(column)
    text = F.regexp_replace(F.lower(text if composed else nfkc(text)), SPACE, "")
    return F.regexp_replace(text, r"[。.!?！？]+\z", "")


def latin_letters(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit("[A-Za-z]"))


def cjk_letters(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(r"[\x{3400}-\x{9fff}]"))


def mostly_english(column: str | Column) -> Column:
    """At least 20 Latin letters, and CJK letters for at most 3 % of them (or two)."""
    latin, cjk = latin_letters(readable(column)), cjk_letters(readable(column))
    return (latin >= 20) & (cjk <= F.greatest(F.lit(2.0), latin * 0.03))


def quotable(exact: str | Column, language: str | Column, issue: str | Column) -> Column:
    """Whether a selection may be looked up: no issue, English, two letters in a row, no CJK."""
    issue = F.col(issue) if isinstance(issue, str) else issue
    return issue.isNull() & (text_of(language) == "en") & F.regexp_like(text_of(exact), F.lit("[A-Za-z]{2}")) & (cjk_letters(exact) == 0)


def same_dashes(column: str | Column) -> Column:
    return F.translate(F.regexp_replace(text_of(column), "­", ""), "‐‑−–", "----")


def american(column: str | Column) -> Column:
    """Fixed British spellings, as whole lower-case words, in their American form. The text is made once, and searched by a pattern only for words it holds."""
    forms = F.array(*(F.struct(F.lit(british).alias("of"), F.lit(form).alias("to")) for british, form in SPELLINGS.items()))
    whole = lambda w: F.concat(w, F.lit("(?![A-Za-z0-9_])(?<![A-Za-z0-9_]"), w, F.lit(")"))
    return F.aggregate(forms, text_of(column), lambda t, w: F.when(F.contains(t, w["of"]), F.regexp_replace(t, whole(w["of"]), w["to"])).otherwise(t))


def expand_run(run: str) -> str | None:
    """``3,54–56`` as ``3,54,55,56``; None where a range has spaces inside, runs backwards or over 20."""
    numbers: list[str] = []
    for part in map(str.strip, run.split(",")):
        ends = [int(n) for n in re.split("[–-]", part)] if re.fullmatch(r"[0-9]+(?:[–-][0-9]+)?", part) else [1, 0]
        if not 0 <= ends[-1] - ends[0] <= 20:
            return None
        numbers += [part] if len(ends) == 1 else map(str, range(ends[0], ends[-1] + 1))
    return ",".join(numbers)


@F.pandas_udf(StringType())
def expanded_citations(texts: pd.Series) -> pd.Series:
    """Bare reference ranges behind a word, written out; comma lists stay as they are."""

    def one(found: re.Match) -> str:
        run = expand_run(found[1]) if re.search("[–-]", found[1]) else None
        return found[0] if run is None else run

    return texts.map(lambda t: None if t is None else CITED_RUN.sub(one, t))


def compact_science(column: str | Column, composed: bool = False, spellings: bool = True) -> Column:
    """Letters, digits, comparators, signs before digits and decimal points; citations in brackets go.

    With ``spellings`` the fixed British words and bare reference ranges are brought to one form first.
    """
    text = F.regexp_replace(F.regexp_replace(normal_prose(column, composed), "­", ""), NUMERIC_CITATION, "")
    text = same_dashes(text)
    text = expanded_citations(american(text)) if spellings else text
    text = F.regexp_replace(text, r"[^\p{L}\p{N}<>=≤≥≠±+\-.\s]", "\x01")
    text = F.regexp_replace(text, r"[+-](?!\s*\d)", "\x01")
    # A point stays between digits, or before one at a word's start unless a label stands before it.
    point = r"\.(?!\d)|(?<![\d\s])(?<!\A)\.(?=\d)|(?<=\.\s{0,3}|(?<![a-z0-9_])(?:fig|eq|no|vol|pp|sect)\s{1,3})\.(?=\d)"
    return F.regexp_replace(F.regexp_replace(text, point, "\x01"), r"[\x01\s]+", "")


def clean_doi(column: str | Column) -> Column:
    return F.lower(F.regexp_replace(stripped(column), r"(?i)^https?://(?:dx\.)?doi\.org/", ""))


def found_doi(column: str | Column) -> Column:
    """The first DOI in a text, without closing dots and brackets; empty if none."""
    return F.lower(F.regexp_replace(F.regexp_extract(text_of(column), DOI, 0), r"[.)]+\z", ""))


def page_doi(html: str | Column, url: str | Column) -> Column:
    """DOI from a page's meta tags in order of trust, else its canonical link, else its address."""
    text = text_of(html)
    metas = [rf"(?is)<meta[^>]*{a}=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)" for a, n in
             (("name", "citation_doi"), ("name", r"dc\.identifier"), ("property", "og:doi"))]
    found = [found_doi(F.regexp_extract(text, m, 1)) for m in metas]
    link = F.regexp_extract(text, r"(?is)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)", 1)
    place = F.when(link != "", link).otherwise(text_of(url))
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found), found_doi(place))


def page_address(column: str | Column) -> Column:
    """An address without its fragment."""
    return F.substring_index(text_of(column), "#", 1)


def public_address(column: str | Column) -> Column:
    """An http(s) address without user names, secret-looking parameters and the tool's own fragments; else empty."""
    url = stripped(column)
    url = F.regexp_replace(url, r"(?i)^(https?://)[^/?#@]*@", "$1")
    url = F.regexp_replace(url, r"#pb-(?:web|issue)=.*\z", "")
    head, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)\z", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~F.regexp_like(F.substring_index(p, "=", 1), F.lit(SECRET_NAME)) & (p != ""))
    query = F.array_join(kept, "&")
    url = F.concat(head, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), tail)
    return F.when(F.regexp_like(url, F.lit(r"(?i)^https?://[^/?#]")), url).otherwise("")


def article_address(url: str | Column, doi: str | Column) -> Column:
    """The item's own address, else one made of its DOI, else empty."""
    own = stripped(url)
    name = F.regexp_replace(stripped(doi), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    made = name
    for raw, code in (("%", "%25"), (" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("#", "%23"), ("?", "%3F")):
        made = F.replace(made, F.lit(raw), F.lit(code))
    made = F.when(F.regexp_like(name, F.lit(r"(?i)^10\.\d{4,9}/\S+\z")), F.concat(F.lit("https://doi.org/"), made)).otherwise("")
    return F.when(F.regexp_like(own, F.lit("(?i)^https?://")), own).otherwise(made)


def colour(column: str | Column) -> Column:
    value = stripped(column)
    return F.when(F.regexp_like(value, F.lit(r"(?i)^#[0-9a-f]{6}\z")), F.lower(value)).otherwise(DEFAULT_COLOUR)


def page_label(pages: str | Column, index: str | Column) -> Column:
    """The printed page number: the first number of ``pages`` plus the index, else the index plus one."""
    at = F.col(index) if isinstance(index, str) else index
    first = F.nullif(F.regexp_extract(text_of(pages), r"^\s*(\d+)", 1), F.lit("")).cast("bigint")
    return (F.coalesce(first, F.lit(1)) + at).cast("string")


def note_comment(comment: str | Column, translation: str | Column) -> Column:
    """Own note and translation under their headings, those that are there, joined by a blank line."""
    part = lambda head, c: F.when(stripped(c) != "", F.concat(F.lit(head), stripped(c)))
    return F.concat_ws("\n\n", part("我的笔记：\n", comment), part("中文翻译：\n", translation))


def html_paragraphs(column: str | Column) -> Column:
    """Lines as escaped paragraphs; an empty line holds a break."""
    text = text_of(column)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    line = lambda s: F.concat(F.lit("<p>"), F.when(s == "", "<br>").otherwise(s), F.lit("</p>"))
    return F.array_join(F.transform(F.split(text, "\n", -1), line), "")


def halves_up(value: Column, digits: int) -> Column:
    """Rounded to some decimals, halves upwards, by arithmetic alone: engines differ in how their own functions see halves."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


def rounded(column: str | Column) -> Column:
    """Three decimals, halves upwards."""
    return halves_up(F.col(column) if isinstance(column, str) else column, 3)


def figure_keys(column: str | Column) -> Column:
    """All figure references of a text, in order, as one key."""
    clean = lambda k: F.translate(F.regexp_replace(F.lower(k), r"\s", ""), "–—", "--")
    return F.array_join(F.transform(F.regexp_extract_all(text_of(column), F.lit(FIGURE), F.lit(1)), clean), "|")


def fingerprint(url: Column, doi: Column, exact: Column, code: Column, message: Column) -> Column:
    """Digest that tells issues apart; the message counts for the generic codes alone."""
    generic = code.isin("unknown", "manual", "settings-error")
    parts = F.array(page_address(public_address(url)), text_of(doi), F.regexp_replace(text_of(exact), SPACE, ""), text_of(code),
                    F.when(generic, text_of(message)).otherwise(""))
    return F.sha2(F.to_json(parts), 256)


def clipped(column: str | Column, length: int = 20000) -> Column:
    return F.substring(text_of(column), 1, length)


def draft_key(url: str | Column, exact: str | Column) -> Column:
    """Where a draft belongs: origin and path, then the quote."""
    return F.concat(F.regexp_extract(text_of(url), r"^([^?#]*)", 1), F.lit("::"), text_of(exact))


def saved_identity(attachment: str, annotation: str) -> Column:
    return F.concat_ws(":", F.col(attachment).cast("string"), F.col(annotation).cast("string"))


def header(headers: str, name: str) -> Column:
    """A header's value, whatever the case of its name."""
    return F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name.lower()))[0]


def moment(column: str | Column, otherwise: Column | None = None) -> Column:
    """A timestamp from text; what can't be read is now, or ``otherwise``."""
    return F.coalesce(F.try_to_timestamp(F.col(column) if isinstance(column, str) else column), F.current_timestamp() if otherwise is None else otherwise)


def place_key(page: Column, offset: Column, top: Column) -> Column:
    """A key that sorts as page, offset and height do."""
    part = lambda c, n: F.lpad(F.substring(F.greatest(F.floor(c), F.lit(0)).cast("string"), 1, n), n, "0")
    return F.concat_ws("|", part(page, 5), part(offset, 6), part(top, 5))
