"""Text blocks, headings and metadata of HTML pages (SRC-06, SRC-09, SRC-10, SRC-17, FLT-02, FLT-08, FLT-21).

A block is the text of an element that holds text and no other block. What lies in navigation,
headers, footers, scripts, buttons and the like is left out, and links to references are left out
of the text. Defined cases: null and empty pages have no block; tags that are never closed end
with the page or with the next block of their kind; texts of any length are taken whole.
"""

from __future__ import annotations

import html.parser
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from locusmill.functions.text import text_of

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTAINERS = frozenset((*HEADINGS, "p", "li", "blockquote", "figcaption", "td", "th", "dd", "dt", "div"))
HIDDEN = frozenset(("nav", "header", "footer", "script", "style", "noscript", "template", "button", "select", "textarea", "svg", "head"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
REFERENCE = re.compile(r"^#(?:ref|bib|cite|r\d|b\d|cr\d)", re.I)

BLOCKS = ArrayType(StructType([StructField(n, t) for n, t in (("place", IntegerType()), ("tag", StringType()), ("id", StringType()), ("text", StringType()), ("heading", StringType()))]))


class _Blocks(html.parser.HTMLParser):
    """Collects blocks while reading; only open elements are held."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self._open: list[str] = []
        self._block: dict | None = None
        self._hidden = self._reference = 0
        self._heading: str | None = None

    def _close_block(self) -> None:
        block, self._block = self._block, None
        text = re.sub(r"\s+", " ", "".join(block["parts"])).strip() if block else ""
        if text:
            if block["tag"] in HEADINGS:
                self._heading = text
            self.rows.append({"place": len(self.rows), "tag": block["tag"], "id": block["id"], "text": text, "heading": None if block["tag"] in HEADINGS else self._heading})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "hr") and self._block:
                self._block["parts"].append(" ")
            return
        self._open.append(tag)
        named = dict(attrs)
        self._hidden += tag in HIDDEN
        reference = tag == "a" and (named.get("role") == "doc-noteref" or bool(REFERENCE.match(named.get("href") or "")))
        if self._reference or reference:
            self._reference += 1
        if tag in CONTAINERS:
            self._close_block()
            self._block = {"tag": tag, "id": named.get("id"), "parts": []}

    def handle_endtag(self, tag: str) -> None:
        if tag not in self._open:
            return
        while self._open:
            last = self._open.pop()
            self._hidden -= last in HIDDEN
            self._reference -= bool(self._reference)
            if last in CONTAINERS:
                self._close_block()
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if self._block and not self._hidden and not self._reference:
            self._block["parts"].append(data)

    def close(self) -> None:
        super().close()
        self._close_block()


def blocks_of(page: str | None) -> list[dict]:
    """The blocks of one page in order."""
    reader = _Blocks()
    reader.feed(page or "")
    reader.close()
    return reader.rows


@F.pandas_udf(BLOCKS)
def text_blocks(pages: pd.Series) -> pd.Series:
    """The blocks of every page with their tag, id and the heading they stand under."""
    return pages.map(blocks_of)


def meta(page: str | Column, name: str) -> Column:
    """The contents of all meta tags of a name, in order; attributes in either order."""
    text, quoted = text_of(page), name.replace(".", r"\.")
    tag = rf"(?is)<meta(?=[^>]*\s(?:name|property)=[\"']{quoted}[\"'])[^>]*\scontent=[\"']([^\"']*)"
    return F.regexp_extract_all(text, F.lit(tag), F.lit(1))


def bibliography(page: str | Column) -> Column:
    """title, journal, date, volume, issue and issn (null if absent) and authors from a page's citation tags; at most 100 authors."""
    one = lambda name: F.nullif(F.trim(F.coalesce(F.get(meta(page, f"citation_{name}"), F.lit(0)), F.lit(""))), F.lit(""))
    authors = F.slice(F.filter(F.transform(meta(page, "citation_author"), lambda a: F.trim(a)), lambda a: a != ""), 1, 100)
    return F.struct(one("title").alias("title"), one("journal_title").alias("journal"), one("publication_date").alias("date"), one("volume").alias("volume"),
                    one("issue").alias("issue"), one("issn").alias("issn"), authors.alias("authors"))
