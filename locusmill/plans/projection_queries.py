"""Queries that lead places of normalised texts back to raw offsets (FN-03, ARR-15, ARR-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions import projection as P
from locusmill.functions import text as T
from locusmill.operators import locate
from locusmill.operators.spans import sums_of
from locusmill.plans.registry import query, table
from locusmill.plans.text_queries import _PROSE

#: Documents whose long words are broken at line ends, as print is.
_BROKEN = r"regexp_replace(coalesce(text, ''), '([A-Za-z]{4})([A-Za-z]{4})', '\1-' || chr(10) || '\2', 'g')"
_WHITE = r"regexp_full_match({}, '\s')"
_LETTER = "regexp_full_match({}, '[A-Za-z]')"
#: Of a raw text r in characters c, the numbers of those that its prose keeps.
_KEPT_OF_PROSE = f"""list_filter(range(1, len(c) + 1), lambda i: NOT (
  coalesce(c[i] = '-' AND c[i + 1] = chr(10) AND {_LETTER.format("c[i - 1]")} AND {_LETTER.format("c[i + 2]")}, false)
  OR coalesce(c[i] = chr(10) AND c[i - 1] = '-' AND {_LETTER.format("c[i - 2]")} AND {_LETTER.format("c[i + 1]")}, false)
  OR ({_WHITE.format("c[i]")} AND (i = 1 OR {_WHITE.format("c[i - 1]")}))))"""
_ALL_PLACES = """
f AS (SELECT selector_id, doc_id, q, string_split(t, q) AS parts FROM s JOIN p ON q <> '' AND contains(t, q)),
e AS (SELECT *, unnest(range(1, len(parts))) AS k FROM f),
a AS (SELECT selector_id, doc_id, q, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(q) AS BIGINT) AS "at" FROM e)
"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.regexp_replace(T.text_of("text"), "([A-Za-z]{4})([A-Za-z]{4})", "$1-\n$2")
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query(rf"""
WITH r AS (SELECT doc_id, {_BROKEN} AS text FROM documents), p AS (SELECT doc_id, text AS r, {_PROSE} AS t FROM r),
s AS (SELECT item_id AS selector_id, {_PROSE} AS q FROM benchmark), {_ALL_PLACES},
c AS (SELECT doc_id, r, regexp_extract_all(r, '(?s).') AS c FROM p SEMI JOIN a USING (doc_id)), k AS (SELECT doc_id, r, {_KEPT_OF_PROSE} AS kept FROM c),
x AS (SELECT a.*, r, kept["at" + 1] - 1 AS "start", kept["at" + length(q)] AS stop FROM a JOIN k USING (doc_id))
SELECT selector_id, doc_id, CAST("at" AS INTEGER) AS "at", CAST("start" AS INTEGER) AS "start", CAST(stop AS INTEGER) AS stop, md5(substr(r, "start" + 1, stop - "start")) AS cut_md5,
  true AS same, CAST(length(left(r, "start")) - length(replace(left(r, "start"), chr(10), '')) AS INTEGER) AS first_line,
  CAST(length(string_split(left(r, "start"), chr(10))[-1]) AS INTEGER) AS first_at,
  CAST(length(left(r, stop - 1)) - length(replace(left(r, stop - 1), chr(10), '')) AS INTEGER) AS last_line, CAST(1 + length(string_split(left(r, stop - 1), chr(10))[-1]) AS INTEGER) AS last_at
FROM x
""")
def raw_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every item in raw offsets of documents with words broken at line ends, and on their lines.

    ``same`` tells whether the raw cut normalises to the quote.
    """
    pages = _broken(spark, sf_dir)
    selectors = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("selector_id"), T.normal_prose("text", composed=True).alias("text"))
    found = locate.places(selectors, pages.select("doc_id", T.normal_prose("raw", composed=True).alias("text")))
    held = pages.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "raw", P.prose_of(P.raw("raw")).alias("projection"))
    rows = locate.raw_places(found, held).join(selectors.withColumnRenamed("text", "quote"), "selector_id")
    rows = rows.withColumn("cut", F.substring("raw", F.col("start") + 1, F.col("stop") - F.col("start")))
    # The text nodes of a document are its lines, each with its line end.
    ends = sums_of(F.concat(F.transform(F.split("raw", "\n", -1), lambda x: (F.length(x) + 1).cast("bigint")), F.array(F.lit(0).cast("bigint"))), skip=1)
    rows = rows.withColumn("slice", P.slice_of(ends, F.col("start"), F.col("stop")))
    return rows.select(
        "selector_id", "doc_id", F.col("at").cast("int").alias("at"), "start", "stop", F.md5("cut").alias("cut_md5"), (T.normal_prose("cut", composed=True) == F.col("quote")).alias("same"),
        F.col("slice.first").alias("first_line"), F.col("slice.first_at").alias("first_at"), F.col("slice.last").alias("last_line"), F.col("slice.last_at").alias("last_at"),
    )


@query(r"""
WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([A-Z][a-z]+)', '<em>\1</em>', 'g'), '\. ', '.&nbsp; ', 'g') AS r FROM documents),
t AS (SELECT doc_id, regexp_extract_all(r, '(?i)<\s*/?\s*(?:sup|sub|em|strong|i|b)\s*>|&nbsp;|\s+|[^\s<&]+|[<&]') AS tok FROM r),
u AS (SELECT doc_id, unnest(tok) AS tok, generate_subscripts(tok, 1) AS i FROM t),
b AS (SELECT *, regexp_full_match(tok, '(?i)<\s*/?\s*(?:sup|sub|em|strong|i|b)\s*>|&nbsp;|\s+') AS blank, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM u),
n AS (SELECT *, sum(CAST(blank AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS word FROM b),
w AS (SELECT doc_id, word, min(stop - length(tok)) AS "start", max(stop) AS stop FROM n WHERE NOT blank GROUP BY ALL)
SELECT doc_id, count(*) AS n_words, md5(string_agg(CAST("start" AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY "start")) AS places_md5 FROM w GROUP BY doc_id
""")
def readable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw places of all words of the readable text, in documents with tags and entities for spaces put in by rule."""
    raw = F.regexp_replace(F.regexp_replace(T.text_of("text"), "([A-Z][a-z]+)", "<em>$1</em>"), r"\. ", ".&nbsp; ")
    rows = table(spark, sf_dir, "documents").select("doc_id", P.readable_of(P.raw(raw)).alias("p"))
    # One entry for each word: where it begins in the readable text, in which single spaces divide words.
    rows = rows.where(F.col("p.text") != "").withColumn("words", F.split("p.text", " ", -1))
    rows = rows.withColumn("at", sums_of(F.transform("words", lambda w: (F.length(w) + 1).cast("bigint"))))
    place = lambda r: F.concat_ws(":", r["start"].cast("string"), r["stop"].cast("string"))
    ranges = F.transform(P.back_all(F.col("p.maps"), F.col("at"), F.zip_with("at", "words", lambda at, w: at + F.length(w))), place)
    return rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.md5(F.array_join(ranges, ",")).alias("places_md5"))


@query(r"""
WITH s AS (SELECT item_id AS selector_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS q FROM benchmark),
p AS (SELECT doc_id, text AS r, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS t FROM documents),
f AS (SELECT selector_id, doc_id, q, r, strpos(t, q) AS "at" FROM s JOIN p ON length(q) >= 12 AND contains(t, q)),
c AS (SELECT *, regexp_extract_all(r, '(?s).') AS c FROM f), k AS (SELECT *, list_filter(range(1, len(c) + 1), lambda i: regexp_full_match(c[i], '[\p{L}\p{N}]')) AS kept FROM c)
SELECT selector_id, doc_id, CAST(kept["at"] - 1 AS INTEGER) AS "start", CAST(kept["at" + length(q) - 1] AS INTEGER) AS stop, true AS same FROM k
""")
def quote_key_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first raw place of each item whose letters and digits a document holds in a row, whatever marks and spaces lie between."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw"))
    key = lambda c: T.letters_and_digits(c, composed=True)
    selectors = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("selector_id"), key("text").alias("text")).where(F.length("text") >= 12)
    found = locate.located(selectors, docs.select("doc_id", key("raw").alias("text")))
    found = found.join(selectors.withColumnRenamed("text", "quote"), "selector_id").select("selector_id", "doc_id", "quote", F.col("first_at").alias("at"), F.length("quote").alias("length"))
    held = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "raw", P.quote_key_of(P.raw("raw")).alias("projection"))
    rows = locate.raw_places(found, held)
    cut = F.substring("raw", F.col("start") + 1, F.col("stop") - F.col("start"))
    return rows.select("selector_id", "doc_id", "start", "stop", (key(cut) == F.col("quote")).alias("same"))
