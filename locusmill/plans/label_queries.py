"""Queries of the scalar functions on addresses, labels, notes and keys, over orders, parts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions import text as T
from locusmill.functions import tokens as K
from locusmill.plans.registry import query, table
from locusmill.plans.text_queries import _READABLE


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '#ab' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') ELSE '#ffd400' END AS colour,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 500 + o_orderkey % 7 AS VARCHAR) ELSE CAST(o_orderkey % 7 + 1 AS VARCHAR) END AS label,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '我的笔记：' || chr(10) || o_orderpriority WHEN 2 THEN '中文翻译：' || chr(10) || o_orderstatus
    ELSE '我的笔记：' || chr(10) || o_orderpriority || chr(10) || chr(10) || '中文翻译：' || chr(10) || o_orderstatus END AS note,
  '<p>' || replace(o_orderpriority, '&', '&amp;') || '</p><p><br></p><p>&lt;' || o_orderstatus || '&gt; &amp;</p>' AS html,
  o_orderkey || ':' || o_custkey AS identity, floor(o_totalprice / 7 * 1000 + 0.5) / 1000 AS rounded, 'http://a.b/c::' || o_orderstatus AS draft
FROM orders
""")
def annotation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-14 to FN-18, FN-25, FN-30: colour, page label, note, note as HTML, rounding and keys of an annotation."""
    key = F.col("o_orderkey")
    said = lambda rest, c: F.when((key % 4).isin(*rest), F.concat(F.lit(" "), F.col(c), F.lit("\n")))
    raw = F.when(key % 3 == 0, F.concat(F.lit(" #AB"), F.lpad((key % 10000).cast("string"), 4, "0"))).when(key % 3 == 1, F.lit("#12345g"))
    pages = F.when(key % 3 == 0, F.concat(F.lit(" "), key % 500, F.lit("-99"))).when(key % 3 == 1, F.lit("e12"))
    return table(spark, sf_dir, "orders").select(
        key, T.colour(raw).alias("colour"), T.page_label(pages, key % 7).alias("label"), T.note_comment(said((1, 3), "o_orderpriority"), said((2, 3), "o_orderstatus")).alias("note"),
        T.html_paragraphs(F.concat("o_orderpriority", F.lit("\n\n<"), "o_orderstatus", F.lit("> &"))).alias("html"), T.saved_identity("o_orderkey", "o_custkey").alias("identity"),
        T.rounded(F.col("o_totalprice") / 7).alias("rounded"), T.draft_key(F.lit("http://a.b/c?d#e"), "o_orderstatus").alias("draft"),
    )


@query("""
SELECT page_id, '10.1234/ab-' || page_id AS cleaned, '10.1234/' || ['meta', 'dc', 'og', 'link', 'url'][page_id % 5 + 1] || '-' || page_id AS doi FROM pages
""")
def page_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, FN-11: the DOI of a page by the most trusted place that has one."""
    key = F.col("page_id").cast("string")
    tags = {"meta": '<meta name="citation_doi" content="doi:10.1234/META-%s.">', "dc": '<meta name="dc.identifier" content="10.1234/dc-%s">',
            "og": '<meta property="og:doi" content="(10.1234/OG-%s)">', "link": '<link rel="canonical" href="https://doi.org/10.1234/link-%s">'}
    lines = [F.when(F.col("page_id") % 5 <= i, F.replace(F.lit(tag), F.lit("%s"), key)).otherwise("") for i, tag in enumerate(tags.values())]
    return table(spark, sf_dir, "pages").select(
        "page_id", T.clean_doi(F.concat(F.lit(" https://dx.doi.org/10.1234/AB-"), key)).alias("cleaned"),
        T.page_doi(F.concat("html", *lines), F.concat(F.lit("http://x/10.1234/url-"), key)).alias("doi"),
    )


@query(rf"""
SELECT doc_id, regexp_replace(regexp_replace(lower({_READABLE}), '\s+', '', 'g'), '[。.!?！？]+$', '') AS key, left(coalesce(text, ''), 200) AS clipped,
  doc_id % 2 = 0 AND lang = 'en' AND regexp_matches(coalesce(text, ''), '[A-Za-z]{{2}}') AND NOT regexp_matches(coalesce(text, ''), '[\x{{3400}}-\x{{9fff}}]') AS quotable,
  CASE doc_id % 2 WHEN 0 THEN 's' || doc_id || '|3a-c' ELSE '' END AS figures
FROM documents
""")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-10, FN-20, FN-22, FLT-03, FLT-04."""
    figures = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see Fig. S"), "doc_id", F.lit(" and 图 3a – C here")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.translation_key("text").alias("key"), T.clipped("text", 200).alias("clipped"),
        T.quotable("text", "lang", F.when(F.col("doc_id") % 2 == 1, F.lit("issue"))).alias("quotable"), T.figure_keys(figures).alias("figures"),
    )


@query(r"""
WITH u AS (SELECT doc_id, unnest(regexp_extract_all('前言' || doc_id || '。他说：「好！」然后走了？”尾', '[^。！？]+[。！？][”’」』）)\]]*')) AS unit FROM documents)
SELECT doc_id, count(*) AS n, string_agg(length(unit), ',' ORDER BY unit) AS sizes FROM u GROUP BY doc_id
""")
def cjk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-10: Chinese sentences with the brackets and quotes that close them."""
    said = F.concat(F.lit("前言"), "doc_id", F.lit("。他说：「好！」然后走了？”尾"))
    units = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(K.cjk_sentences(said)).alias("u"))
    return units.select("doc_id", F.size("u").cast("bigint").alias("n"), F.array_join(F.transform("u", lambda x: F.length(x).cast("string")), ",").alias("sizes"))


@query("""
SELECT event_id, sha256('["https://a.b/' || user_id || '","10.1/x","' || event_type || '","' || CASE WHEN event_id % 2 = 0 THEN 'manual' ELSE 'gone' END || '","'
  || CASE WHEN event_id % 2 = 0 THEN 'm' || event_id ELSE '' END || '"]') AS fingerprint, event_type AS header, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2020-01-01' ELSE ts END AS moment
FROM events
""")
def issue_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-21, FN-27, FN-31: the digest that tells issues apart, a header whatever its case, and times that may not be readable."""
    even = F.col("event_id") % 2 == 0
    code, url = F.when(even, "manual").otherwise("gone"), F.concat(F.lit("https://me@a.b/"), "user_id", F.lit("#part"))
    headers = F.create_map(F.lit("X-Other"), F.lit("-"), F.when(even, "X-KIND").otherwise("x-kind"), F.col("event_type"))
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("not a time")).otherwise(F.col("ts").cast("string"))
    events = table(spark, sf_dir, "events").withColumn("headers", headers)
    return events.select(
        "event_id", T.fingerprint(url, F.lit("10.1/x"), F.concat(F.lit(" "), "event_type", F.lit("\n")), code, F.concat(F.lit("m"), "event_id")).alias("fingerprint"),
        T.header("headers", "X-Kind").alias("header"), T.moment(raw, F.lit("2020-01-01").cast("timestamp")).cast("timestamp_ntz").alias("moment"),
    )
