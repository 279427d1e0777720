"""Queries of the catalogue and of sampled cases, over parts, orders, pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions import text as T
from locusmill.operators import catalog, records, sampling, spans
from locusmill.plans.registry import query, table

_PART_WORDS = r"list_filter(string_split_regex(trim({}), '\s+'), lambda w: w <> '')"
_BLOCKS = f"list_filter(string_split(text, chr(10)), lambda b: len({_PART_WORDS.format('b')}) >= 12)"


@query(f"""
WITH b AS (SELECT doc_id, {_BLOCKS} AS b FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, b, unnest(list_distinct([0, len(b) // 2, len(b) - 1])) AS i FROM b WHERE len(b) > 0),
c AS (SELECT doc_id, i, array_to_string(({_PART_WORDS.format(r"regexp_replace(b[i + 1], '([A-Za-z])-\s+([a-z])', '\1\2', 'g')")})[1:60], ' ') AS text FROM i)
SELECT doc_id, CAST(i AS INTEGER) AS place, text FROM c WHERE length(text) >= 40
""")
def case_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(sampling.block_cases(F.col("text"))))


@query(f"""
WITH w AS (SELECT doc_id, {_PART_WORDS.format("text")} AS w FROM documents), s AS (SELECT doc_id, w, unnest([5, 12, 20]) AS size FROM w),
r AS (SELECT doc_id, w, size, unnest(['start', 'middle', 'end']) AS region FROM s WHERE len(w) >= size),
a AS (SELECT *, CASE region WHEN 'start' THEN 0 WHEN 'middle' THEN (len(w) - size) // 2 ELSE len(w) - size END AS pos FROM r)
SELECT doc_id, region, CAST(size AS INTEGER) AS size, array_to_string(w[pos + 1 : pos + size], ' ') AS exact, right(array_to_string(w[1:pos], ' '), 96) AS prefix,
  left(array_to_string(w[pos + size + 1 :], ' '), 96) AS suffix FROM a
""")
def short_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.inline_outer(sampling.short_cases(F.col("text")))).where("region is not null")


@query(f"""
WITH b AS (SELECT doc_id, len({_BLOCKS}) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(unnest(list_distinct(list_transform(range(12), lambda i: floor(i * (n - 1) / 11.0 + 0.5)))) AS INTEGER) AS place FROM b WHERE n > 0
""")
def even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = sampling.blocks_of(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(sampling.even_places(F.size(blocks))).alias("place"))


@query("""
WITH c AS (SELECT doc_id, text, unnest([0, 1, 2, 3]) AS page, unnest([50, 100, 0, 25]) AS n, unnest([0, 50, 150, 150]) AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(page AS INTEGER) AS page, CASE WHEN page = 3 THEN substr(text, pos + 1) ELSE substr(text, pos + 1, n) END AS text FROM c
""")
def page_slices_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.array(*map(F.lit, (50, 100, 0, 25))).alias("counts")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", counts)
    return spans.page_slices(docs, "doc_id", "text", "counts")


# Parts as items with DOIs; the requests know a part by its DOI, by a shortened DOI, by its title alone, or not at all.
_RESOLVE = """
i AS (SELECT p_partkey AS item_id, '10.5555/part' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS doi, lower(p_name) AS title FROM part),
q AS (SELECT item_id AS request_id, CASE item_id % 4 WHEN 0 THEN doi WHEN 1 THEN 'art' || lpad(CAST(item_id AS VARCHAR), 8, '0') ELSE '' END AS doi,
  CASE item_id % 4 WHEN 2 THEN title ELSE '' END AS title FROM i),
f AS (SELECT request_id, item_id, 1 AS tier FROM q JOIN i ON q.doi = i.doi AND q.doi <> ''
  UNION ALL SELECT request_id, item_id, 2 FROM q JOIN i ON q.doi <> '' AND ends_with(i.doi, q.doi)
  UNION ALL SELECT request_id, item_id, 3 FROM q JOIN i ON q.title <> '' AND contains(i.title, q.title))
"""


@query(f"""
WITH {_RESOLVE}, g AS (SELECT request_id, tier, count(*) AS n, arg_max(item_id, (item_id % 50, -item_id)) AS item FROM f GROUP BY ALL),
b AS (SELECT request_id, min(tier) AS tier FROM g GROUP BY ALL)
SELECT q.request_id, g.tier, g.item AS item_id, coalesce(g.n, 0) AS candidates FROM q LEFT JOIN b ON b.request_id = q.request_id LEFT JOIN g ON g.request_id = b.request_id AND g.tier = b.tier
""")
def item_resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14 in full: the first of three tiers with an item decides, and of its items the newest."""
    key = F.col("p_partkey")
    number = F.lpad(key.cast("string"), 8, "0")
    parts = table(spark, sf_dir, "part")
    items = parts.select(key.alias("item_id"), F.concat(F.lit("https://doi.org/10.5555/PART"), number).alias("doi"), F.col("p_name").alias("title"), F.timestamp_seconds(key % 50).alias("added"))
    doi = F.when(key % 4 == 0, F.concat(F.lit("10.5555/Part"), number)).when(key % 4 == 1, F.concat(F.lit("art"), number))
    requests = parts.select(key.alias("request_id"), doi.alias("doi"), F.when(key % 4 == 2, F.col("p_name")).alias("title"))
    return catalog.resolved(requests, items)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 401 WHEN o_orderkey % 5 = 0 THEN 409 WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 409 ELSE 200 END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 400 WHEN o_orderkey % 4 = 1 THEN 400 ELSE 200 END AS import_status FROM orders
""")
def request_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17 to FLT-20: token, identity and duplicate gates, and the fields of an import."""
    key = F.col("o_orderkey")
    mine, other = F.when(key % 2 == 0, F.lit(" 10.1/A")), F.when(key % 5 == 0, F.lit("10.1/B")).otherwise("https://doi.org/10.1/a")
    title, its = F.lit(" The Title "), F.when(key % 5 == 0, F.lit("another")).otherwise("the title")
    same = catalog.same_document(mine, other, title, its)
    status = catalog.gate(F.when(key % 7 != 0, F.lit("t")), F.lit("t"), same, F.when(key % 3 == 0, 2).otherwise(1), key % 2 == 0)
    made = catalog.import_status(F.when(key % 4 == 0, F.lit("  ")).otherwise("x"), F.when(key % 4 == 1, F.lit("ftp://a")).otherwise("HTTPS://a"))
    return table(spark, sf_dir, "orders").select(key, status.alias("status"), made.alias("import_status"))


@query("""
WITH n AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'doi:10.1/' || page_id // 6 ELSE 'url:' || split_part(url, '#', 1) END AS k FROM pages),
o AS (SELECT k, min(page_id) AS page_id FROM n GROUP BY k)
SELECT page_id FROM o WHERE k NOT IN (SELECT k FROM n WHERE page_id % 10 = 0)
""")
def document_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: of the pages those whose document is new, by DOI or address; every tenth page is known already."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("10.1/"), F.floor(F.col("page_id") / 6))).alias("doi"), "url")
    return catalog.imported(pages, pages.where("page_id % 10 = 0"), ["page_id"]).select("page_id")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey, '/' || l_returnflag || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '/' || l_linestatus || '/' || l_linenumber END AS path FROM lineitem)
SELECT l_orderkey, path FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.l_orderkey = s.l_orderkey AND starts_with(s.path, o.path || '/'))
""")
def outermost_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("/"), "l_linestatus", F.lit("/"), "l_linenumber"))
    scopes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("/"), "l_returnflag", more).alias("path")).distinct()
    return catalog.outermost(scopes, "l_orderkey", "path")


@query("""
WITH w AS (SELECT DISTINCT conv_id FROM conversations), e AS (SELECT conv_id, unnest(['assistant', 'system', 'user']) AS role FROM w),
f AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)
SELECT e.conv_id, coalesce(string_agg(CASE WHEN n IS NULL THEN e.role END, ',' ORDER BY e.role), '') AS missing, coalesce(bool_or(n > 1), false) AS repeated
FROM e LEFT JOIN f ON f.conv_id = e.conv_id AND f.role = e.role GROUP BY e.conv_id
""")
def missing_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04, AGG-15, AGG-16: roles that a conversation lacks, and whether one comes twice."""
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("assistant", "system", "user")).select("conv_id", "role")
    wanted = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, ("assistant", "system", "user")))).alias("role"))
    return catalog.markers(rows, "conv_id", "role", wanted).select("conv_id", F.array_join("missing", ",").alias("missing"), "repeated")


@query("""
SELECT user_id, count(*) AS occurrences, min(CAST(ts AS DATE)) AS first_version, max(CAST(ts AS DATE)) AS last_version, count(DISTINCT CAST(ts AS DATE)) AS versions,
  array_to_string(list_slice(list(event_type ORDER BY ts, event_id), -100, -1), ',') AS history FROM events GROUP BY user_id
""")
def issue_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03, STR-15: first, last and number of versions of an issue, and its last hundred states in order."""
    return records.with_history(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("ts").cast("date"), most=100)


@query("""
SELECT o_custkey, count(*) AS n_annotations, CAST(least(count(*), 99) AS BIGINT) AS badge, min(o_totalprice) AS least_score,
  string_agg(o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END, '' ORDER BY o_orderdate, o_orderkey) AS joined FROM orders GROUP BY o_custkey
""")
def joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09, AGG-10, AGG-13: counts, the least score of several parts, and their texts in order with the spaces they ask for."""
    part = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(""))
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_annotations"), F.least(F.count(F.lit(1)), F.lit(99).cast("bigint")).alias("badge"), F.min("o_totalprice").alias("least_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", part.alias("part")))), lambda s: s["part"]), "").alias("joined"),
    )
    return grouped


@query("""
WITH r AS (SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity) AS x1, max(l_tax) AS y1 FROM lineitem GROUP BY ALL)
SELECT l_orderkey, floor(x0 * 1000 + 0.5) / 1000 AS x0, floor((100 - y1) * 1000 + 0.5) / 1000 AS y0, floor(x1 * 1000 + 0.5) / 1000 AS x1, floor((100 - y0) * 1000 + 0.5) / 1000 AS y1,
  x0 >= 5 - 4 AND x1 <= 45 + 4 AND y0 >= 0 - 4 AND y1 <= 1 + 4 AS inside FROM r
""")
def segment_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, JN-26: the box around a segment's words, turned to a page of height 100, and whether its words lie in an expected box."""
    rect = F.struct(F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), F.col("l_quantity").alias("x1"), F.col("l_tax").alias("y1"))
    box = F.struct(F.lit(5.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(45.0).alias("x1"), F.lit(1.0).alias("y1"))
    words = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_quantity").alias("x0"), F.min("l_discount").alias("top"), F.max("l_quantity").alias("x1"), F.max("l_tax").alias("bottom"), F.bool_and(catalog.in_box(rect, box)).alias("inside")
    )
    return words.select(
        "l_orderkey", T.rounded("x0").alias("x0"), T.rounded(100 - F.col("bottom")).alias("y0"), T.rounded("x1").alias("x1"), T.rounded(100 - F.col("top")).alias("y1"), "inside"
    )
