"""Queries that find passages of ``benchmark`` in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions import text as T
from locusmill.operators import locate, spans
from locusmill.plans.registry import query, table
from locusmill.plans.text_queries import _PROSE

_WORDS = rf"regexp_extract_all({_PROSE}, '[\p{{L}}\p{{N}}]+')"
_FOUND = f"""
p AS (SELECT doc_id, {_PROSE} AS t FROM documents), s AS (SELECT item_id, {_PROSE} AS q FROM benchmark),
f AS (SELECT item_id AS selector_id, doc_id, CAST(strpos(t, q) - 1 AS INTEGER) AS first_at,
  CAST((length(t) - length(replace(t, q, ''))) / length(q) AS INTEGER) AS n_found FROM s JOIN p ON q <> '' AND contains(t, q))
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prose = T.normal_prose("text", composed=True).alias("text")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("selector_id"), prose), table(spark, sf_dir, "documents").select("doc_id", prose)


@query(f"WITH {_FOUND} SELECT selector_id, doc_id, first_at, n_found FROM f")
def locate_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.located(*_sides(spark, sf_dir))


@query(f"""
WITH {_FOUND}, g AS (SELECT selector_id, sum(n_found) AS n, min(doc_id) AS place FROM f GROUP BY ALL)
SELECT item_id AS selector_id, CASE WHEN n IS NULL THEN 'not-found' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status,
  CAST(coalesce(n, 0) AS BIGINT) AS n_places, CASE WHEN n = 1 THEN place END AS doc_id
FROM s LEFT JOIN g ON selector_id = item_id
""")
def status_by_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    selectors, pages = _sides(spark, sf_dir)
    return locate.verdicts(selectors, locate.located(selectors, pages))


# Three words from the middle of each item, which recur elsewhere, with the words on either side as context.
_RANKED = f"""
p AS (SELECT doc_id, {_PROSE} AS t FROM documents), w AS (SELECT item_id, string_split({_PROSE}, ' ') AS w FROM benchmark),
s AS (SELECT item_id, array_to_string(w[4:6], ' ') AS q, array_to_string(w[1:3], ' ') AS pre, array_to_string(w[7:9], ' ') AS suf FROM w),
f AS (SELECT item_id AS selector_id, doc_id, t, q, pre, suf, string_split(t, q) AS parts FROM s JOIN p ON q <> '' AND contains(t, q)),
e AS (SELECT *, unnest(range(1, len(parts))) AS k FROM f),
a AS (SELECT *, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(q) AS BIGINT) AS "at" FROM e),
ranked AS (SELECT selector_id, doc_id, "at", length(q) AS length, 1
  + 0.5 * CAST(pre <> '' AND ends_with(trim(substr(t, CAST(greatest("at" - 2 * length(pre) - 8, 0) + 1 AS BIGINT), CAST("at" - greatest("at" - 2 * length(pre) - 8, 0) AS BIGINT))), pre) AS INTEGER)
  + 0.5 * CAST(suf <> '' AND starts_with(trim(substr(t, "at" + length(q) + 1, 2 * length(suf) + 8)), suf) AS INTEGER) AS score FROM a)
"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    selectors, pages = _sides(spark, sf_dir)
    part = lambda at: F.array_join(F.slice(F.split("text", " ", -1), at, 3), " ")
    return selectors.select("selector_id", part(4).alias("text"), part(1).alias("prefix"), part(7).alias("suffix")), pages


@query(f"""
WITH {_RANKED} SELECT selector_id, doc_id, "at", CAST(length AS INTEGER) AS length, CAST(score AS DOUBLE) AS score,
  CAST(row_number() OVER (PARTITION BY selector_id ORDER BY score DESC, doc_id, "at") AS INTEGER) AS place FROM ranked
""")
def ranked_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every selector in its order: by context, then page, then offset."""
    return locate.in_order(locate.ranked(*_asked(spark, sf_dir))).drop("method")


@query(f"""
WITH {_RANKED}, m AS (SELECT *, max(score) OVER (PARTITION BY selector_id) AS best FROM ranked),
k AS (SELECT * FROM m WHERE (best < 0.97 OR score >= 0.97) AND (best <= 1 OR score = best)),
g AS (SELECT selector_id, count(*) AS n, min(doc_id) AS d, min("at") AS a, CAST(min(length) AS INTEGER) AS l, CAST(min(score) AS DOUBLE) AS c FROM k GROUP BY ALL)
SELECT item_id AS selector_id, CASE WHEN n IS NULL THEN 'not-found' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS n_places,
  CASE WHEN n = 1 THEN d END AS doc_id, CASE WHEN n = 1 THEN a END AS "at", CASE WHEN n = 1 THEN l END AS length, CASE WHEN n = 1 THEN c END AS score, CASE WHEN n = 1 THEN 'exact' END AS method
FROM s LEFT JOIN g ON selector_id = item_id
""")
def located_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict for each selector: context decides between several places only where one is strictly best."""
    selectors, pages = _asked(spark, sf_dir)
    return locate.settled(selectors, locate.best_only(locate.ranked(selectors, pages)))


@query(f"""
WITH {_RANKED}, k AS (SELECT selector_id, doc_id, "at", score, row_number() OVER (PARTITION BY selector_id ORDER BY score DESC, doc_id, "at") AS place FROM ranked)
SELECT selector_id, count(*) > 1 AS several, min(doc_id) FILTER (place = 1) AS doc_id FROM k WHERE place <= 2 GROUP BY selector_id
""")
def uniqueness_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-08: two places are enough to know that a selector isn't unique."""
    two = locate.in_order(locate.ranked(*_asked(spark, sf_dir)), most=2)
    return two.groupBy("selector_id").agg((F.count(F.lit(1)) > 1).alias("several"), F.min(F.when(F.col("place") == 1, F.col("doc_id"))).alias("doc_id"))


@query(f"""
WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
c AS (SELECT item_id, list_filter(w, lambda x: x <> 'the') AS q, len(w) AS n FROM w WHERE len(list_filter(w, lambda x: x <> 'the')) >= 8),
d AS (SELECT doc_id, list_filter(list_zip({_WORDS}, range(len({_WORDS}))), lambda z: z[1] <> 'the') AS z FROM documents),
e AS (SELECT doc_id, list_transform(z, lambda y: y[1]) AS v, list_transform(z, lambda y: y[2]) AS "at" FROM d),
m AS (SELECT * FROM c JOIN e ON contains(' ' || array_to_string(v, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ')),
i AS (SELECT *, unnest(range(1, len(v) - len(q) + 2)) AS i FROM m)
SELECT item_id AS selector_id, doc_id, CAST("at"[i] AS INTEGER) AS "first", CAST("at"[i + len(q) - 1] AS INTEGER) AS "last" FROM i
WHERE v[i : i + len(q) - 1] = q AND abs("at"[i + len(q) - 1] - "at"[i] + 1 - n) <= 2
""")
def tolerant_article_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10: quotes that lost every 'the' still meet their pages; no other word may differ."""
    words = T.normal_prose("text", composed=True)
    tokens = F.regexp_extract_all(words, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("tokens")
    selectors = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("selector_id"), tokens)
    return spans.article_matches(selectors, table(spark, sf_dir, "documents").select("doc_id", tokens))
