"""Queries about places inside texts, and of records in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions import tokens as K
from locusmill.operators import records, spans
from locusmill.plans.registry import query, table
from locusmill.plans.text_queries import _PROSE
from locusmill.sources.tables import dealt

#: Order lines of a part, which one task sorts.
LINES_EACH = 200_000
_WORDS = rf"regexp_extract_all({_PROSE}, '[\p{{L}}\p{{N}}]+')"


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = K.word_tokens("text", composed=True).alias("tokens")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("selector_id"), words), table(spark, sf_dir, "documents").select("doc_id", words)


@query("""
WITH p AS (SELECT doc_id, string_split(text, ' the ') AS s FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(s) AS piece, unnest(range(len(s))) AS i FROM p),
o AS (SELECT doc_id, i, sum(length(piece) + 5) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5 AS found_at FROM e)
SELECT doc_id, CAST(found_at AS BIGINT) AS "offset" FROM o WHERE i > 0
""")
def occurrence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text", " the ")


@query("""
WITH e AS (SELECT doc_id, text, unnest(['nn', 'ere', 'tt']) AS phrase FROM documents),
i AS (SELECT doc_id, phrase, text, unnest(range(length(text))) AS i FROM e WHERE contains(text, phrase))
SELECT doc_id, phrase, i AS "offset" FROM i WHERE substr(text, i + 1, length(phrase)) = phrase
""")
def occurrence_positions_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, ("nn", "ere", "tt")))).alias("phrase"))
    return docs.select("doc_id", "phrase", F.explode(spans.offsets_of(F.col("text"), F.col("phrase"), overlapping=True)).alias("offset"))


_LINES = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS page FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, page, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM l)
"""


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.split_bounds(table(spark, sf_dir, "documents"), "doc_id", F.split("text", "\n", -1), "page")


@query(f"""WITH {_LINES} SELECT doc_id, page, "start", "start" + length(line) AS "end" FROM b""")
def page_split_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir)


@query(f"""
WITH {_LINES}, o AS (SELECT doc_id, unnest([0, 100, 1000, 10000]) AS "offset" FROM documents)
SELECT o.doc_id, o."offset", min(CASE WHEN o."offset" < b."start" + length(line) THEN page END) AS page FROM o LEFT JOIN b ON b.doc_id = o.doc_id GROUP BY ALL
""")
def page_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (0, 100, 1000, 10000)))).alias("offset"))
    return spans.pages_of(asked, _bounds(spark, sf_dir), "doc_id", "page")


_TOKENS = f"p AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT item_id AS selector_id, {_WORDS} AS q FROM benchmark)"


@query(f"""
WITH {_TOKENS}, c AS (SELECT * FROM s JOIN p ON len(q) > 0 AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ')),
e AS (SELECT selector_id, doc_id, w, q, unnest(range(len(w))) AS i FROM c)
SELECT selector_id, doc_id, i AS "start" FROM e WHERE w[i + 1 : i + len(q)] = q
""")
def token_sequence_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.token_starts(*_tokens(spark, sf_dir))


@query(f"""
WITH {_TOKENS}, h AS (SELECT selector_id, len(q) AS n, CAST(least(7, len(q) // 3) AS INTEGER) AS k, q FROM s WHERE len(q) >= 12),
c AS (SELECT * FROM h JOIN p ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(q[1:k], ' ') || ' ')
  AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(q[n - k + 1 : n], ' ') || ' ')),
e AS (SELECT *, unnest(range(len(w))) AS i FROM c),
a AS (SELECT selector_id, doc_id, n, k, i FROM e WHERE w[i + 1 : i + k] = q[1:k]), z AS (SELECT selector_id, doc_id, i FROM e WHERE w[i + 1 : i + k] = q[n - k + 1 : n])
SELECT a.selector_id, a.doc_id, a.i AS "first", min(z.i) + a.k - 1 AS "last" FROM a JOIN z ON z.selector_id = a.selector_id AND z.doc_id = a.doc_id
WHERE z.i >= a.i + a.k AND z.i - a.i <= a.n + 16 GROUP BY a.selector_id, a.doc_id, a.i, a.k
""")
def fragment_band_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle token of each quote is changed; ends alone decide, so the SQL may keep it."""
    selectors, pages = _tokens(spark, sf_dir)
    middle = F.floor(F.size("tokens") / 2)
    changed = F.transform("tokens", lambda t, i: F.when(i == middle, F.lit("changed")).otherwise(t))
    return spans.band_matches(selectors.withColumn("tokens", changed), pages)


@query("""
WITH o AS (SELECT l_orderkey, l_extendedprice AS x0, l_extendedprice + l_quantity * 100 AS x1 FROM lineitem),
m AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > 1000 OR lag(x1) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY x0, x1)),
g AS (SELECT *, CAST(sum(s) OVER (PARTITION BY l_orderkey ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM m)
SELECT l_orderkey, segment, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY ALL
""")
def margin_gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    boxes = dealt(lines, "l_orderkey", lines.count(), LINES_EACH).select("l_orderkey", F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + F.col("l_quantity") * 100).alias("x1"))
    return spans.islands(boxes, ["l_orderkey"], "x0", "x1", F.lit(1000))


@query("""
SELECT user_id, count(*) AS occurrences, CASE WHEN count(*) > 1 AND bool_or(event_type = 'purchase') AND arg_max(event_type, (ts, event_id)) <> 'purchase' THEN 'unresolved'
  WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'resolved' ELSE 'new' END AS status FROM events GROUP BY user_id
""")
def issue_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase resolves a user's issue; whatever comes later opens it again."""
    return records.reopened(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")


@query("SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS child FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey")
def first_child_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'")
    return lines.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("child"))
