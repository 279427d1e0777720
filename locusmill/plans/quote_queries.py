"""Queries that find saved quotes again, and cut source sentences by the figures of their translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions.text import letters_and_digits
from locusmill.operators import partition, quotes
from locusmill.plans.interval_queries import SENTENCES, sentence_array
from locusmill.plans.registry import query, table

_KEYS = rf"list_transform(regexp_extract_all(coalesce(text, ''), '{SENTENCES}'), lambda s: regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]', '', 'g'))"
# Runs of two to five sentences of each item; the places where they stand in a document's key, and those that begin and end with a sentence.
_QUOTES = rf"""
i AS (SELECT item_id, {_KEYS} AS s FROM benchmark), w AS (SELECT item_id, s, unnest(range(2, 6)) AS n FROM i), v AS (SELECT item_id, s, n, unnest(range(0, len(s) - n + 1)) AS a FROM w WHERE len(s) >= n),
q AS (SELECT item_id * 1000 + a * 10 + n AS quote_id, array_to_string(s[a + 1 : a + n], '') AS k FROM v),
d AS (SELECT doc_id, {_KEYS} AS s FROM documents), j AS (SELECT doc_id, s, array_to_string(s, '') AS t FROM d),
f AS (SELECT quote_id, doc_id, k, s, string_split(t, k) AS parts FROM q JOIN j ON length(k) >= 12 AND contains(t, k)),
e AS (SELECT *, unnest(range(1, len(parts))) AS g FROM f),
p AS (SELECT quote_id, doc_id, k, s, CAST(list_sum(list_transform(parts[1:g], lambda x: length(x))) + (g - 1) * length(k) AS BIGINT) AS "start" FROM e),
b AS (SELECT *, list_transform(range(0, len(s) + 1), lambda x: CAST(coalesce(list_sum(list_transform(s[1:x], lambda y: length(y))), 0) AS BIGINT)) AS edges FROM p)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keys = F.transform(sentence_array(F.coalesce("text", F.lit(""))), lambda s: letters_and_digits(s, composed=True))
    items = table(spark, sf_dir, "benchmark").select("item_id", keys.alias("s")).select("*", F.explode(F.sequence(F.lit(2), F.lit(5))).alias("n")).where("size(s) >= n")
    items = items.select("*", F.explode(F.sequence(F.lit(0), F.size("s") - F.col("n"))).alias("a"))
    asked = items.select((F.col("item_id") * 1000 + F.col("a") * 10 + F.col("n")).alias("quote_id"), F.array_join(F.slice("s", F.col("a") + 1, F.col("n")), "").alias("key"))
    return asked, table(spark, sf_dir, "documents").select("doc_id", keys.alias("sentences"))


@query(f"""
WITH {_QUOTES}
SELECT quote_id, doc_id, CAST(len(list_filter(edges, lambda x: x <= "start")) - 1 AS INTEGER) AS "first", CAST(len(list_filter(edges, lambda x: x < "start" + length(k))) - 1 AS INTEGER) AS "last",
  CAST("start" AS INTEGER) AS "start", CAST("start" + length(k) AS INTEGER) AS stop
FROM b WHERE list_contains(edges, "start") AND list_contains(edges, "start" + length(k))
""")
def quoted_sentence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of two to five sentences of an item, found in documents as runs of whole sentences."""
    return quotes.sentence_runs(*_sides(spark, sf_dir))


@query(f"""
WITH {_QUOTES}, g AS (SELECT quote_id, count(*) AS n, min(doc_id) AS doc_id, min("start") AS "start", min("start" + length(k)) AS stop FROM b GROUP BY ALL)
SELECT q.quote_id, CASE WHEN n IS NULL THEN 'not-found' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS n_places,
  CASE WHEN n = 1 THEN doc_id END AS doc_id, CAST(CASE WHEN n = 1 THEN "start" END AS INTEGER) AS "start", CAST(CASE WHEN n = 1 THEN stop END AS INTEGER) AS stop
FROM q LEFT JOIN g ON g.quote_id = q.quote_id
""")
def quotes_found_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict for each quote over all its distinct places, within sentences or of whole ones."""
    return quotes.found_again(*_sides(spark, sf_dir))


# From each line with enough plain words a source of k clauses, each with a figure, and a translation of k sentences with
# figures. Kind 0 agrees, 1 has two figures exchanged, 2 a clause without a figure, 3 the same figure twice, 4 ranges of panels.
_CLAUSES = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
w AS (SELECT doc_id * 100000 + n AS row_id, CAST((doc_id + n) % 5 AS INTEGER) AS kind, CAST(2 + (doc_id + n) % 3 AS INTEGER) AS k, regexp_extract_all(lower(line), '[a-z]{2,}') AS w FROM l),
c AS (SELECT * FROM w WHERE len(w) >= 2 * k + 1),
f AS (SELECT *, list_transform(range(1, k + 1), lambda p: CASE WHEN kind = 4 THEN p || 'a-c' ELSE CAST(p AS VARCHAR) END) AS figs FROM c)
"""


@query(f"""
WITH {_CLAUSES}, p AS (SELECT row_id, k, figs, w, unnest(range(0, k)) AS part FROM f WHERE kind IN (0, 4)),
s AS (SELECT row_id, k, part, figs, w, list_transform(range(0, k), lambda i: '图' || figs[i + 1] || '显示' || CASE WHEN i % 2 = 0 THEN '结果' ELSE '' END || '。') AS u FROM p)
SELECT row_id, CAST(part AS INTEGER) AS part,
  CASE WHEN part > 0 THEN 'which ' ELSE '' END || w[2 * part + 1] || ' ' || w[2 * part + 2] || ' (Fig. ' || figs[part + 1] || ')' || CASE WHEN part < k - 1 THEN ',' ELSE '.' END AS source,
  CAST(length(array_to_string(u[1:part], '')) AS INTEGER) AS "start", CAST(length(array_to_string(u[1:part + 1], '')) AS INTEGER) AS stop
FROM s
""")
def figure_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources cut by the figures of their translations, where exactly one cut agrees."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    words = lines.select((F.col("doc_id") * 100000 + F.col("n")).alias("row_id"), ((F.col("doc_id") + F.col("n")) % 5).alias("kind"), (2 + (F.col("doc_id") + F.col("n")) % 3).cast("int").alias("k"), F.regexp_extract_all(F.lower("line"), F.lit("[a-z]{2,}"), F.lit(0)).alias("w"))
    words = words.where(F.size("w") >= 2 * F.col("k") + 1)
    number = lambda p: F.concat(p.cast("string"), F.when(F.col("kind") == 4, "a-c").otherwise(""))
    places = F.sequence(F.lit(0), F.col("k") - 1)

    def clause(i):
        figure = F.when((F.col("kind") == 3) & (i == 1), number(i)).otherwise(number(i + 1))
        more = F.when((F.col("kind") == 2) & (i == 0), F.concat(F.lit(", which "), F.get("w", 2 * F.col("k")))).otherwise("")
        return F.concat(F.when(i > 0, "which ").otherwise(""), F.get("w", 2 * i), F.lit(" "), F.get("w", 2 * i + 1), F.lit(" (Fig. "), figure, F.lit(")"), more)

    def unit(i):
        figure = F.when((F.col("kind") == 1) & (i < 2), number(2 - i)).when((F.col("kind") == 3) & (i == 1), number(i)).otherwise(number(i + 1))
        return F.concat(F.lit("图"), figure, F.lit("显示"), F.when(i % 2 == 0, "结果").otherwise(""), F.lit("。"))

    rows = words.select("row_id", F.array_join(F.transform(places, unit), "").alias("translation"), F.concat(F.array_join(F.transform(places, clause), ", "), F.lit(".")).alias("source"))
    return partition.aligned_parts(rows, "row_id", "translation", "source", single=F.lit(True))
