"""Queries on intervals of texts: markers, bounds, citations taken out, and differences of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.operators import differences, intervals
from locusmill.plans.registry import query, table

#: Sentences by their closing marks, white space included: joined, they are the text. Linear in texts without any mark.
SENTENCES = r"[^.!?]+[.!?]*|[.!?]+"


def sentence_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCES), F.lit(0))


def _sql_places(array: str, name: str) -> str:
    """Pieces and their places, one row each, from a table that has them as an array."""
    return (
        f"SELECT doc_id, {name}, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY {name}) - length(piece) AS BIGINT) AS \"start\","
        f" CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY {name}) AS BIGINT) AS stop"
        f" FROM (SELECT doc_id, unnest({array}) AS piece, generate_subscripts({array}, 1) - 1 AS {name} FROM documents WHERE text IS NOT NULL)"
    )


_SENTENCES = _sql_places(f"regexp_extract_all(text, '{SENTENCES}')", "sentence")
_NODES = _sql_places("list_transform(string_split(text, chr(10)), lambda x: x || chr(10))", "node")


@query(f"""
WITH s AS ({_SENTENCES}), n AS ({_NODES})
SELECT s.doc_id, CAST(sentence AS INTEGER) AS sentence, CAST(node AS INTEGER) AS node, CAST(greatest(s."start", n."start") - n."start" AS INTEGER) AS "first",
  CAST(least(s.stop, n.stop) - n."start" AS INTEGER) AS "last"
FROM s JOIN n ON s.doc_id = n.doc_id AND s."start" < n.stop AND n."start" < s.stop WHERE length(s.piece) > 0
""")
def sentence_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line of each document, a text node, the parts of sentences that lie on it."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    sentences = docs.select("doc_id", F.explode(intervals.lengths_placed(sentence_array(F.col("text")))).alias("s"))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(x, F.lit("\n")))
    nodes = docs.select("doc_id", F.explode(intervals.lengths_placed(lines)).alias("s"))
    return intervals.markers(
        sentences.select("doc_id", F.col("s.n").alias("sentence"), "s.start", "s.stop"), nodes.select("doc_id", F.col("s.n").alias("node"), "s.start", "s.stop"), "doc_id"
    )


@query(f"""
WITH s AS ({_SENTENCES}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
x AS (SELECT n.*, text, strpos(text, piece) AS one FROM n JOIN documents d USING (doc_id))
SELECT doc_id, CAST(sentence AS INTEGER) AS sentence,
  CAST(CASE WHEN sentence % 3 < 2 THEN "start" WHEN strpos(substr(text, one + 1), piece) = 0 THEN one - 1 END AS INTEGER) AS "start",
  CAST(CASE WHEN sentence % 3 < 2 THEN stop WHEN strpos(substr(text, one + 1), piece) = 0 THEN one - 1 + length(piece) END AS INTEGER) AS stop
FROM x
""")
def sentence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that were saved with right offsets, with wrong ones but the right ordinal, or with neither."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select("doc_id", "text", intervals.lengths_placed(sentence_array(F.col("text"))).alias("s"))

    def saved(s: Column) -> Column:
        wrong = s["n"] % 3 > 0
        return F.struct(
            s["text"].alias("text"), F.when(wrong, -1).otherwise(s["start"]).alias("start"), F.when(wrong, -1).otherwise(s["stop"]).alias("stop"),
            F.when(s["n"] % 3 == 2, -1).otherwise(s["n"]).alias("ordinal"),
        )

    found = rows.select("doc_id", intervals.sentence_bounds(F.col("text"), F.col("s"), F.transform("s", saved)).alias("b"))
    # An outer explode: from a plain one a filter on the array's size is inferred and the array made twice.
    return found.select("doc_id", F.posexplode_outer("b").alias("sentence", "_b")).where("sentence is not null").select("doc_id", "sentence", "_b.start", "_b.stop")


@query("""
WITH d AS (SELECT doc_id, text, regexp_replace(text, '[.](\\s|$)', '. [12, 3]\\1', 'g') AS cited FROM documents WHERE text IS NOT NULL AND NOT contains(text, '[12, 3]') AND length(text) > 0)
SELECT doc_id, CAST(length(cited) AS INTEGER) AS n_cited, md5(text) AS rest_md5 FROM d
""")
def texts_without_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations put behind every full stop and taken out again as intervals: what is left is the text."""
    docs = table(spark, sf_dir, "documents").where("text is not null and length(text) > 0 and not contains(text, '[12, 3]')")
    docs = docs.select("doc_id", F.regexp_replace("text", r"[.](\s|\z)", ". [12, 3]$1").alias("cited"))
    pieces = F.split(F.regexp_replace("cited", r"( \[12, 3\])", "\x01$1\x01"), "\x01", -1)
    placed = docs.select("doc_id", F.explode(intervals.lengths_placed(pieces)).alias("p"))
    holes = placed.where(F.col("p.text") == " [12, 3]").select("doc_id", "p.start", "p.stop")
    whole = docs.select("doc_id", F.lit(0).alias("part_of"), F.lit(0).alias("start"), F.length("cited").alias("stop"))
    left = intervals.subtracted(whole, holes, "doc_id", "part_of")
    cuts = left.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    rest = F.array_join(F.transform("cuts", lambda c: F.substring("cited", c["start"] + 1, c["stop"] - c["start"])), "")
    return docs.join(cuts, "doc_id").select("doc_id", F.length("cited").alias("n_cited"), F.md5(rest).alias("rest_md5"))


#: Between sentence n and the next stands a reference that is known (n % 3 = 0), one that isn't, or a word.
_GAP = "CASE sentence % 3 WHEN 0 THEN ' [7, 12] ' WHEN 1 THEN ' [7, 99] ' ELSE ' see 7 ' END"


@query(f"""
WITH s AS ({_SENTENCES}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM s)
SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, {_GAP} AS gap, sentence % 3 = 0 AS holds FROM n WHERE sentence + 1 < n
""")
def reference_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between neighbouring pieces of a source, found by their places, and whether they hold known references alone."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    gap = lambda n: F.when(n % 3 == 0, " [7, 12] ").when(n % 3 == 1, " [7, 99] ").otherwise(" see 7 ")
    # The source is the pieces with gaps between them; pieces keep their places in it.
    pieces = docs.select("doc_id", sentence_array(F.col("text")).alias("p")).select("doc_id", F.transform("p", lambda p, i: F.concat(p, gap(i))).alias("p"))
    placed = pieces.select("doc_id", F.array_join("p", "").alias("source"), intervals.lengths_placed(F.col("p")).alias("s"))
    own = F.transform("s", lambda s: F.struct(s["n"].alias("n"), s["start"].alias("start"), (s["stop"] - F.length(gap(s["n"]))).alias("stop")))
    placed = placed.select("doc_id", "source", own.alias("s"))
    between = F.transform(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), lambda s, i: F.struct(s["n"].alias("n"), F.substring("source", s["stop"] + 1, F.get("s", i + 1)["start"] - s["stop"]).alias("gap")))
    each = placed.select("doc_id", F.explode(between).alias("g")).select("doc_id", F.col("g.n").alias("sentence"), "g.gap")
    return each.withColumn("holds", intervals.reference_gap(F.col("gap"), F.array(F.lit("7"), F.lit("12"))))


# The next version of orders: some are gone, some dearer, some twice, some under another key.
def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    new = old.where(key % 50 != 1).union(old.where(key % 50 == 3))
    new = new.withColumn("o_orderstatus", F.when((key % 50).isin(2, 5), "X").otherwise(F.col("o_orderstatus")))
    new = new.withColumn("o_totalprice", F.col("o_totalprice") + F.when(key % 50 == 2, 1).otherwise(0))
    return old, new.withColumn("o_orderkey", F.when(key % 50 == 4, key + 1_000_000_000).otherwise(key))


@query("""
WITH n AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)
SELECT k AS o_orderkey, CASE k % 50 WHEN 1 THEN 'removed' WHEN 4 THEN 'removed' WHEN 2 THEN 'changed' WHEN 3 THEN 'changed' WHEN 5 THEN CASE WHEN s = 'X' THEN 'kept' ELSE 'changed' END ELSE 'kept' END AS status,
  1 AS n_old, CASE WHEN k % 50 IN (1, 4) THEN 0 WHEN k % 50 = 3 THEN 2 ELSE 1 END AS n_new,
  CASE WHEN k % 50 = 2 THEN 'o_orderstatus,o_totalprice' WHEN k % 50 = 5 THEN 'o_orderstatus' ELSE '' END AS fields FROM n
UNION ALL SELECT k + 1000000000, 'added', 0, 1, '' FROM n WHERE k % 50 = 4
""")
def orders_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of two versions of the table: added, removed, changed or kept, and the columns that differ."""
    old, new = _versions(spark, sf_dir)
    return differences.differences(old, new, ["o_orderkey"]).withColumn("fields", F.array_join("fields", ","))


@query("""
SELECT k AS o_orderkey, CASE WHEN k % 50 IN (1, 4) OR k % 7 = 0 THEN 'drop' WHEN k % 50 IN (2, 3, 5) THEN 'redraw' ELSE 'keep' END AS action FROM (SELECT o_orderkey AS k FROM orders)
UNION ALL SELECT k + 1000000000, 'draw' FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 50 = 4
""")
def orders_redrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on show against the next version, without those that were deleted here and are still listed there."""
    old, new = _versions(spark, sf_dir)
    return differences.redrawn(old, new, old.where("o_orderkey % 7 = 0"), ["o_orderkey"])


@query("""
WITH k AS (SELECT o_orderkey % 50 AS k FROM orders), c AS (SELECT count(*) AS n, count(*) FILTER (k = 1) AS one, count(*) FILTER (k IN (2, 5)) AS two, count(*) FILTER (k = 3) AS three, count(*) FILTER (k = 4) AS four FROM k)
SELECT 'next' AS version, n AS n_expected, n - one + three AS n_found, one + four AS missing, four AS extra, two AS altered, three AS doubled, false AS as_expected FROM c
UNION ALL SELECT 'same', n, n, 0, 0, 0, 0, true FROM c
""")
def orders_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stored table is the expected one: the next version isn't, the same rows in another order are."""
    old, new = _versions(spark, sf_dir)
    found = differences.persistence(old, new, ["o_orderkey"]).withColumn("version", F.lit("next"))
    return found.unionByName(differences.persistence(old, old.repartition(5, "o_custkey"), ["o_orderkey"]).withColumn("version", F.lit("same")))
