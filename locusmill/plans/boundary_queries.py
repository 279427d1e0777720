"""Queries that put drifted boundaries of translated pieces back, on paragraphs made of lines of ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.operators import boundaries
from locusmill.plans.registry import query, table

# A line with enough plain words is a paragraph of m sentences, each with a scientific token of its own. Kind 0 stands as it was
# translated. In kind 1 the end of the first sentence drifted into the second, in kind 4 too, but with a token that its
# source doesn't have; in kind 2 a Chinese opening of the second drifted back, in kind 3 its token.
_PARAGRAPHS = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
w AS (SELECT doc_id * 100000 + n AS paragraph_id, CAST((doc_id + n) % 5 AS INTEGER) AS kind, regexp_extract_all(lower(line), '[a-z]{2,}') AS w FROM l),
m AS (SELECT *, CAST(least(len(w) // 3, 6) AS INTEGER) AS m FROM w WHERE len(w) >= 6),
s AS (SELECT paragraph_id, kind, m, unnest(range(0, m)) AS idx, w FROM m),
t AS (SELECT *, 'K' || idx || w[3 * idx + 1] AS token FROM s),
o AS (SELECT *, CASE WHEN kind = 3 AND idx = 1 THEN token || '显示结果。' ELSE '细胞' || token || '显示结果。' END AS whole FROM t)
"""
_DRIFTED = """CASE WHEN kind IN (1, 4) AND idx = 0 THEN '细胞' WHEN kind = 4 AND idx = 1 THEN 'Zz9显示结果。' || whole
  WHEN kind = 1 AND idx = 1 THEN (SELECT token FROM o a WHERE a.paragraph_id = o.paragraph_id AND a.idx = 0) || '显示结果。' || whole
  WHEN kind = 2 AND idx = 0 THEN whole || '细胞' WHEN kind = 2 AND idx = 1 THEN token || '显示结果。'
  WHEN kind = 3 AND idx = 0 THEN whole || (SELECT token FROM o a WHERE a.paragraph_id = o.paragraph_id AND a.idx = 1) WHEN kind = 3 AND idx = 1 THEN '显示结果。' ELSE whole END"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    words = lines.select((F.col("doc_id") * 100000 + F.col("n")).alias("paragraph_id"), ((F.col("doc_id") + F.col("n")) % 5).cast("int").alias("kind"), F.regexp_extract_all(F.lower("line"), F.lit("[a-z]{2,}"), F.lit(0)).alias("w"))
    words = words.where("size(w) >= 6").withColumn("m", F.least(F.floor(F.size("w") / 3), F.lit(6)).cast("int"))
    token = lambda i: F.concat(F.lit("K"), i.cast("string"), F.get("w", 3 * i))
    kind, ending = F.col("kind"), F.lit("显示结果。")

    def piece(i: Column) -> Column:
        whole = F.concat(F.when((kind == 3) & (i == 1), "").otherwise("细胞"), token(i), ending)
        drifted = (
            F.when(kind.isin(1, 4) & (i == 0), F.lit("细胞"))
            .when((kind == 4) & (i == 1), F.concat(F.lit("Zz9"), ending, whole))
            .when((kind == 1) & (i == 1), F.concat(token(F.lit(0)), ending, whole))
            .when((kind == 2) & (i == 0), F.concat(whole, F.lit("细胞")))
            .when((kind == 2) & (i == 1), F.concat(token(i), ending))
            .when((kind == 3) & (i == 0), F.concat(whole, token(F.lit(1))))
            .when((kind == 3) & (i == 1), ending)
            .otherwise(whole)
        )
        source = F.concat(token(i), F.lit(" "), F.get("w", 3 * i + 1), F.lit(" "), F.get("w", 3 * i + 2), F.lit("."))
        return F.struct(i.alias("idx"), drifted.alias("text"), source.alias("source"))

    each = words.select("paragraph_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), piece)).alias("p"))
    return each.select("paragraph_id", "p.*", F.lit(False).alias("failed"), F.lit("").alias("gap"), F.lit(False).alias("blocked"))


@query(f"WITH {_PARAGRAPHS} SELECT paragraph_id, CAST(idx AS INTEGER) AS idx, CASE WHEN kind = 4 THEN {_DRIFTED} ELSE whole END AS text FROM o")
def drifted_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped pieces after both passes: whole again but where the evidence is of another sentence."""
    return boundaries.repaired(_pieces(spark, sf_dir))


@query(f"WITH {_PARAGRAPHS} SELECT paragraph_id, CAST(idx AS INTEGER) AS idx, CASE WHEN kind = 2 THEN whole ELSE {_DRIFTED} END AS text FROM o")
def drifted_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single markers: only an opening between two single sentences moves back."""
    return boundaries.repaired(_pieces(spark, sf_dir), grouped=False)
