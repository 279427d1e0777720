"""Connected components of an undirected graph, by alternating large and small stars.

Every step is a join and an aggregation over the edges; nothing is collected. Each iteration is
written to the shared folder, so the lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.scratch import discard, fresh_path, saved


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("root", "node")).toDF("node", "near")
    least = both.groupBy("node").agg(F.min("near").alias("_least")).select("node", F.least("node", "_least").alias("root"))
    return both.where("near > node").join(least, "node").select(F.col("near").alias("node"), "root").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("near")).distinct()
    least = down.groupBy("node").agg(F.min("near").alias("root"))
    moved = down.join(least, "node").where("near <> root").select(F.col("near").alias("node"), "root")
    return moved.union(least).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node it can reach), for every node of ``links`` but the roots.

    ``links`` has two columns of the same ordered type; loops are left out.
    """
    edges = links.toDF("node", "root").where("node <> root")
    edges = edges.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct()
    path = fresh_path(links.sparkSession, "components")
    edges = saved(edges, "components", path=path)
    before = _fingerprint(edges)
    while before[0]:
        old, path = path, fresh_path(links.sparkSession, "components")
        edges = saved(_small_star(_large_star(edges)), "components", path=path)
        discard(links.sparkSession, old)
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges
