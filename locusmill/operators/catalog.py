"""Items, notes and requests against a catalogue (JN-14, JN-26, JN-29, FLT-17 to FLT-20, SNK-03, SNK-04, SET-03, SET-04, SRT-05, AGG-15, AGG-16).

Every tier is an equi-join; titles meet through the keys of ``locate``. Defined cases: null fields
count as empty and match nothing; a request that nothing fits is kept, with no item; requests that
repeat are resolved each on its own; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.functions.text import clean_doi, text_of
from locusmill.operators.locate import candidates

TITLE = 120
#: Characters that two DOIs of which one is cut short must share at their ends.
TAIL = 6


def resolved(requests: DataFrame, items: DataFrame) -> DataFrame:
    """request_id, tier, item_id and candidates of every request.

    ``requests`` has request_id, doi and title, ``items`` item_id, doi, title and added. The first
    tier with an item decides: the same DOI, a DOI that ends with the other,
    a title that holds the first ``TITLE`` characters of the other. Of several items the newest stays.
    """
    fold = lambda df, key, *more: df.select(key, F.lower(clean_doi("doi")).alias("doi"), F.lower(F.trim(text_of("title"))).alias("title"), *more)
    asked = fold(requests, "request_id").withColumn("title", F.substring("title", 1, TITLE))
    held = fold(items, "item_id", F.unix_micros(F.col("added").cast("timestamp")).alias("added"))
    # Equal DOIs and equal titles stand as one row with their number and their newest item, so that no request meets items one by one.
    newest = F.max(F.struct("added", (-F.col("item_id")).alias("item"))).alias("newest")
    dois, titles = (held.where(f"{c} <> ''").groupBy(c).agg(F.count(F.lit(1)).alias("n"), newest) for c in ("doi", "title"))
    mine = asked.where(F.length("doi") >= TAIL).select("doi").distinct()
    theirs = dois.where(F.length("doi") >= TAIL).withColumnRenamed("doi", "its_doi")
    cut_mine = _ends(theirs, "its_doi", mine, "doi").join(mine.withColumnRenamed("doi", "_end"), "_end").withColumnRenamed("_end", "doi")
    cut_its = _ends(mine, "doi", theirs, "its_doi").where("_end <> doi").join(theirs.withColumnRenamed("its_doi", "_end"), "_end")
    of = lambda met, key: met.groupBy(key).agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
    tails = of(cut_mine.select("doi", "n", "newest").union(cut_its.select("doi", "n", "newest")), "doi")
    wanted = asked.where("title <> ''").select("title").distinct()
    named = candidates(wanted.select(F.col("title").alias("selector_id"), F.col("title").alias("text")), titles.select(F.col("title").alias("doc_id"), F.col("title").alias("text")))
    named = named.toDF("its", "title").where(F.contains("title", "its")).join(titles, "title")
    named = of(named.select(F.col("its").alias("title"), "n", "newest"), "title")
    tier = lambda number, key, met: asked.join(met, key).select("request_id", F.struct(F.lit(number).alias("tier"), "n", "newest").alias("found"))
    found = tier(1, "doi", dois).union(tier(2, "doi", tails)).union(tier(3, "title", named))
    first = found.groupBy("request_id").agg(F.min("found").alias("best"))
    return requests.select("request_id").join(first, "request_id", "left").select(
        "request_id", "best.tier", (-F.col("best.newest.item")).alias("item_id"), F.coalesce("best.n", F.lit(0)).alias("candidates")
    )


def _ends(rows: DataFrame, text: str, others: DataFrame, other: str) -> DataFrame:
    """``rows`` with each end (_end) of their text that is as long as some text of ``others``."""
    sizes = others.select(F.length(other).alias("_n")).distinct().agg(F.array_sort(F.collect_list("_n")).alias("_sizes"))
    fitting = F.filter("_sizes", lambda n: n <= F.length(text))
    return rows.crossJoin(F.broadcast(sizes)).withColumn("_end", F.explode(F.transform(fitting, lambda n: F.right(F.col(text), n)))).drop("_sizes")


def same_document(doi: Column, other_doi: Column, title: Column, other_title: Column) -> Column:
    """Whether two records are of one document: by DOI where both have one, else by title."""
    a, b = clean_doi(doi), clean_doi(other_doi)
    fold = lambda c: F.lower(F.trim(text_of(c)))
    return F.when((a != "") & (b != ""), a == b).otherwise((fold(title) != "") & (fold(title) == fold(other_title)))


def gate(token: Column, wanted: Column, identity: Column, candidates_: Column, chosen: Column) -> Column:
    """The status of a request: 401 without the token, 409 for another document or for several items none of which is chosen, else 200."""
    return F.when(~F.coalesce(token == wanted, F.lit(False)), 401).when(~identity | ((candidates_ > 1) & ~chosen), 409).otherwise(200)


def import_status(title: Column, url: Column) -> Column:
    """400 for a blank or overlong title or an address that isn't http(s), else 200."""
    usable = (F.trim(text_of(title)) != "") & (F.length(text_of(title)) <= 2000) & F.regexp_like(text_of(url), F.lit(r"(?i)^https?://[^\s/]"))
    return F.when(usable, 200).otherwise(400)


def imported(incoming: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Incoming documents (doi, url) that aren't known by DOI, or without one by address; of equal ones the first in ``order``."""
    identity = F.when(clean_doi("doi") != "", F.concat(F.lit("doi:"), clean_doi("doi"))).otherwise(F.concat(F.lit("url:"), F.substring_index(text_of("url"), "#", 1)))
    mine = incoming.withColumn("_identity", identity)
    first = F.row_number().over(W.partitionBy("_identity").orderBy(*order))
    mine = mine.withColumn("_k", first).where("_k = 1").drop("_k")
    return mine.join(known.select(identity.alias("_identity")).distinct(), "_identity", "left_anti").drop("_identity")


def outermost(scopes: DataFrame, key: str, path: str) -> DataFrame:
    """Scopes (paths such as /a/b) that lie in no other scope of their key."""
    parts = F.split(path, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = scopes.select(key, path, F.explode(F.filter(above, lambda p: (p != "") & (p != F.col(path)))).alias("_above"))
    inside = inside.join(scopes.select(key, F.col(path).alias("_above")).distinct(), [key, "_above"], "left_semi").select(key, path).distinct()
    return scopes.join(inside, [key, path], "left_anti")


def markers(rows: DataFrame, key: str, marker: str, expected: DataFrame) -> DataFrame:
    """``key`` with the markers it lacks, those present and whether any is there twice; ``expected`` has key and marker."""
    found = rows.groupBy(key).agg(F.array_sort(F.collect_set(marker)).alias("present"), F.count(marker).alias("_n"))
    wanted = expected.groupBy(key).agg(F.array_sort(F.collect_set(marker)).alias("_wanted"))
    none = F.slice(F.array(F.lit("")), 1, 0)
    both = wanted.join(found, key, "left").withColumn("present", F.coalesce("present", none))
    return both.select(key, "present", F.array_except("_wanted", "present").alias("missing"), (F.coalesce("_n", F.lit(0)) > F.size("present")).alias("repeated"))


def in_box(rect: Column, box: Column, slack: float = 4.0) -> Column:
    """Whether a rectangle (x0, y0, x1, y1) lies in a box, give or take ``slack``; a segment lies in it if all its rectangles do (JN-26)."""
    return (rect["x0"] >= box["x0"] - slack) & (rect["y0"] >= box["y0"] - slack) & (rect["x1"] <= box["x1"] + slack) & (rect["y1"] <= box["y1"] + slack)
