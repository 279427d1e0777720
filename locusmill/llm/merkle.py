"""A Merkle manifest of a table, proved along paths of parent preimages; DataFrame and SQL functions only.

A leaf is the SHA-256 (lower-case hex) of doc_id, source, lang, n_chars and text, each ``-`` if null,
else its UTF-8 byte count, ``:`` and its value. Per lang, leaves ascend by doc_id; while there are
several nodes, every ``FAN`` consecutive ones become the hash of their joined hashes. The subroots of
all langs, by lang (null first, then bytewise), make the root likewise.

Each parent is stored as its preimage, the hashes of its children joined. From the root down each
node takes its parent's path and puts the parent's preimage and its own slot before it, so that the
only row that carries a path through a shuffle is a parent, one for every ``FAN`` leaves. A leaf joins
its parent's path; the siblings are the preimages without its own 64 characters, and folding puts a
hash in their place and hashes, from parent to parent.

Places within a lang come from a sort by ranges over narrow rows, counts per range and lang, and a
running sum over those; no lang passes through one task. Groups are of ``FAN`` rows, and each level
is a written table an eighth of the one below.

Defined cases: rows that repeat lang and doc_id follow each other by their leaves, and equal ones are
interchangeable; a null doc_id comes first and is written ``-``. Without rows there is neither root
nor result. An empty text is ``0:``; a leaf that is alone in its lang is the subroot, and alone in the
table the root, with no siblings. Tampering that changes nothing is not seen. Texts of any length are taken whole;
other columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusmill.llm.scratch import Scratch

FAN = 8
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NO_PATH = "cast(array() as array<struct<preimage:string,slot:int>>)"


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of a row's values, each framed by its length."""
    return F.sha2(F.concat(*map(_framed, values)), 256)


def placed(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with at, the place within its group from 0 by ``order``, and most, the greatest such place; no group is held in one task."""
    # Rows that are equal in all of these may be dealt to several ranges by the number.
    keys = [F.asc_nulls_first(c) for c in (group, *order)] + [F.asc("_deal")]
    dealt = rows.withColumn("_deal", F.rand(1))
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_number", F.monotonically_increasing_id())
    dealt = scratch.saved(dealt.withColumn("_range", F.shiftright("_number", 33)).drop("_deal"), "merkle-sorted")
    counts = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_number").alias("_first"))
    # One row for each range and group in it: ranges and groups, not rows, add up.
    whole = Window.partitionBy(group)
    before = F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(
        F.col(group).alias("_group"), F.col("_range").alias("_in"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), (F.sum("_rows").over(whole) - 1).alias("most")
    )
    joined = dealt.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_in")))
    return joined.withColumn("at", F.col("_shift") + F.col("_number")).drop("_group", "_in", "_shift", "_number", "_range")


def levels_of(leaves: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The levels over ``leaves`` (group, at, most, node), which come first; a group ends at the level where most is 0.

    Those above have the preimage of each node as well.
    """
    levels = [leaves]
    most = leaves.agg(F.max("most")).first()[0] or 0
    while most > 0:
        child = F.struct((F.col("at") % FAN).alias("slot"), F.col("node").alias("node"))
        up = [F.floor(F.col(c) / FAN).alias(c) for c in ("at", "most")]
        run = levels[-1].where("most > 0").groupBy("group", *up).agg(F.array_sort(F.collect_list(child)).alias("_run"))
        joined = run.select("group", "at", "most", F.array_join(F.transform("_run", lambda c: c["node"]), "").alias("preimage"))
        levels.append(scratch.saved(joined.withColumn("node", F.sha2("preimage", 256)), "merkle-level"))
        most //= FAN
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """group and node of each group's root."""
    return reduce(DataFrame.unionByName, (level.where("most = 0").select("group", "node") for level in levels))


def with_paths(levels: list[DataFrame], top: DataFrame, scratch: Scratch, held: Scratch) -> DataFrame:
    """The leaves with path, the preimage and slot of each ancestor, nearest first, and root, the root of its group.

    What the result reads is written to ``held``. ``top`` has group, and as path that of the group's root itself.
    """
    named = top.select(F.col("group").alias("_group"), F.col("path").alias("path"))
    above = None
    for number, nodes in reversed(list(enumerate(levels))):
        roots = nodes.where("most = 0").join(named, F.col("group").eqNullSafe(F.col("_group"))).drop("_group").withColumn("root", F.col("node"))
        if above is not None:
            parents = above.select(F.col("group").alias("_group"), F.col("at").alias("_at"), F.col("preimage").alias("_preimage"), F.col("path").alias("_path"), "root")
            same = F.col("group").eqNullSafe(F.col("_group")) & (F.floor(F.col("at") / FAN) == F.col("_at"))
            step = F.array(F.struct(F.col("_preimage").alias("preimage"), (F.col("at") % FAN).cast("int").alias("slot")))
            under = nodes.where("most > 0").join(parents, same).withColumn("path", F.concat(step, F.col("_path")))
            roots = under.drop("_group", "_at", "_preimage", "_path").unionByName(roots)
        above = roots if number == 0 else (held if number == 1 else scratch).saved(roots.drop("node", "most"), "merkle-paths")
    return above


def siblings(path: str) -> Column:
    """The hashes beside each node on the way, joined: every preimage without the own slot."""
    cut = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * DIGEST), F.substring(s["preimage"], (s["slot"] + 1) * DIGEST + 1, F.length(s["preimage"])))
    return F.array_join(F.transform(path, cut), "")


def folded(node: str, path: str) -> Column:
    """The root that a hash leads to along a path of preimages."""

    def put(held: Column, s: Column) -> Column:
        before = F.substring(s["preimage"], F.lit(1), s["slot"] * DIGEST)
        return F.sha2(F.concat(before, held, F.substring(s["preimage"], (s["slot"] + 1) * DIGEST + 1, F.length(s["preimage"]))), 256)

    return F.aggregate(path, F.col(node), put)


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path, and tampered, the leaf of ``tampered_text`` (by default of the text itself)."""
    plain = [F.col(c) for c in FIELDS]
    own = leaf(*plain)
    other = own if tampered_text is None else leaf(*plain[:-1], tampered_text)
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), own.alias("node"), other.alias("tampered"))
    # What the result reads stays: the leaves in their places and the paths of the lowest parents.
    held = Scratch(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.saved(rows, "merkle-leaves")
        rows = held.saved(placed(rows, "group", ["key", "node"], scratch), "merkle-placed")
        levels = levels_of(rows, scratch)
        subs = placed(roots_of(levels).select(F.lit(0).alias("group"), F.col("group").alias("lang"), "node"), "group", ["lang"], scratch)
        upper = levels_of(scratch.saved(subs, "merkle-subroots"), scratch)
        top = roots_of(upper).first()  # one row
        subs = held.saved(with_paths(upper, _no_path(docs.sparkSession), scratch, scratch), "merkle-tops")
        lowest = with_paths(levels, subs.select(F.col("lang").alias("group"), "path"), scratch, held)
    root = F.lit(top and top["node"]).cast("string")
    return lowest.select(F.col("key").alias("doc_id"), F.col("node").alias("leaf"), F.col("root").alias("subroot"), root.alias("root"), "path", "tampered")


def _no_path(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("group"), F.expr(NO_PATH).alias("path"))


def lower_cased_third(key: str = "doc_id", text: str = "text") -> Column:
    """The text, with A-Z lower-cased where 3 divides the crc32 of the key (a null key counts as an empty string)."""
    named = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.when(named % 3 == 0, F.translate(F.col(text), UPPER, LOWER)).otherwise(F.col(text))


def summary(rows: DataFrame) -> DataFrame:
    """A digest of the siblings, the root that the tampered leaf leads to, and whether it is the root."""
    out = rows.withColumn("folded_root", folded("tampered", "path"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
