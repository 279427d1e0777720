"""Keyed record operators: roll-ups, upserts, compare-and-set, anti-joins, runs and retries.

Cross-references: AGG-03, AGG-04, JN-15, JN-17, JN-23, SET-06, SET-07, SNK-01, SNK-02, FLT-16,
FLT-15, SRT-09, SRT-10, STR-06, STR-10, STR-11, STR-15, STR-18, STR-19, WIN-10. Every order has a tie-break,
so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rolled_up(events: DataFrame, keys: list[str], order: list[str], evidence: str) -> DataFrame:
    """One row per key: occurrences, first and last order values, first and latest evidence."""
    row = F.struct(*order, F.col(evidence).alias("evidence"))
    grouped = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.min(row).alias("first"), F.max(row).alias("last"))
    return grouped.select(*keys, "occurrences", "first", "last")


def reopened(events: DataFrame, key: str, order: list[str], resolves: Column) -> DataFrame:
    """key, occurrences and status: resolved if the last event resolves, unresolved if an earlier one did, else new."""
    last = F.max(F.struct(*order, resolves.alias("_resolves")))["_resolves"]
    grouped = events.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"), last.alias("_last"), F.max(resolves).alias("_ever"))
    status = F.when(F.col("_last"), "resolved").when(F.col("_ever"), "unresolved").otherwise("new")
    return grouped.select(key, "occurrences", status.alias("status"))


def without(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key isn't known yet."""
    return incoming.join(known.select(*keys).distinct(), keys, "left_anti")


def not_deleted_since(rows: DataFrame, deletions: DataFrame, key: str, at: str) -> DataFrame:
    """Rows without a deletion of their key at the same time or later."""
    last = deletions.groupBy(key).agg(F.max(at).alias("_deleted"))
    joined = rows.join(last, key, "left")
    return joined.where(F.col("_deleted").isNull() | (F.col(at) > F.col("_deleted"))).drop("_deleted")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; maxima are taken before the shuffle, so a hot key sends one row for each task."""
    row = F.struct(*(c for c in rows.columns if c not in keys))
    last = rows.groupBy(*keys).agg(F.max(F.struct(F.struct(*order).alias("order"), row.alias("row"))).alias("_last"))
    return last.select(*keys, "_last.row.*").select(*rows.columns)


def with_history(events: DataFrame, key: str, order: list[str], state: str, version: Column, most: int) -> DataFrame:
    """key, occurrences, first and last version, how many there are, and the last ``most`` states in order, joined by commas.

    Only the last ``most`` rows of a key are brought together, and each task sends no more of them.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    last = events.withColumn("_k", place).where(F.col("_k") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(-F.col("_k"), F.col(state).alias("state")))).alias("_h"))
    history = last.select(key, F.array_join(F.transform("_h", lambda s: s["state"]), ",").alias("history"))
    facts = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("occurrences"), F.min(version).alias("first_version"), F.max(version).alias("last_version"), F.count_distinct(version).alias("versions")
    )
    return facts.join(history, key)


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Neighbouring rows of a key with equal values as one row: run, value, n, and the first of ``order``'s last column."""
    window = W.partitionBy(key).orderBy(*order)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(window))) | (F.row_number().over(window) == 1)
    marked = rows.withColumn("_new", starts.cast("int")).withColumn("run", F.sum("_new").over(window.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"), F.min(order[-1]).alias("first_id"))


def paired_dropped(events: DataFrame, key: str, order: list[str], kind: str, gap_seconds: float) -> DataFrame:
    """Events but those that follow one of another kind of the same key within the gap."""
    window = W.partitionBy(key).orderBy(*order)
    gap = (F.unix_micros(F.col(order[0]).cast("timestamp")) - F.unix_micros(F.lag(order[0]).over(window).cast("timestamp"))) / 1e6
    paired = (F.lag(kind).over(window) != F.col(kind)) & (gap <= gap_seconds)
    return events.withColumn("_paired", F.coalesce(paired, F.lit(False))).where("not _paired").drop("_paired")


def retry_action(status: Column) -> Column:
    """What becomes of a request: done, retry (429 and from 500) or error."""
    return F.when(status == 200, "done").when((status == 429) | (status >= 500), "retry").otherwise("error")


def compare_and_set(requests: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Requests (key, expected, wanted) with a status: ok, conflict or missing."""
    both = requests.join(current.select(key, F.col(value).alias("_now"), F.lit(True).alias("_there")), key, "left")
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_now").eqNullSafe(F.col("expected")), "ok").otherwise("conflict")
    return both.withColumn("status", status).drop("_now", "_there")


def upsert_plan(current: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """key, action (insert, update, noop) and value for the keys of ``changes`` (one row each)."""
    both = changes.join(current.select(key, F.col(value).alias("_now"), F.lit(True).alias("_there")), key, "left")
    action = F.when(F.col("_there").isNull(), "insert").when(F.col("_now").eqNullSafe(F.col(value)), "noop").otherwise("update")
    return both.select(key, action.alias("action"), value)


def vote(rows: DataFrame, key: str, choice: str, weight: Column, share: float = 0.7, margin: int = 8) -> DataFrame:
    """The heaviest choice of each key, accepted if it has the share of all weight and the lead."""
    weights = rows.groupBy(key, choice).agg(F.sum(weight).alias("weight"))
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc("weight"), choice))
    everything = W.partitionBy(key)
    ranked = weights.select(key, choice, "weight", best.alias("_k"), F.sum("weight").over(everything).alias("total"),
                            F.coalesce(F.lead("weight").over(W.partitionBy(key).orderBy(F.desc("weight"), choice)), F.lit(0)).alias("second"))
    accepted = (F.col("weight") >= share * F.col("total")) & (F.col("weight") - F.col("second") >= margin)
    return ranked.where("_k = 1").select(key, choice, "weight", "second", accepted.alias("accepted"))


def covers_all(rows: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """Keys that have every wanted value."""
    return rows.where(F.col(value).isin(wanted)).groupBy(key).agg(F.count_distinct(value).alias("_n")).where(F.col("_n") == len(wanted)).select(key)


def archived(entries: DataFrame, group: str, reason: str, legacy: str, order: list[str], most: int) -> DataFrame:
    """``entries`` with fate: those whose reason holds ``legacy`` leave the outbox, and the last ``most`` of each group are kept in its archive (FLT-15).

    fate is waiting, archived or forgotten; a null reason counts as empty. Only rows that leave are ranked.
    """
    leaves = F.contains(F.coalesce(reason, F.lit("")), F.lit(legacy))
    gone = entries.where(leaves)
    place = F.row_number().over(W.partitionBy(group).orderBy(*(F.desc(c) for c in order)))
    fate = F.when(place <= most, "archived").otherwise("forgotten")
    return entries.where(~leaves).withColumn("fate", F.lit("waiting")).unionByName(gone.withColumn("fate", fate))
