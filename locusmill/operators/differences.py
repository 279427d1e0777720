"""What changed between two versions of a table, and whether two tables hold the same rows (ALN-19, AGG-14).

Rows are told apart by digests of their values in a canonical form: columns by name, each value
framed by its length, nulls apart from empty texts. A key's rows are a multiset; sums of their digests
stand for it, whatever the order, and are taken before the shuffle, so a key with many rows sends one
row for each task.

Defined cases: keys with null parts are keys like others; rows that repeat a key count each, and a key
whose number of rows differs is changed; columns that only one version has are an error; two empty tables are
equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the values of columns in the order of their names; complex values go in as JSON."""

    def framed(name: str) -> Column:
        # JSON in an array gives every type one form.
        text = F.to_json(F.array(F.col(name)))
        return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(F.lit(""), *(framed(c) for c in sorted(columns))), 256)


def _parts(of: Column) -> list[Column]:
    """Four numbers of 60 bits of a digest; sums of 10^18 of them fit a decimal."""
    return [F.conv(F.substring(of, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


def multiset(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two aggregates: the number of rows, and a text that two groups of rows share if they hold the same rows equally often."""
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in _parts(digest(columns))]
    return F.count(F.lit(1)), F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums), 256)


def same_rows(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often, in whatever order."""
    if sorted(one.columns) != sorted(other.columns):
        return False
    marks = [df.agg(multiset(df.columns)[1].alias("mark")).first().mark for df in (one, other)]
    return marks[0] == marks[1]


def differences(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: ``keys``, status (added, removed, changed, kept), n_old, n_new and fields, the names of columns that differ.

    Fields are named where both versions have one row of the key; otherwise they are empty.
    """
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError("both versions need the same columns")
    values = [c for c in old.columns if c not in keys]

    def version(df: DataFrame, mark: str) -> DataFrame:
        n, all_ = multiset(values)
        each = [F.min(digest([v])).alias(f"_{mark}_{i}") for i, v in enumerate(values)]
        named = [F.col(k).alias(f"_{mark}_key_{i}") for i, k in enumerate(keys)]
        return df.groupBy(*named).agg(n.alias(f"n_{mark}"), all_.alias(f"_{mark}_all"), *each)

    one, two = version(old, "old"), version(new, "new")
    same = F.lit(True)
    for i in range(len(keys)):
        same &= F.col(f"_old_key_{i}").eqNullSafe(F.col(f"_new_key_{i}"))
    both = one.join(two, same, "full")
    status = F.when(F.col("n_old").isNull(), "added").when(F.col("n_new").isNull(), "removed").when(F.col("_old_all") == F.col("_new_all"), "kept").otherwise("changed")
    single = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    names = [F.when(single & (F.col(f"_old_{i}") != F.col(f"_new_{i}")), F.lit(v)) for i, v in enumerate(values)]
    return both.select(
        *(F.when(F.col("n_old").isNotNull(), F.col(f"_old_key_{i}")).otherwise(F.col(f"_new_key_{i}")).alias(k) for i, k in enumerate(keys)),
        status.alias("status"), F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"),
        F.array_sort(F.array_compact(F.array(*names))).alias("fields"),
    )


def redrawn(shown: DataFrame, incoming: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """What to do with each record on show (ALN-19): ``keys`` and action: draw, redraw, keep or drop.

    Records in ``deleted`` (``keys``) are treated as if the source didn't list them.
    """
    listed = incoming.join(deleted.select(*keys).distinct(), keys, "left_anti")
    action = F.when(F.col("status") == "added", "draw").when(F.col("status") == "removed", "drop").when(F.col("status") == "changed", "redraw").otherwise("keep")
    return differences(shown, listed, keys).select(*keys, action.alias("action"))


def persistence(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-14, one row: n_expected, n_found, missing, extra, altered and doubled keys, and whether all is as expected."""
    all_ = differences(expected, found, keys)
    facts = all_.agg(
        F.sum("n_old").alias("n_expected"), F.sum("n_new").alias("n_found"), F.count_if(F.col("status") == "removed").alias("missing"),
        F.count_if(F.col("status") == "added").alias("extra"), F.count_if((F.col("status") == "changed") & (F.col("n_old") == F.col("n_new"))).alias("altered"),
        F.count_if(F.col("n_new") > F.greatest("n_old", F.lit(1))).alias("doubled"), F.count_if(F.col("status") != "kept").alias("_different"),
    )
    return facts.select(*(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_expected", "n_found", "missing", "extra", "altered", "doubled")), (F.col("_different") == 0).alias("as_expected"))
