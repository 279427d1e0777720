"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after each run of white space (0x20, 0x09-0x0D) became
one space. Misra-Gries counters over the partitions find frequent digests; an exact count
verifies them, and the verified winners (at most ``counters`` rows) are broadcast, so that the
rows of a large group are settled where they are read. All other digests take the ordinary
shuffle, in which no group is large any more. Counters only choose the route: each route is
exact, hence the counter bound never changes a result.

Defined cases: a null text counts as empty, and empty texts are one group. A null key never
wins over a key; a group with no key at all has a null ``keep_id`` and is kept. Rows that repeat
both key and text are all kept or all dropped, and each counts in ``group_size``. An empty table
gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.llm.bloom import drop_rows
from locusmill.llm.scratch import in_arrow, saved

SPACE_RUN = r"[\x20\x09-\x0D]+"
COUNTERS = 1000


def normalised(text: str | Column) -> Column:
    """The form in which texts are compared."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), SPACE_RUN, " ")


def _add_counts(counters: dict[bytes, int], values: pa.Array, most: int) -> None:
    """Misra-Gries for a whole batch: add, then lower all counters by the first that has no room."""
    for entry in values.value_counts().to_pylist():
        counters[entry["values"]] = counters.get(entry["values"], 0) + entry["counts"]
    if len(counters) > most:
        cut = sorted(counters.values(), reverse=True)[most]
        for key in [k for k, n in counters.items() if n <= cut]:
            del counters[key]
        for key in counters:
            counters[key] -= cut


def frequent(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Values of ``column`` that may be frequent, at most ``counters`` rows.

    Summaries of the partitions add up: a value in more than 2 / ``counters`` of the rows is
    always among them.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            _add_counts(held, batch.column(0), counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], [column, "estimate"]
        )

    parts = in_arrow(df.select(column), summarise, f"{column} binary, estimate bigint")
    merged = parts.groupBy(column).agg(F.sum("estimate").alias("estimate"))
    return merged.orderBy(F.desc("estimate"), column).limit(counters).select(column)


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``key``, keep_id, group_size, kept, text_sha256."""
    digest = F.unhex(F.sha2(normalised(text), 256))
    digests = saved(docs.select(F.col(key).alias("_key"), digest.alias("_digest")), "exact-digests")
    facts = (F.min("_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    maybe = saved(frequent(digests, "_digest", counters), "exact-frequent")
    winners = digests.join(F.broadcast(maybe), "_digest", "left_semi").groupBy("_digest").agg(*facts)
    winners = saved(winners.where("group_size > 1"), "exact-winners")
    routed = digests.join(F.broadcast(winners), "_digest", "left")
    settled = routed.where(F.col("group_size").isNotNull())

    rest = digests.join(F.broadcast(winners), "_digest", "left_anti")
    others = rest.join(rest.groupBy("_digest").agg(*facts), "_digest")
    return settled.unionByName(others).select(
        F.col("_key").alias(key),
        "keep_id",
        "group_size",
        F.col("_key").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that equal one with a smaller key; columns stay as they are.

    Rows with the same key and different texts are judged apart.
    """
    gone = duplicate_groups(docs, key, text).where("not kept").select(F.col(key).alias("_key"), F.col("text_sha256").alias("_text")).distinct()
    return drop_rows(docs, {"_key": docs[key], "_text": F.sha2(normalised(docs[text]), 256)}, saved(gone, "exact-gone"))
