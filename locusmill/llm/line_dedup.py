"""Line deduplication with two Bloom filters, exact whatever the filters hold.

A line's key is the line without white space (0x20, 0x09-0x0D) at both ends, A-Z lower-cased. Keys
of at least ``LEAST_CHARS`` code points that at least ``LEAST_DOCS`` documents hold are repeated: they
lose all their lines but those in the document with the largest id that holds them.

Each task reduces its keys to places in a blocked Bloom filter and tells places met once from
places met twice. The pieces of a block are folded as a stream, each block in one task: a place is
in the once-seen filter if any piece holds it, in the twice-seen filter if a piece holds it twice or
two pieces hold it once. A key that two documents hold is always in the second filter, which is
broadcast; only its suspects are shuffled, as digests, confirmed by exact counts and joined with
the confirmed ones (the ``FREQUENT`` most frequent by broadcast, so that no digest makes a large
task). A once-seen filter of the documents that lose lines then keeps all other documents, with
their texts, out of the last shuffle.

The filters have eight bits for each key, counted beforehand, up to ``bloom.MOST_BITS`` (128 MB), which
bounds the broadcast. Beyond some 10^8 keys more lines are suspected in vain and shuffled as
digests; the result stays the same.

Defined cases: a null text counts as empty, which is one empty line. Each row is a document; rows
that repeat id and text count each, and are all treated alike. A null id holds a key but never
keeps its line if another holder has an id; if no holder has one, all keep theirs. Empty lines and
texts of any length are taken whole; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.llm.bloom import bits_for, filters, maybe_among, maybe_in
from locusmill.llm.scratch import Scratch, in_arrow, saved, text_mark

LEAST_CHARS = 40
LEAST_DOCS = 5
FREQUENT = 1000
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)


def long_keys(text: str, least: int = LEAST_CHARS) -> Column:
    """The distinct keys of a text's lines that have at least ``least`` code points."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.length(x) >= least)
    # Trimming by a set of characters reads all of a line, so lines without white space at an end pass by it.
    loose = lambda x: F.left(x, F.lit(1)).isin(*SPACE) | F.right(x, F.lit(1)).isin(*SPACE)
    trimmed = F.transform(lines, lambda x: F.when(loose(x), F.btrim(x, F.lit(SPACE))).otherwise(x))
    return F.array_distinct(F.transform(F.filter(trimmed, lambda x: F.length(x) >= least), lambda x: F.translate(x, UPPER, LOWER)))


def repeated_keys(docs: DataFrame, scratch: Scratch, least_chars: int, least_docs: int, bits: int | None) -> DataFrame:
    """_key, _mark and _digest: the digests of the keys that each row of ``docs`` (_key, _mark, _text) loses."""
    keys = long_keys("_text", least_chars)
    if bits is None:
        long_lines = F.size(F.filter(F.split("_text", "\n", -1), lambda x: F.length(x) >= least_chars))
        bits = bits_for(docs.agg(F.coalesce(F.sum(long_lines), F.lit(0))).first()[0])
    each = docs.select("_key", "_mark", F.explode(keys).alias("_line")).withColumn("_hash", F.xxhash64("_line"))
    known = scratch.saved(filters(each.select("_hash"), bits), "line-filter")
    suspects = maybe_in(each, "_hash", known, "twice", bits).where("_maybe")
    suspects = scratch.saved(suspects.select("_key", "_mark", F.unhex(F.sha2("_line", 256)).alias("_digest")), "line-suspects")

    facts = (F.count(F.lit(1)).alias("_docs"), F.max("_key").alias("_last"))
    repeated = scratch.saved(suspects.groupBy("_digest").agg(*facts).where(F.col("_docs") >= least_docs), "line-repeats")
    frequent = scratch.saved(repeated.orderBy(F.desc("_docs"), "_digest").limit(FREQUENT), "line-frequent")
    here = suspects.join(F.broadcast(frequent), "_digest")
    there = suspects.join(F.broadcast(frequent.select("_digest")), "_digest", "left_anti")
    there = there.join(repeated.join(F.broadcast(frequent.select("_digest")), "_digest", "left_anti"), "_digest")
    return here.unionByName(there).where(~F.col("_key").eqNullSafe(F.col("_last"))).select("_key", "_mark", "_digest")


KEPT = "_key {key}, n_lines bigint, n_dropped bigint, kept string"


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int | None = None
) -> DataFrame:
    """One row per document: ``key``, n_lines (before), n_dropped, kept (the text that is left)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), text_mark(text).alias("_mark"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text_, gone in zip(batch.column("_text").to_pylist(), batch.column("_gone").to_pylist()):
                lines, gone = text_.split("\n"), set(gone or ())
                left = [x for x in lines if len(x) < least_chars or _digest(x, least_chars) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append("\n".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["_key", "n_lines", "n_dropped", "kept"])

    with Scratch(spark) as scratch:
        gone = repeated_keys(rows, scratch, least_chars, least_docs, bits)
        gone = saved(gone.groupBy("_key", "_mark").agg(F.collect_set("_digest").alias("_gone")), "line-gone")
    rows = maybe_among(rows, ["_key", "_mark"], gone)
    whole = rows.where(~F.col("_maybe")).select("_key", F.size(F.split("_text", "\n", -1)).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"), F.col("_text").alias("kept"))
    theirs = gone.withColumnsRenamed({"_key": "_gone_key", "_mark": "_gone_mark"})
    cut = rows.where("_maybe").join(theirs, F.col("_key").eqNullSafe(F.col("_gone_key")) & (F.col("_mark") == F.col("_gone_mark")), "left")
    cut = in_arrow(cut.select("_key", "_text", "_gone"), without, KEPT.format(key=docs.schema[key].dataType.simpleString()))
    return whole.unionByName(cut).withColumnRenamed("_key", key)


def _digest(line: str, least: int) -> bytes | None:
    line = line.strip(SPACE).translate(_TO_LOWER)
    return hashlib.sha256(line.encode()).digest() if len(line) >= least else None


def summary(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and a digest of what is left, for each document."""
    return lines.select(key, "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
